"""Joins that stay even when one key holds a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 200_000


def lookup_join(big: DataFrame, small: DataFrame, on: Sequence[str], salt_by: Sequence[str], how: str = "left", max_rows: int = BROADCAST_ROWS, salts: int | None = None, null_safe: bool = False) -> DataFrame:
    """Join big to a lookup with unique keys.

    The lookup is counted first: up to max_rows narrow rows it is broadcast; beyond that every lookup row is repeated for each of
    `salts` salts (by default one for eight cores of the cluster, from 16 to 256) and the big side is salted by a hash of salt_by, so
    that a hot key is shared by `salts` tasks.
    Null keys match nothing, or one another with null_safe.
    """
    on = list(on)
    few = small.limit(max_rows + 1).count() <= max_rows
    if not few:
        salts = salts or min(256, max(16, big.sparkSession.sparkContext.defaultParallelism // 8))
        small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
        on.append("_salt")
    right = F.broadcast(small) if few else small
    if not null_safe:
        return big.join(right, on, how).drop("_salt")
    right = right.select(*[F.col(c).alias(f"_on_{c}") if c in on else F.col(c) for c in small.columns])
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return big.join(right, same, how).drop("_salt", *[f"_on_{c}" for c in on])


def spread(df: DataFrame, by: Sequence[str]) -> DataFrame:
    """Repartition a scan that has too few splits for the cluster's cores, ahead of work that is heavy per row.

    Inputs with enough splits (any large table) are left as they are, without a shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= 2 * cores else df.repartition(4 * cores, *by)


def stated_tasks(spark: SparkSession) -> int:
    """A number of partitions to state where few bytes mean much work, which adaptive execution would put into one task."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
