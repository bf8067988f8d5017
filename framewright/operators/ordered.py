"""Global numbering and prefix sums that never put a whole key into one task.

A plain window over a key sorts every row of that key in one task. Here the rows are range-partitioned by
(key, order), so a hot key spreads over many partitions; each (partition, key) run is numbered on its own and shifted by
the totals of the runs before it. Only one small row per (partition, key) is exchanged for the shift.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.session import cut_lineage


def numbered(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str | None = None, total: bool = False) -> DataFrame:
    """Add `pos` (0-based rank within keys) and, with value, `cum` (sum of value over the rows before); with total also `total` (sum of value, or rows, of the key).

    Rows with equal keys and order columns are numbered in an unspecified order, so give a unique last order column.
    Null keys form a group of their own; a null value counts as 0. An empty frame gives an empty frame.
    """
    keys, order = list(keys), list(order)
    base = cut_lineage(df.repartitionByRange(*[F.col(c) for c in keys + order]).withColumn("_pid", F.spark_partition_id()))
    run = Window.partitionBy("_pid", *keys).orderBy(*order)
    local = base.withColumn("_rn", F.row_number().over(run).cast("long") - 1)
    sums = [F.count(F.lit(1)).alias("_n")]
    if value is not None:
        v = F.coalesce(F.col(value), F.lit(0))
        local = local.withColumn("_lc", F.sum(v).over(run.rowsBetween(Window.unboundedPreceding, 0)) - v)
        sums.append(F.sum(v).alias("_s"))
    before = Window.partitionBy(*(keys or [F.lit(0)])).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    runs = base.groupBy("_pid", *keys).agg(*sums)
    runs = runs.withColumn("_off", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    if value is not None:
        runs = runs.withColumn("_offs", F.coalesce(F.sum("_s").over(before), F.lit(0)))
    if total:
        runs = runs.withColumn("total", F.sum("_n" if value is None else "_s").over(before.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    runs = runs.drop("_n", "_s")
    names = ["_pid", *keys]
    right = runs.select([F.col(c).alias(f"_r_{c}") if c in names else F.col(c) for c in runs.columns])
    cond: Column = F.lit(True)
    for c in names:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    out = local.join(right, cond, "left").withColumn("pos", F.col("_rn") + F.col("_off"))
    if value is not None:
        out = out.withColumn("cum", F.col("_lc") + F.col("_offs"))
    return out.select(*df.columns, "pos", *(["cum"] if value is not None else []), *(["total"] if total else []))


def ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, value, times, cum (values of the key below it) and total of the key: its distribution, sorted over many tasks.

    Equal values are added up before they move, null values are left out. A key with a third of all rows is spread by value.
    """
    return numbered(df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("times")), keys, [value], "times", total=True).drop("pos")


def at_rank(value: str, rank: Column) -> Column:
    """An aggregate over ranks: the value at a 0-based fractional rank of the key, between two values by linear interpolation."""
    low, high = F.floor(rank), F.ceil(rank)
    at = lambda r: F.max(F.when((F.col("cum") <= r) & (r < F.col("cum") + F.col("times")), F.col(value)))
    part = F.max(rank - low)
    return at(low) + (at(high) - at(low)) * part


def quantiles(df: DataFrame, keys: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """keys, n, and a column for each quantile: exact, with linear interpolation, and without one task per key."""
    return ranks(df, keys, value).groupBy(*keys).agg(F.max("total").alias("n"), *[at_rank(value, q * (F.col("total") - 1)).alias(name) for name, q in at.items()])
