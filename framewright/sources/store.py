"""Small shared tables that several jobs write: versions with a lock, and results kept by their fingerprint.

A table is a folder of numbered versions; a reader takes the highest complete one, so it never sees half a write. A writer claims the next
number by creating a file that must not exist yet, which the file system decides for all writers. All files lie in the shared folder that
the caller names, so a lost executor or driver leaves at most a version without its end mark, which nobody reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from framewright.operators.catalog import upsert


class Taken(RuntimeError):
    """Another writer holds the next version."""


def file_system(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, path: str) -> list[int]:
    """Numbers of the complete versions, ascending."""
    fs, p = file_system(spark, path)
    if not fs.exists(p):
        return []
    child = spark._jvm.org.apache.hadoop.fs.Path
    names = [s.getPath().getName() for s in fs.listStatus(p)]
    return sorted(int(n[1:]) for n in names if n[:1] == "v" and n[1:].isdigit() and fs.exists(child(p, f"{n}/_SUCCESS")))


def latest(spark: SparkSession, path: str) -> DataFrame | None:
    n = versions(spark, path)
    return spark.read.parquet(f"{path}/v{n[-1]}") if n else None


def merged(changes: DataFrame, path: str, keys: list[str], at: str, keep: int = 2) -> DataFrame:
    """Read, upsert by keys (the latest row by `at`), and write the next version under a lock; raises Taken where another writer is at it.

    Of the versions before the new one, `keep` stay for readers that have begun.
    """
    spark = changes.sparkSession
    fs, p = file_system(spark, path)
    child = spark._jvm.org.apache.hadoop.fs.Path
    fs.mkdirs(p)
    done = versions(spark, path)
    number = (done[-1] if done else 0) + 1
    lock = child(p, f"_lock_{number}")
    if not fs.createNewFile(lock):
        raise Taken(f"version {number} of {path} is being written")
    try:
        if versions(spark, path) != done:
            raise Taken(f"version {number} of {path} was written meanwhile")
        now = latest(spark, path)
        (upsert(now, changes, keys, at) if now is not None else upsert(changes.limit(0), changes, keys, at)).write.mode("overwrite").parquet(f"{path}/v{number}")
    finally:
        fs.delete(lock, False)
    for old in done[: -keep or None]:
        fs.delete(child(p, f"v{old}"), True)
    return spark.read.parquet(f"{path}/v{number}")


def kept(spark: SparkSession, folder: str, fingerprint: str, build: Callable[[], DataFrame]) -> DataFrame:
    """The result kept under a fingerprint, or the one that build makes, which is then kept."""
    if not versions(spark, f"{folder}/{fingerprint}"):
        build().write.mode("overwrite").parquet(f"{folder}/{fingerprint}/v1")
    return spark.read.parquet(f"{folder}/{fingerprint}/v1")
