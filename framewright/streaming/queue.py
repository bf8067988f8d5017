"""Task queue, incremental reports, leases and append-only indexes on Structured Streaming.

The queue is a log of status rows (task, pos, status, attempt, at); the present state is an aggregate of it, batch or streaming.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from framewright.functions.scalars import backoff

LOG = "task string, pos int, status string, attempt int, exit_code int, at timestamp"


def queue_state(log: DataFrame) -> DataFrame:
    """Latest status per task, in queue order when shown; removed tasks are gone."""
    return log.groupBy("task").agg(F.max_by(F.struct("pos", "status", "attempt", "exit_code"), "at").alias("s"), F.max("at").alias("at")).select("task", "s.*", "at").where("status <> 'removed'")


def due_tasks(state: DataFrame, now, max_retries: int, base: float = 30.0) -> DataFrame:
    """Tasks to run: waiting ones, and failed ones with retries left whose backoff has passed."""
    ready = F.col("at") + F.make_dt_interval(secs=backoff(F.col("attempt"), base).cast("decimal(18,6)")) <= now
    return state.where((F.col("status") == "waiting") | ((F.col("status") == "failed") & (F.col("attempt") <= max_retries) & ready)).orderBy("pos")


def run_queue(spark: SparkSession, log_dir: str, checkpoint: str, runner: Callable[[str], int], max_retries: int = 2, once: bool = True) -> StreamingQuery:
    """Watch the log; after each micro-batch run the first due task and append its new status to the log.

    The runner must be idempotent: after a lost driver the last batch is delivered again, and a task that is already done is skipped.
    """

    def step(batch: DataFrame, _: int) -> None:
        now = F.current_timestamp()
        for row in due_tasks(queue_state(spark.read.schema(LOG).json(log_dir)), now, max_retries).limit(1).collect():
            code = runner(row.task)
            done = spark.createDataFrame([(row.task, row.pos, "done" if code == 0 else "failed", row.attempt + 1, code)], "task string, pos int, status string, attempt int, exit_code int")
            done.withColumn("at", now).coalesce(1).write.mode("append").json(log_dir)

    w = spark.readStream.schema(LOG).json(log_dir).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="5 seconds")).start()


def append_log(spark: SparkSession, log_dir: str, rows: list[tuple]) -> None:
    """Add, remove or clear tasks: each is one appended status row."""
    spark.createDataFrame(rows, "task string, pos int, status string, attempt int, exit_code int").withColumn("at", F.current_timestamp()).coalesce(1).write.mode("append").json(log_dir)


def incremental_report(frames: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Running totals per class rewritten after every micro-batch (complete mode into one small table)."""
    totals = frames.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n"), F.avg("conf").alias("mean_conf"))

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    return totals.writeStream.outputMode("complete").foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Events per kind and tumbling window, with late data up to the watermark; the same plan runs on batch frames."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean_value"))


def active_peers(heartbeats: DataFrame, now, stale_seconds: int) -> DataFrame:
    """Hosts whose last heartbeat is fresh; the others' leases may be taken over."""
    last = heartbeats.groupBy("host").agg(F.max("at").alias("last_at"))
    return last.withColumn("active", F.unix_timestamp(now) - F.unix_timestamp("last_at") <= stale_seconds)


def stale_leases(leases: DataFrame, now, local_host: str, alive: DataFrame, heartbeat_seconds: int = 30, beats: int = 3) -> DataFrame:
    """Leases (resource, host, pid, acquired_at, last_heartbeat) with stale: those whose holder is gone.

    A lease lives while its last heartbeat (else its acquisition) is younger than `beats` intervals; on this host also while
    its process is among the alive ones (pid). A pid of another host means nothing here.
    """
    seen = F.coalesce("last_heartbeat", "acquired_at")
    fresh = F.coalesce(F.unix_timestamp(now) - F.unix_timestamp(seen) < heartbeat_seconds * beats, F.lit(False))
    here = leases.join(alive.select("pid").distinct().withColumn("_alive", F.lit(True)), "pid", "left")
    running = (F.col("host") == local_host) & F.col("_alive").isNotNull()
    return here.withColumn("stale", ~(F.coalesce(running, F.lit(False)) | fresh)).drop("_alive").select(*leases.columns, "stale")


def taken_over(leases: DataFrame, wanted: DataFrame, now) -> DataFrame:
    """Leases after the requests (resource, host, pid) are served: free and stale ones go to the first request by host and pid, live ones stay."""
    held = leases.groupBy("resource").agg(F.max(F.struct(F.coalesce("last_heartbeat", "acquired_at").alias("at"), "host", "pid", "acquired_at", "last_heartbeat", "stale")).alias("h"))
    asked = wanted.groupBy("resource").agg(F.min(F.struct("host", "pid")).alias("w"))
    both = held.join(asked, "resource", "full_outer")
    new = F.col("w").isNotNull() & (F.col("h").isNull() | F.col("h.stale"))
    pick = lambda c, fresh: F.when(new, fresh).otherwise(F.col(f"h.{c}")).alias(c)
    return both.select("resource", pick("host", F.col("w.host")), pick("pid", F.col("w.pid")), pick("acquired_at", now), pick("last_heartbeat", now), new.alias("taken"))


def append_index(frames: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append-only JSON lines index of streamed frames."""
    return frames.writeStream.format("json").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def new_sources(listing: DataFrame, seen: DataFrame) -> DataFrame:
    """Listed sources whose (source, signature) has not been scanned."""
    return listing.join(seen.select("source", "signature").distinct(), ["source", "signature"], "left_anti")
