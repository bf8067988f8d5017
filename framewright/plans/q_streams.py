"""Queries of queue state and windowed events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import backoff
from framewright.session import table
from framewright.sources import sinks
from framewright.plans import views as V
from framewright.streaming import queue as Q


def queue_log(s, d):
    e = table(s, d, "events")
    status = F.when(F.col("event_id") % 3 == 0, "waiting").when(F.col("event_id") % 3 == 1, "failed").otherwise("done")
    return e.select(F.col("user_id").cast("string").alias("task"), F.col("user_id").cast("int").alias("pos"), status.alias("status"), (F.col("event_id") % 4 + 1).cast("int").alias("attempt"), F.lit(0).alias("exit_code"), F.col("ts").alias("at"))


def queue_status(s: SparkSession, d: str) -> DataFrame:
    q = Q.queue_state(queue_log(s, d))
    return q.select("task", "status", "attempt", F.round(backoff(F.col("attempt")), 3).alias("wait_s"))


def windowed_events(s: SparkSession, d: str) -> DataFrame:
    w = Q.windowed_rates(table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "1 day")
    return w.groupBy("event_type").agg(F.count(F.lit(1)).alias("n_windows"), F.sum("n").alias("n_events"))


def label_texts(s: SparkSession, d: str) -> DataFrame:
    t = sinks.label_texts(V.annotations(s, d), ["image_id"])
    return t.select("image_id", F.md5("content").alias("content_md5"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (queue_status, windowed_events, label_texts)}
ORACLES = {
    "queue_status": "select user_id::varchar as task, case arg_max(event_id, ts) % 3 when 0 then 'waiting' when 1 then 'failed' else 'done' end as status, (arg_max(event_id, ts) % 4 + 1)::int as attempt, round(least(600.0, 30.0 * pow(2, arg_max(event_id, ts) % 4)), 3) as wait_s from events group by user_id",
    "windowed_events": "select event_type, count(distinct date_trunc('day', ts)) as n_windows, count(*) as n_events from events group by 1",
    "label_texts": V.with_(V.ANN) + "select image_id, md5(string_agg(line, chr(10) order by cls_id, line) || chr(10)) as content_md5 from (select image_id, cls_id, case when kind = 'bbox' then printf('%d %.8f %.8f %.8f %.8f', cls_id, cx, cy, w, h) else cls_id || ' ' || array_to_string(list_transform(points, lambda p: printf('%.6f %.6f', p.x, p.y)), ' ') end as line from ann where cls_id is not null) group by 1",
}
