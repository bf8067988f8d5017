"""Queries of the readers and writers: rows of the domain tables are written in a format below the shared folder and read back from it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.plans import views as V
from framewright.plans.core_problems import NUM
from framewright.session import table, work_folder
from framewright.sources import documents, labels, sinks

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


TOKENS = rf"""t as (select string_split_regex(regexp_replace(raw, '^\s+|\s+$', '', 'g'), '\s+') as c from label_lines where fmt = 'yolo' and raw is not null),
p as (select c, len(c) as n, try_cast(c[1] as int) is not null and regexp_full_match(c[1], '[+-]?[0-9]+') and (len(c) = 5 or (len(c) >= 7 and len(c) % 2 = 1)) and len(list_filter(c[2:], lambda x: not regexp_full_match(x, {NUM}))) = 0 as ok from t where c[1] <> '' and left(c[1], 1) <> '#')"""


@query("read_labels", f"with {TOKENS} select count(*) filter (ok) as n_valid, count(*) filter (not ok) as n_broken, count(*) filter (ok and n = 5) as n_boxes, count(*) filter (ok and n > 5) as n_polygons from p")
def _(s, d):
    root = work_folder(s, "labels")
    table(s, d, "label_lines").where("fmt = 'yolo' and raw is not null").select("raw").write.option("lineSep", "\n").format("text").save(f"{root}/train/labels")
    return labels.label_profile(labels.read_labels(s, root)).agg(*[F.sum(c).alias(c) for c in ("n_valid", "n_broken", "n_boxes", "n_polygons")])


@query("read_predictions", V.with_(V.ANN, V.IMG, V.GEO, V.EVAL) + "select cls_id, count(*) as n, round(sum(conf), 4) as conf, round(sum(x2 - x1), 2) as wide from pred group by 1")
def _(s, d):
    root = work_folder(s, "predictions")
    p = V.predictions(s, d)
    one = F.struct("pred_idx", F.col("cls_id").alias("cls"), "conf", F.array("x1", "y1", "x2", "y2").alias("box"))
    p.groupBy(F.col("image_id").alias("image")).agg(F.array_sort(F.collect_list(one)).alias("predictions")).write.json(root)
    return documents.read_predictions(s, root).groupBy("cls_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("conf"), 4).alias("conf"), F.round(F.sum(F.col("x2") - F.col("x1")), 2).alias("wide"))


@query("cvat_round_trip", V.with_(V.ANN, V.IMG) + "select 'id_' || a.cls_id as label, kind, count(*) as n from ann a join img using (image_id) where a.cls_id is not null and ((kind = 'bbox' and least(1.0, round((cx + w / 2) * width, 2) / width) > greatest(0.0, round((cx - w / 2) * width, 2) / width) and least(1.0, round((cy + h / 2) * height, 2) / height) > greatest(0.0, round((cy - h / 2) * height, 2) / height)) or (kind = 'segment' and len(points) >= 3)) group by 1, 2")
def _(s, d):
    root = work_folder(s, "cvat")
    f = V.frames(s, d, "width", "height").select("image_id", "width", "height")
    x = V.annotations(s, d, "kind", "cls_id", "cx", "cy", "w", "h", "points").where("cls_id is not null").join(f, "image_id")
    sinks.write_cvat(x, s.createDataFrame([], "cls_id int, name string"), root, "task")
    return documents.read_cvat(s, root).groupBy("label", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("read_metrics", rf"""with f as (select raw_path, any_value(body) as body from metric_files where raw_path like '%.csv' and body is not null group by 1),
l as (select raw_path, list_filter(string_split_regex(replace(body, chr(65279), ''), '\r\n|\n|\r'), lambda x: trim(x) <> '') as l from f),
r as (select raw_path, string_split(l[1], ',') as h, unnest(l[2:]) as line from l where len(l) > 1),
c as (select raw_path, trim(h[i]) as metric, trim(string_split(line, ',')[i]) as v from (select raw_path, h, line, unnest(range(1, len(h) + 1)) as i from r))
select metric, count(*) as n, round(sum(v::double), 4) as total from c where regexp_full_match(v, {NUM}) and lower(metric) <> 'class' group by 1""")
def _(s, d):
    root = work_folder(s, "metrics")
    # One file per row: the reader takes each file whole, by its own header.
    once = table(s, d, "metric_files").where("raw_path like '%.csv' and body is not null").groupBy("raw_path").agg(F.max("body").alias("content"))
    parts = once.select(F.concat(F.md5("raw_path"), F.lit(".csv")).alias("rel_path"), "content")
    sinks.write_texts(parts, root.removeprefix("file:"))
    return documents.read_metrics_csv(s, root).where(F.lower("metric") != "class").groupBy("metric").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
