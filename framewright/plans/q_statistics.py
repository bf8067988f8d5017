"""Queries of class statistics and edge filters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.operators import edge_filter as E
from framewright.operators import statistics as S
from framewright.operators.artifacts import balanced_sources, instances_by_class
from framewright.plans import views as V
from framewright.session import table

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


COUNTS = "cnt as (select dataset, cls_id, count(*) as n, count(distinct image_id) as images from ann where cls_id is not null group by 1, 2)"


@query("class_split_counts", V.with_(V.ANN) + "select dataset, cls_id, count(*) filter (split = 'train') as n_train, count(*) filter (split = 'val') as n_val, count(*) filter (split = 'test') as n_test, count(*) as n_total, count(distinct image_id) as n_images, round(count(*) / count(distinct image_id), 6) as per_image from ann where cls_id is not null group by 1, 2")
def _(s, d):
    return S.class_split_counts(V.annotations(s, d, "cls_id"))


@query("class_ids_by_name", "select name, case when count(distinct cls_id) = 1 then min(cls_id)::varchar else 'mixed(' || string_agg(distinct cls_id::varchar, ',' order by cls_id::varchar) || ')' end as id_set, n_datasets from (select name, cls_id, count(distinct dataset) over (partition by name) as n_datasets from classes where name is not null and cls_id is not null) group by name, n_datasets having count(distinct cls_id) = 1 union all select name, 'mixed(' || array_to_string(list_sort(list(distinct cls_id)), ',') || ')', count(distinct dataset) from classes where name is not null and cls_id is not null group by name having count(distinct cls_id) > 1")
def _(s, d):
    return S.class_ids_by_name(table(s, d, "classes"))


@query("class_imbalance", V.with_(V.ANN, COUNTS) + "select dataset, count(*) as n_classes, sum(n)::bigint as n_instances, round(max(n) / min(n), 6) as max_min, round(stddev_pop(n) / avg(n), 6) as cv, round(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) as gini, round(avg(n) / quantile_cont(n, 0.5), 6) as mean_median from (select *, row_number() over (partition by dataset order by n) as i from cnt) group by 1")
def _(s, d):
    c = V.annotations(s, d, "cls_id").where("cls_id is not null").groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))
    return S.imbalance(c, ["dataset"], "n")


@query("dataset_profile", V.with_(V.ANN, V.IMG, "known as (select distinct dataset, cls_id from classes where cls_id is not null)", "per as (select a.dataset, a.image_id, count(*) filter (kind = 'bbox') as b, count(*) filter (kind = 'segment') as s, count(*) filter (k.cls_id is null) as u from ann a left join known k on a.dataset = k.dataset and a.cls_id = k.cls_id group by 1, 2)", "x as (select coalesce(i.dataset, p.dataset) as dataset, i.image_id as f, i.split, p.b, p.s, p.u from img i full join per p on i.dataset = p.dataset and i.image_id = p.image_id)") + "select *, round(100.0 * empty_frames / greatest(n_frames, 1), 4) as empty_pct, case when unknown_ids + labels_without_frame = 0 then 'OK' else 'CHECK' end as quality from (select dataset, count(f) as n_frames, count(f) filter (split = 'train') as frames_train, count(f) filter (split = 'val') as frames_val, count(f) filter (split = 'test') as frames_test, count(f) filter (coalesce(b + s, 0) = 0) as empty_frames, sum(coalesce(b, 0))::bigint as n_boxes, sum(coalesce(s, 0))::bigint as n_polygons, sum(coalesce(u, 0))::bigint as unknown_ids, count(*) filter (f is null) as labels_without_frame from x group by 1)")
def _(s, d):
    return S.quality_flag(S.dataset_profile(V.frames(s, d, "split"), V.annotations(s, d, "cls_id", "kind"), table(s, d, "classes")))


@query("balance_ready", V.with_(V.ANN, COUNTS) + "select *, round(n_max / greatest(1, n_min), 6) as ratio, case when n_classes >= 2 and n_max / greatest(1, n_min) > 20 then 'hybrid' else 'weights' end as strategy from (select dataset, count(*) as n_classes, sum(n)::bigint as n_instances, max(n) as n_max, min(n) as n_min, quantile_cont(n, 0.5) as n_median, round(sum((1 - pow(0.999, n)) / (1 - 0.999)), 4) as effective, count(*) filter (n < 0.1 * top) as tail_classes, round(sum(case when n < 0.1 * top then n else 0 end) / sum(n), 6) as tail_share from (select *, max(n) over (partition by dataset) as top from cnt) group by 1)")
def _(s, d):
    return S.balance_ready(V.annotations(s, d, "cls_id"))


@query("dataset_compare", V.with_(V.ANN) + "select cls_id, count(*) filter (dataset = 'yard_north') as left_n, count(*) filter (dataset <> 'yard_north') as right_n, count(*) filter (dataset <> 'yard_north') - count(*) filter (dataset = 'yard_north') as delta, case when count(*) filter (dataset <> 'yard_north') = 0 then 'left_only' when count(*) filter (dataset = 'yard_north') = 0 then 'right_only' else 'common' end as side from ann where dataset in ('yard_north', 'mill_deep_00020') and cls_id is not null group by 1")
def _(s, d):
    return S.compare_datasets(V.annotations(s, d, "cls_id"), "yard_north", "mill_deep_00020")


@query("class_size_percentiles", V.with_(V.ANN, V.IMG, V.GEO) + "select cls_id, round(quantile_cont(w_px, 0.1), 6) as p10, round(quantile_cont(w_px, 0.5), 6) as p50, round(quantile_cont(w_px, 0.9), 6) as p90 from geo where cls_id is not null group by 1")
def _(s, d):
    return S.percentiles(V.geometries(s, d).where("cls_id is not null"), ["cls_id"], "w_px", [0.1, 0.5, 0.9])


@query("label_kinds", V.with_(V.ANN) + "select label_kind, count(*) as n_frames from (select dataset, image_id, case when count(*) filter (kind = 'bbox') = count(*) then 'bbox' when count(*) filter (kind = 'segment') = count(*) then 'segment' else 'mixed' end as label_kind from ann group by 1, 2) group by 1")
def _(s, d):
    return S.label_kinds(V.annotations(s, d, "kind")).groupBy("label_kind").agg(F.count(F.lit(1)).alias("n_frames"))


@query("presets_harness", V.with_(V.ANN, "cnt as (select dataset, cls_id, count(*) as n from ann where split = 'train' and cls_id is not null group by 1, 2)", "med as (select dataset, quantile_cont(n, 0.5) as med from cnt group by 1)", "p(preset, mult) as (values ('mild', 3.0), ('strong', 1.5))", "x as (select c.dataset, preset, n, least(n, greatest(1, floor(mult::double * med)))::bigint as after from cnt c join med using (dataset) cross join p)") + "select dataset, preset, sum(n)::bigint as before, sum(after)::bigint as after, round(max(after) / min(after), 6) as head_tail from x group by 1, 2")
def _(s, d):
    return S.presets_harness(V.annotations(s, d, "cls_id"), {"mild": 3.0, "strong": 1.5})


@query("empty_frames", V.with_(V.ANN, V.IMG) + "select dataset, image_id from img where image_id not in (select image_id from ann where cls_id is not null)")
def _(s, d):
    return E.prune_empty(V.frames(s, d, "split"), V.annotations(s, d, "cls_id")).select("dataset", "image_id")


@query("size_prune", V.with_(V.ANN, V.IMG, V.GEO) + "select cls_id, count(*) as n_kept from geo where not coalesce(w_px < 60 or h_px < 60, false) group by 1")
def _(s, d):
    return E.prune_small(V.geometries(s, d), 60, 60, "or").groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_kept"))


INSET = "(x1 >= 0.02 and y1 >= 0.02 and x2 <= 0.98 and y2 <= 0.98)"
ZONE = "(x1 <= 0.01 or y1 <= 0.01 or x2 >= 0.99 or y2 >= 0.99)"
BASE = f"""base as (select dataset, cls_id, n_all, n_inset, mode, {', '.join(f"round(case mode when 'inset' then quantile_cont_{v}_i{p} when 'non_edge_samples' then quantile_cont_{v}_z{p} end, 6) as {v}_p{p}" for v in 'wh' for p in (10, 25, 50, 90))}
 from (select *, case when n_inset >= 5 then 'inset' when n_clear >= 5 then 'non_edge_samples' else 'absolute_only' end as mode from (select dataset, cls_id, count(*) as n_all, count(*) filter ({INSET}) as n_inset, count(*) filter (not {ZONE}) as n_clear,
 {', '.join(f"quantile_cont({v}_px, {p / 100}) filter ({c}) as quantile_cont_{v}_{k}{p}" for v in 'wh' for p in (10, 25, 50, 90) for k, c in (('i', INSET), ('z', f'not {ZONE}')))} from geo where cls_id is not null group by 1, 2)))"""
SIZE = """med as (select dataset, cls_id, count(*) as n_all, quantile_cont(w_px, 0.5) as mw, quantile_cont(h_px, 0.5) as mh from geo where cls_id is not null group by 1, 2),
siz as (select g.dataset, g.cls_id, max(n_all) as n_all, round(0.5 * case when count(*) filter (w_px >= 0.5 * mw) >= 5 then quantile_cont(w_px, 0.25) filter (w_px >= 0.5 * mw) else quantile_cont(w_px, 0.25) end, 6) as min_w, round(0.5 * case when count(*) filter (h_px >= 0.5 * mh) >= 5 then quantile_cont(h_px, 0.25) filter (h_px >= 0.5 * mh) else quantile_cont(h_px, 0.25) end, 6) as min_h from geo g join med m on g.dataset = m.dataset and g.cls_id = m.cls_id group by 1, 2)"""
SEEN = "greatest(0.0, greatest(0.0, least(1.0, x2)) - greatest(0.0, least(1.0, x1))) * greatest(0.0, greatest(0.0, least(1.0, y2)) - greatest(0.0, least(1.0, y1))) / greatest((x2 - x1) * (y2 - y1), 1e-9)"
DECIDED = f"""decided as (select g.*, case when g.cls_id is not null and w_px is not null then coalesce(case when {ZONE} then case when {SEEN} < 0.5 then 'visibility' when w_px < 4 then 'abs_width' when w_px < 0.35 * w_p50 then 'rel_width' when h_px < 4 then 'abs_height' when h_px < 0.35 * h_p50 then 'rel_height' when w_px * h_px < 16 then 'min_area' when w_px > 0 and h_px > 0 and greatest(w_px / h_px, h_px / w_px) > 25 then 'max_aspect' end end, case when w_px < min_w and h_px < min_h then 'small_size' end) end as reason
 from geo g left join base b on g.dataset = b.dataset and g.cls_id = b.cls_id left join siz s on g.dataset = s.dataset and g.cls_id = s.cls_id)"""


@query("inset_baseline", V.with_(V.ANN, V.IMG, V.GEO, BASE) + "select * from base")
def _(s, d):
    return E.baseline(V.geometries(s, d))


@query("stable_size_baseline", V.with_(V.ANN, V.IMG, V.GEO, SIZE) + "select * from siz")
def _(s, d):
    return E.size_baseline(V.geometries(s, d))


@query("edge_filter_forecast", V.with_(V.ANN, V.IMG, V.GEO, BASE, SIZE, DECIDED) + "select dataset, reason, cls_id, grouping(cls_id)::int as all_classes, count(*) as n_labels, count(distinct image_id) as n_frames from (select dataset, coalesce(reason, 'kept') as reason, cls_id, image_id from decided) group by grouping sets ((dataset, reason, cls_id), (dataset, reason))")
def _(s, d):
    return E.forecast(E.decisions(V.geometries(s, d)))


@query("edge_filter_frames", V.with_(V.ANN, V.IMG, V.GEO, BASE, SIZE, DECIDED) + "select dataset, image_id, count(*) filter (reason is null) as kept, count(*) filter (reason is not null) as dropped, case when count(reason) = 0 then 'untouched' when count(reason) < count(*) then 'trimmed' else 'emptied' end as outcome from decided group by 1, 2")
def _(s, d):
    return E.frame_outcomes(E.decisions(V.geometries(s, d)))


@query("empirical_bounds", V.with_(V.ANN, V.IMG, V.GEO) + "select cls_id, width, height, count(*) as n, round(quantile_cont(x1, 0.05), 9) as x_low, round(quantile_cont(y1, 0.05), 9) as y_low, round(quantile_cont(x2, 0.95), 9) as x_high, round(quantile_cont(y2, 0.95), 9) as y_high from geo where cls_id is not null and not (x1 <= 0.002 or y1 <= 0.002 or x2 >= 0.998 or y2 >= 0.998) group by grouping sets ((cls_id, width, height), (cls_id))")
def _(s, d):
    return E.empirical_bounds(V.geometries(s, d), 0.05, 0.95)


@query("class_hull", V.with_(V.ANN, V.IMG, V.GEO) + "select dataset, cls_id, count(*) as n, round(min(x1), 6) as x1, round(min(y1), 6) as y1, round(max(x2), 6) as x2, round(max(y2), 6) as y2 from geo group by 1, 2")
def _(s, d):
    return E.hull(V.geometries(s, d), ["dataset", "cls_id"])


TILE = lambda c, t, st: f"list_distinct(list_concat(range(0, greatest(0, {c} - {t}) + 1, {st}), [greatest(0, {c} - {t})::bigint]))"
TILES = f"tiles as (select image_id, width, height, l::int as left_, t::int as top_ from (select image_id, width, height, l, unnest({TILE('height', 640, 512)}) as t from (select image_id, width, height, unnest({TILE('width', 640, 512)}) as l from img)))"


@query("tile_windows", V.with_(V.IMG, TILES) + "select width, height, left_ as left, top_ as top, least(left_ + 640, width) as right, least(top_ + 640, height) as bottom, count(*) as n from tiles group by all")
def _(s, d):
    return G.tiles(V.frames(s, d, "width", "height").select("image_id", "width", "height"), 640, 640, 0.2).groupBy("width", "height", "left", "top", "right", "bottom").agg(F.count(F.lit(1)).alias("n"))


@query("tile_annotations", V.with_(V.ANN, V.IMG, V.GEO, TILES, "c as (select g.cls_id, left_, top_, greatest(x1 * g.width, left_) as a, greatest(y1 * g.height, top_) as b, least(x2 * g.width, least(left_ + 640, g.width)) as c, least(y2 * g.height, least(top_ + 640, g.height)) as e from geo g join tiles t using (image_id))") + "select cls_id, left_ as left, top_ as top, count(*) as n, round(sum((c - a) * (e - b)), 2) as area from c where c > a and e > b group by all")
def _(s, d):
    t = G.tiles(V.frames(s, d, "width", "height").select("image_id", "width", "height"), 640, 640, 0.2).drop("width", "height")
    g = V.geometries(s, d).join(t, "image_id")
    box = tuple(F.col(c) * F.col(k) for c, k in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height")))
    g = g.withColumn("c", G.crop_box(box, (F.col("left"), F.col("top"), F.col("right"), F.col("bottom")))).where("c is not null")
    return g.groupBy("cls_id", "left", "top").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("c.w") * (F.col("right") - F.col("left")) * F.col("c.h") * (F.col("bottom") - F.col("top"))), 2).alias("area"))


@query("rotate_labels", V.with_(V.ANN) + "select image_id, line_no, round(1 - cy, 6) as cx, round(cx, 6) as cy, round(h, 6) as w, round(w, 6) as h from ann where kind = 'bbox'")
def _(s, d):
    return V.annotations(s, d, "kind", "cx", "cy", "w", "h").where("kind = 'bbox'").withColumn("r", G.rotate_quarter(F.col("cx"), F.col("cy"), F.col("w"), F.col("h"), 1)).select("image_id", "line_no", *[F.round(f"r.{c}", 6).alias(c) for c in ("cx", "cy", "w", "h")])


@query("frame_roi", V.with_(V.ANN, V.IMG, V.GEO) + "select image_id, round(min(x1) * any_value(width), 4) as x1, round(min(y1) * any_value(height), 4) as y1, round(max(x2) * any_value(width), 4) as x2, round(max(y2) * any_value(height), 4) as y2 from geo group by 1")
def _(s, d):
    return V.geometries(s, d).groupBy("image_id", "width", "height").agg(F.min("x1").alias("a"), F.min("y1").alias("b"), F.max("x2").alias("c"), F.max("y2").alias("e")).select("image_id", F.round(F.col("a") * F.col("width"), 4).alias("x1"), F.round(F.col("b") * F.col("height"), 4).alias("y1"), F.round(F.col("c") * F.col("width"), 4).alias("x2"), F.round(F.col("e") * F.col("height"), 4).alias("y2"))


@query("cvat_to_yolo", "select box_id, round((a + c) / 2, 11) as cx, round((b + d) / 2, 11) as cy, round(c - a, 11) as w, round(d - b, 11) as h from (select box_id, greatest(0.0, least(1.0, least(xtl, xbr) / 1920)) as a, greatest(0.0, least(1.0, least(ytl, ybr) / 1080)) as b, greatest(0.0, least(1.0, greatest(xtl, xbr) / 1920)) as c, greatest(0.0, least(1.0, greatest(ytl, ybr) / 1080)) as d from cvat_boxes) where c > a and d > b")
def _(s, d):
    b = table(s, d, "cvat_boxes").withColumn("r", G.cvat_box(F.col("xtl"), F.col("ytl"), F.col("xbr"), F.col("ybr"), F.lit(1920.0), F.lit(1080.0))).where("r is not null")
    return b.select("box_id", *[F.round(f"r.{c}", 11).alias(c) for c in ("cx", "cy", "w", "h")])


@query("balanced_sources", V.with_(V.IMG) + "select dataset, round(avg(regexp_matches(stem, 'bal_[0-9]+$')::int), 6) as share, avg(regexp_matches(stem, 'bal_[0-9]+$')::int) >= 0.6 as balanced from img where split is not null group by 1")
def _(s, d):
    return balanced_sources(V.frames(s, d, "split", "stem"))


@query("instances_by_class", V.with_(V.ANN) + "select dataset, split, cls_id, count(*) as n_instances, count(distinct image_id) as n_frames from ann where cls_id is not null group by 1, 2, 3")
def _(s, d):
    return instances_by_class(V.annotations(s, d, "cls_id"), ["dataset", "split"])
