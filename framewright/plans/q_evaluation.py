"""Queries of detection evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import evaluation as E
from framewright.operators.artifacts import overlay
from framewright.plans import views as V
from framewright.session import cut_lineage

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


WIDE = "(least(p.x2, g.x2) - greatest(p.x1, g.x1))"
HIGH = "(least(p.y2, g.y2) - greatest(p.y1, g.y1))"
PAIRS = f"pairs as (select p.image_id, p.cls_id, pred_idx, gt_idx, conf, round(case when {WIDE} > 0 and {HIGH} > 0 then {WIDE} * {HIGH} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {WIDE} * {HIGH}) else 0.0 end, 9) as iou from pred p join gt g on p.image_id = g.image_id and p.cls_id = g.cls_id)"
BEST = "best as (select * from pairs cross join (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as thr) where iou >= thr qualify row_number() over (partition by thr, image_id, cls_id, pred_idx order by iou desc, gt_idx) = 1), m as (select * from best qualify row_number() over (partition by thr, image_id, cls_id, gt_idx order by pred_idx) = 1)"
BASE = V.with_(V.ANN, V.IMG, V.GEO, V.EVAL, PAIRS, BEST)
FLAGS = "flags as (select p.image_id, p.cls_id, p.pred_idx, p.conf, m.iou, (m.iou is not null)::int as tp from pred p left join m on m.thr = 0.5 and m.image_id = p.image_id and m.cls_id = p.cls_id and m.pred_idx = p.pred_idx), ngt as (select cls_id, count(*) as n_gt from gt group by 1)"
CURVE = "bins as (select cls_id, floor(conf * 50 + 1e-9)::int as grid, count(*) as n, sum(tp) as t, sum(case when tp = 1 then 1 - iou else 0.0 end) as e from flags group by 1, 2), curve as (select cls_id, grid, n_gt, tp::bigint as tp, (n - tp)::bigint as fp, (n_gt - tp)::bigint as fn, round(loc, 6) as loc, round(case when n > 0 then tp / n end, 6) as precision, round(tp / n_gt, 6) as recall from (select g.cls_id, g.grid, n_gt, coalesce(sum(n) over w, 0) as n, coalesce(sum(t) over w, 0) as tp, coalesce(sum(e) over w, 0) as loc from (select cls_id, n_gt, unnest(range(0, 51))::int as grid from ngt) g left join bins b on g.cls_id = b.cls_id and g.grid = b.grid window w as (partition by g.cls_id order by g.grid desc)))"
PR = "pr as (select *, max(precision) over (partition by cls_id order by pos desc) as envelope from (select cls_id, n_gt, tp, pos, sum(tp) over (partition by cls_id order by pos) / n_gt as recall, sum(tp) over (partition by cls_id order by pos) / (pos + 1) as precision from (select f.*, n_gt, row_number() over (partition by f.cls_id order by conf desc, image_id, pred_idx) - 1 as pos from flags f join ngt using (cls_id))))"


def tables(s, d):
    # Both sides derive from the same label lines: written once, read by every later step.
    return cut_lineage(V.predictions(s, d)), cut_lineage(V.ground_truth(s, d))


def flags(s, d):
    p, g = tables(s, d)
    return E.flagged(p, E.matches(E.iou_pairs(p, g, 0.5), (0.5,)), 0.5), g


@query("iou_pairs", BASE + "select cls_id, count(*) as n, round(avg(iou), 5) as mean_iou from pairs where iou >= 0.5 group by 1")
def _(s, d):
    return E.iou_pairs(*tables(s, d), 0.5).groupBy("cls_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("iou"), 5).alias("mean_iou"))


@query("match_two_window", BASE + "select thr, cls_id, count(*) as tp, round(avg(iou), 5) as mean_iou from m group by 1, 2")
def _(s, d):
    return E.matches(E.iou_pairs(*tables(s, d), 0.5)).groupBy("thr", "cls_id").agg(F.count(F.lit(1)).alias("tp"), F.round(F.avg("iou"), 5).alias("mean_iou"))


@query("pr_curve_ap", BASE.rstrip() + ",\n" + FLAGS + "," + PR + " select cls_id, round(sum(case when tp = 1 then envelope / n_gt else 0.0 end), 6) as ap from pr group by 1")
def _(s, d):
    f, g = flags(s, d)
    return E.average_precision(E.pr_points(f, g))


@query("pr_recall_grid", BASE.rstrip() + ",\n" + FLAGS + "," + PR + ", top as (select cls_id, least(100, floor(recall * 100 + 1e-9))::int as grid, max(precision) as p from pr group by 1, 2) select e.cls_id, e.grid, round(coalesce(max(p) over (partition by e.cls_id order by e.grid desc), 0.0), 6) as precision from (select distinct cls_id, unnest(range(0, 101))::int as grid from (select distinct cls_id from pr)) e left join top t on e.cls_id = t.cls_id and e.grid = t.grid")
def _(s, d):
    f, g = flags(s, d)
    return E.recall_grid(E.pr_points(f, g))


@query("map_by_threshold", BASE.rstrip() + ",\n ngt as (select cls_id, count(*) as n_gt from gt group by 1), f as (select t.thr, p.cls_id, p.conf, p.image_id, p.pred_idx, (m.iou is not null)::int as tp from pred p cross join (select distinct thr from (select unnest([0.5, 0.55, 0.6, 0.65, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95])::double as thr)) t left join m on m.thr = t.thr and m.image_id = p.image_id and m.cls_id = p.cls_id and m.pred_idx = p.pred_idx), o as (select f.*, n_gt, row_number() over w as pos, sum(tp) over w as hits from f join ngt using (cls_id) window w as (partition by thr, f.cls_id order by conf desc, image_id, pred_idx)), e as (select thr, cls_id, n_gt, tp, max(hits / pos) over (partition by thr, cls_id order by pos desc) as env from o), ap as (select thr, cls_id, round(sum(case when tp = 1 then env / n_gt else 0.0 end), 6) as ap from e group by 1, 2) select thr, count(*) as n_classes, round(avg(ap), 5) as map from ap group by 1")
def _(s, d):
    return E.map_by_threshold(*tables(s, d))


@query("threshold_curves", BASE.rstrip() + ",\n" + FLAGS + "," + CURVE + " select * from curve")
def _(s, d):
    return E.threshold_curves(*flags(s, d))


FB = lambda b: f"round(case when {b * b} * precision + recall > 0 then {1 + b * b} * precision * recall / ({b * b} * precision + recall) end, 9)"
REC = " union all ".join(f"select '{o}' as objective, level, case when s > 0 then round(-g / 50, 2) else 0.25 end as conf, case when s > 0 then round(s, 6) end as score from (select level, max(coalesce({FB(b)}, -1.0)) as s, arg_max(-grid, (coalesce({FB(b)}, -1.0), -grid)) as g from lv group by 1)" for o, b in (("A", 1.0), ("B", 2.0), ("C", 0.5)))


@query("confidence_recommendations", BASE.rstrip() + ",\n" + FLAGS + "," + CURVE + ", lv as (select cls_id::varchar as level, grid, precision, recall from curve union all select 'macro', grid, avg(precision), avg(recall) from curve group by 2 union all select 'weighted', grid, sum(n_gt * precision) / sum(n_gt), sum(n_gt * recall) / sum(n_gt) from curve where precision is not null group by 2) " + REC)
def _(s, d):
    return E.confidence_recommendations(E.threshold_curves(*flags(s, d)))


@query("confidence_pivot", BASE.rstrip() + ",\n" + FLAGS + "," + CURVE + ", lv as (select cls_id::varchar as level, grid, precision, recall from curve union all select 'macro', grid, avg(precision), avg(recall) from curve group by 2 union all select 'weighted', grid, sum(n_gt * precision) / sum(n_gt), sum(n_gt * recall) / sum(n_gt) from curve where precision is not null group by 2), rec as (" + REC + ') select level, max(conf) filter (objective = \'A\') as "A", max(conf) filter (objective = \'B\') as "B", max(conf) filter (objective = \'C\') as "C" from rec group by 1')
def _(s, d):
    r = E.confidence_recommendations(E.threshold_curves(*flags(s, d)))
    return r.groupBy("level").pivot("objective", ["A", "B", "C"]).agg(F.first("conf"))


@query("optimal_lrp", BASE.rstrip() + ",\n" + FLAGS + "," + CURVE + ", x as (select *, round(case when tp + fp + fn > 0 then (loc / 0.5 + fp + fn) / (tp + fp + fn) end, 9) as lrp from (select cls_id::varchar as level, grid, tp, fp, fn, loc from curve union all select 'pooled', grid, sum(tp), sum(fp), sum(fn), sum(loc) from curve group by 2)) select level, round(lrp, 6) as lrp, round(grid / 50, 2) as conf from x where lrp is not null qualify row_number() over (partition by level order by lrp, grid) = 1")
def _(s, d):
    return E.optimal_lrp(E.threshold_curves(*flags(s, d)))


@query("global_scores", BASE.rstrip() + ",\n" + FLAGS + ", k as (select count(*) as n, coalesce(sum(tp), 0)::bigint as tp, (select count(*) from gt) as n_gt from flags where conf >= 0.25) select tp, n - tp as fp, n_gt - tp as fn, round(tp / (n + 1e-9), 6) as precision, round(tp / (n_gt + 1e-9), 6) as recall, round(2 * (tp / (n + 1e-9)) * (tp / (n_gt + 1e-9)) / (tp / (n + 1e-9) + tp / (n_gt + 1e-9) + 1e-9), 6) as f1 from k")
def _(s, d):
    return E.global_scores(*flags(s, d), 0.25)


@query("best_iou_histogram", BASE.rstrip() + ",\n bi as (select image_id, cls_id, pred_idx, max(iou) as iou from pairs where iou >= 1e-9 group by 1, 2, 3) select p.cls_id, least(9, floor(coalesce(iou, 0.0) * 10))::int as bin, count(*) as n from pred p left join bi using (image_id, cls_id, pred_idx) group by 1, 2")
def _(s, d):
    return E.best_iou_histogram(*tables(s, d))


# Greedy steps of all images side by side: the n-th prediction of each image takes its best truth that is still free.
GREEDY = lambda base, pred, key, thr: (
    base.replace("with ", "with recursive ", 1).rstrip() + f""",
pr_ as (select *, row_number() over (partition by image_id order by conf desc, pred_idx) as rn from {pred}),
cand as (select p.image_id, p.rn, p.pred_idx, p.cls_id, list({{'g': c.gt_idx, 'c': c.gt_cls}} order by c.iou desc, c.gt_idx) filter (c.iou >= {thr}) as cands from pr_ p left join (select p.image_id, p.pred_idx, g.gt_idx, g.cls_id as gt_cls, case when {WIDE} > 0 and {HIGH} > 0 then {WIDE} * {HIGH} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {WIDE} * {HIGH}) else 0.0 end as iou from pred p join gt g on p.image_id = g.image_id and {key}) c on c.image_id = p.image_id and c.pred_idx = p.pred_idx group by 1, 2, 3, 4),
walk as (select distinct image_id, 0::bigint as rn, []::int[] as used, null::int as pred_idx, null::int as pred_cls, null::int as gt_idx, null::int as gt_cls from pr_
 union all select image_id, rn, case when pick is null then used else list_append(used, pick.g) end, pred_idx, cls_id, pick.g, pick.c from (select w.image_id, c.rn, w.used, c.pred_idx, c.cls_id, list_filter(c.cands, lambda x: not list_contains(w.used, x.g))[1] as pick from walk w join cand c on c.image_id = w.image_id and c.rn = w.rn + 1)),
done as (select image_id, pred_idx, pred_cls, gt_idx, gt_cls from walk where rn > 0 union all select image_id, null, null, gt_idx, cls_id from gt g where not exists (select 1 from walk w where w.image_id = g.image_id and w.gt_idx = g.gt_idx))"""
)


@query("match_greedy", GREEDY(BASE, "pred", "p.cls_id = g.cls_id", 0.5) + " select coalesce(gt_cls, pred_cls)::bigint as cls_id, count(*) filter (pred_idx is not null and gt_idx is not null) as tp, count(*) filter (gt_idx is null) as fp, count(*) filter (pred_idx is null) as fn from done group by 1")
def _(s, d):
    m = E.greedy_matches(*tables(s, d), 0.5)
    return m.groupBy(F.coalesce("gt_cls", "pred_cls").alias("cls_id")).agg(F.count("iou").alias("tp"), F.count_if(F.col("gt_idx").isNull()).alias("fp"), F.count_if(F.col("pred_idx").isNull()).alias("fn"))


@query("confusion_matrix", GREEDY(BASE, "(select * from pred where conf >= 0.25)", "true", 0.45) + " select coalesce(gt_cls, -1)::bigint as true_cls, coalesce(pred_cls, -1)::bigint as pred_cls, count(*) as n, round(count(*) / greatest(1, sum(count(*)) over (partition by coalesce(gt_cls, -1))), 6) as share from done group by 1, 2, coalesce(gt_cls, -1)")
def _(s, d):
    p, g = tables(s, d)
    return E.confusion(E.greedy_matches(p.where("conf >= 0.25"), g, 0.45, by_class=False))


NMS = (
    BASE.replace("with ", "with recursive ", 1).rstrip() + f""",
pr_ as (select *, row_number() over (partition by image_id order by conf desc, pred_idx) as rn from pred),
block as (select p.image_id, p.rn, list(g.rn) as by_ from pr_ p join pr_ g on p.image_id = g.image_id and p.cls_id = g.cls_id and g.rn < p.rn where case when {WIDE} > 0 and {HIGH} > 0 then {WIDE} * {HIGH} / ((p.x2 - p.x1) * (p.y2 - p.y1) + (g.x2 - g.x1) * (g.y2 - g.y1) - {WIDE} * {HIGH}) else 0.0 end > 0.3 group by 1, 2),
walk as (select distinct image_id, 0::bigint as rn, []::bigint[] as kept, null::int as cls_id, false as stays from pr_
 union all select w.image_id, p.rn, case when len(w.kept) < 300 and not coalesce(list_has_any(w.kept, b.by_), false) then list_append(w.kept, p.rn) else w.kept end, p.cls_id, len(w.kept) < 300 and not coalesce(list_has_any(w.kept, b.by_), false) from walk w join pr_ p on p.image_id = w.image_id and p.rn = w.rn + 1 left join block b on b.image_id = p.image_id and b.rn = p.rn)"""
)


@query("nms", NMS + " select cls_id, count(*) as n_kept from walk where stays group by 1")
def _(s, d):
    return E.nms(tables(s, d)[0], 0.3).groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_kept"))


@query("pr_trapezoid", BASE.rstrip() + ",\n" + FLAGS + "," + PR + ", top as (select cls_id, least(100, floor(recall * 100 + 1e-9))::int as grid, max(precision) as p from pr group by 1, 2), g as (select e.cls_id, e.grid, round(coalesce(max(p) over (partition by e.cls_id order by e.grid desc), 0.0), 6) as precision from (select distinct cls_id, unnest(range(0, 101))::int as grid from (select distinct cls_id from pr)) e left join top t on e.cls_id = t.cls_id and e.grid = t.grid) select cls_id, round(sum(a), 6) as area from (select cls_id, (grid / 100.0 - lag(grid) over w / 100.0) * (precision + lag(precision) over w) / 2 as a from g window w as (partition by cls_id order by grid)) group by 1")
def _(s, d):
    f, g = flags(s, d)
    x = E.recall_grid(E.pr_points(f, g)).withColumn("recall", F.col("grid") / 100.0)
    return E.trapezoid(x, ["cls_id"], "recall", "precision")


@query("overlay", BASE.rstrip() + ",\n v as (select image_id, cls_id, count(*) filter (g) as g, count(*) filter (not g) as p from (select image_id, cls_id, true as g from gt union all select image_id, cls_id, false from pred) group by 1, 2), o as (select image_id, sum(g) as n_gt, sum(p) as n_pred, count(*) filter (p = 0) as gt_only, count(*) filter (g = 0) as pred_only from v group by 1) select image_id, coalesce(n_gt, 0)::bigint as n_gt, coalesce(n_pred, 0)::bigint as n_pred, coalesce(gt_only, 0) as gt_only, coalesce(pred_only, 0) as pred_only from (select image_id from img where split in ('val', 'test')) left join o using (image_id)")
def _(s, d):
    p, g = tables(s, d)
    return overlay(V.frames(s, d, "split").where("split in ('val', 'test')"), g, p)
