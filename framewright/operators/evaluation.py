"""Detection evaluation: IoU matching, precision/recall, AP, thresholds, confusion.

Predictions and truths meet by equi-join on (image, class) with the IoU as residual condition; groups are one image's boxes and stay
small. Curves over a class run through distributed prefix sums (a class may hold a third of all boxes); threshold grids use a
histogram of confidences and 51 running totals instead of one pass per threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.geometry import iou
from framewright.operators.ordered import numbered
from framewright.session import cut_lineage

# The IoU thresholds of mAP50-95, and the points of the confidence grid.
THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
GRID = 50
BLOCK = 10_000


def box(prefix: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x1", "y1", "x2", "y2"))


def iou_pairs(pred: DataFrame, gt: DataFrame, least: float, keys: tuple[str, ...] = ("image_id", "cls_id")) -> DataFrame:
    """keys, pred_idx, gt_idx, conf, iou of every prediction and truth of one image and class with IoU of at least `least`."""
    g = gt.select(*keys, "gt_idx", *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    both = pred.select(*keys, "pred_idx", "conf", "x1", "y1", "x2", "y2").join(g, list(keys))
    return both.withColumn("iou", F.round(iou(box(), box("g_")), 9)).where(F.col("iou") >= least).select(*keys, "pred_idx", "gt_idx", "conf", "iou")


def matches(pairs: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Assignment by two windows per threshold: the best truth of each prediction, then the lowest prediction of each truth."""
    t = pairs.withColumn("thr", F.explode(F.array(*[F.lit(x) for x in thresholds]))).where("iou >= thr")
    best = t.withColumn("_n", F.row_number().over(Window.partitionBy("thr", "image_id", "cls_id", "pred_idx").orderBy(F.desc("iou"), "gt_idx"))).where("_n = 1")
    one = best.withColumn("_n", F.row_number().over(Window.partitionBy("thr", "image_id", "cls_id", "gt_idx").orderBy("pred_idx"))).where("_n = 1")
    return one.drop("_n")


def flagged(pred: DataFrame, matched: DataFrame, thr: float) -> DataFrame:
    """Predictions with tp (0 or 1) and the IoU of their match at one threshold."""
    m = matched.where(F.col("thr") == thr).select("image_id", "cls_id", "pred_idx", "iou")
    return pred.select("image_id", "cls_id", "pred_idx", "conf").join(m, ["image_id", "cls_id", "pred_idx"], "left").withColumn("tp", F.col("iou").isNotNull().cast("int"))


def pr_points(flags: DataFrame, gt: DataFrame) -> DataFrame:
    """Per class, in order of confidence: precision, recall and the envelope (largest precision from here on)."""
    truths = gt.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_gt"))
    p = numbered(flags.withColumn("_o", -F.col("conf")), ["cls_id"], ["_o", "image_id", "pred_idx"], "tp").join(truths, "cls_id")
    hits = F.col("cum") + F.col("tp")
    p = p.withColumn("recall", hits / F.col("n_gt")).withColumn("precision", hits / (F.col("pos") + 1)).withColumn("_b", F.floor(F.col("pos") / BLOCK))
    top = p.groupBy("cls_id", "_b").agg(F.max("precision").alias("_m"))
    later = Window.partitionBy("cls_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    top = top.withColumn("_later", F.max("_m").over(later)).drop("_m")
    rest = Window.partitionBy("cls_id", "_b").orderBy(F.desc("pos"))
    p = p.join(top, ["cls_id", "_b"]).withColumn("envelope", F.greatest(F.max("precision").over(rest), F.col("_later")))
    return p.select("cls_id", "image_id", "pred_idx", "conf", "pos", "tp", "n_gt", "recall", "precision", "envelope")


def average_precision(points: DataFrame) -> DataFrame:
    """Area under the envelope: each true positive adds a recall step of 1 / truths at its envelope."""
    return points.groupBy("cls_id").agg(F.round(F.sum(F.when(F.col("tp") == 1, F.col("envelope") / F.col("n_gt")).otherwise(0.0)), 6).alias("ap"))


def recall_grid(points: DataFrame, n: int = 101) -> DataFrame:
    """Envelope at each of n recall points per class: the largest precision with at least that recall, 0 beyond the last."""
    step = F.least(F.lit(n - 1), F.floor(F.col("recall") * (n - 1) + 1e-9))
    top = points.groupBy("cls_id", step.cast("int").alias("grid")).agg(F.max("precision").alias("p"))
    every = points.select("cls_id").distinct().withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    w = Window.partitionBy("cls_id").orderBy(F.desc("grid"))  # n rows
    return every.join(top, ["cls_id", "grid"], "left").withColumn("precision", F.round(F.coalesce(F.max("p").over(w), F.lit(0.0)), 6)).drop("p")


def map_by_threshold(pred: DataFrame, gt: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """Per threshold: mean AP over the classes that have predictions and truths.

    Predictions are numbered once for all thresholds. The envelope only ever rises at a true positive, so from there on only the true
    positives of each threshold are followed.
    """
    pred = cut_lineage(pred)
    hits = matches(iou_pairs(pred, gt, min(thresholds)), thresholds).select("thr", "image_id", "cls_id", "pred_idx")
    place = numbered(pred.select("image_id", "cls_id", "pred_idx", (-F.col("conf")).alias("_o")), ["cls_id"], ["_o", "image_id", "pred_idx"]).select("image_id", "cls_id", "pred_idx", F.col("pos").alias("place"))
    true = numbered(place.join(hits, ["image_id", "cls_id", "pred_idx"]), ["thr", "cls_id"], ["place"])
    true = true.withColumn("precision", (F.col("pos") + 1) / (F.col("place") + 1)).withColumn("_b", F.floor(F.col("pos") / BLOCK))
    later = Window.partitionBy("thr", "cls_id").orderBy(F.desc("_b")).rowsBetween(Window.unboundedPreceding, -1)
    top = true.groupBy("thr", "cls_id", "_b").agg(F.max("precision").alias("_m")).withColumn("_later", F.max("_m").over(later)).drop("_m")
    rest = Window.partitionBy("thr", "cls_id", "_b").orderBy(F.desc("pos"))
    area = true.join(top, ["thr", "cls_id", "_b"]).withColumn("envelope", F.greatest(F.max("precision").over(rest), F.col("_later"))).groupBy("thr", "cls_id").agg(F.sum("envelope").alias("area"))
    truths = gt.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_gt")).join(pred.select("cls_id").distinct(), "cls_id")
    every = truths.withColumn("thr", F.explode(F.array(*[F.lit(x) for x in thresholds])))
    ap = every.join(area, ["thr", "cls_id"], "left").withColumn("ap", F.round(F.coalesce("area", F.lit(0.0)) / F.col("n_gt"), 6))
    return ap.groupBy(F.round("thr", 2).alias("thr")).agg(F.count(F.lit(1)).alias("n_classes"), F.round(F.avg("ap"), 5).alias("map"))


def threshold_curves(flags: DataFrame, gt: DataFrame) -> DataFrame:
    """Per class and confidence grid point: tp, fp, fn, sum of 1 - IoU, precision, recall, from one histogram and running totals."""
    bins = flags.withColumn("grid", F.floor(F.col("conf") * GRID + 1e-9).cast("int")).groupBy("cls_id", "grid").agg(F.count(F.lit(1)).alias("n"), F.sum("tp").alias("t"), F.sum(F.when(F.col("tp") == 1, 1 - F.col("iou")).otherwise(0.0)).alias("e"))
    truths = gt.groupBy("cls_id").agg(F.count(F.lit(1)).alias("n_gt"))
    grid = truths.withColumn("grid", F.explode(F.sequence(F.lit(0), F.lit(GRID))))
    w = Window.partitionBy("cls_id").orderBy(F.desc("grid"))  # 51 rows
    total = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0))
    x = grid.join(bins, ["cls_id", "grid"], "left").select("cls_id", "grid", "n_gt", total("n").alias("n"), total("t").alias("tp"), total("e").alias("loc"))
    x = x.withColumn("fp", F.col("n") - F.col("tp")).withColumn("fn", F.col("n_gt") - F.col("tp"))
    return x.select("cls_id", "grid", "n_gt", "tp", "fp", "fn", F.round("loc", 6).alias("loc"), F.round(F.when(F.col("n") > 0, F.col("tp") / F.col("n")), 6).alias("precision"), F.round(F.col("tp") / F.col("n_gt"), 6).alias("recall"))


def f_beta(p: Column, r: Column, beta: float) -> Column:
    b2 = beta * beta
    return F.when(b2 * p + r > 0, (1 + b2) * p * r / (b2 * p + r))


def confidence_recommendations(curves: DataFrame, fallback: float = 0.25) -> DataFrame:
    """Per objective (A: F1, B: F2, C: F0.5) and class, macro and support-weighted: the first best confidence."""
    levels = curves.select(F.col("cls_id").cast("string").alias("level"), "grid", "precision", "recall")
    w = F.col("n_gt")
    both = curves.where("precision is not null")
    macro = curves.groupBy("grid").agg(F.avg("precision").alias("precision"), F.avg("recall").alias("recall")).select(F.lit("macro").alias("level"), "grid", "precision", "recall")
    weighted = both.groupBy("grid").agg((F.sum(w * F.col("precision")) / F.sum(w)).alias("precision"), (F.sum(w * F.col("recall")) / F.sum(w)).alias("recall")).select(F.lit("weighted").alias("level"), "grid", "precision", "recall")
    every = levels.unionByName(macro).unionByName(weighted)
    out = None
    for name, beta in (("A", 1.0), ("B", 2.0), ("C", 0.5)):
        score = F.round(f_beta(F.col("precision"), F.col("recall"), beta), 9)
        best = every.groupBy("level").agg(F.max(F.struct(F.coalesce(score, F.lit(-1.0)).alias("s"), (-F.col("grid")).alias("g"))).alias("b"))
        got = best.select(F.lit(name).alias("objective"), "level", F.when(F.col("b.s") > 0, F.round(-F.col("b.g") / GRID, 2)).otherwise(F.lit(fallback)).alias("conf"), F.when(F.col("b.s") > 0, F.round("b.s", 6)).alias("score"))
        out = got if out is None else out.unionByName(got)
    return out


def lrp(tp: Column, fp: Column, fn: Column, loc: Column, thr: float) -> Column:
    n = tp + fp + fn
    return F.when(n > 0, (loc / max(1e-12, 1 - thr) + fp + fn) / n)


def optimal_lrp(curves: DataFrame, thr: float = 0.5) -> DataFrame:
    """Per class and pooled: the least LRP over the grid and the first confidence that has it."""
    pooled = curves.groupBy("grid").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "loc")]).select(F.lit("pooled").alias("level"), "grid", "tp", "fp", "fn", "loc")
    x = curves.select(F.col("cls_id").cast("string").alias("level"), "grid", "tp", "fp", "fn", "loc").unionByName(pooled)
    x = x.withColumn("lrp", F.round(lrp(F.col("tp"), F.col("fp"), F.col("fn"), F.col("loc"), thr), 9))
    best = x.where("lrp is not null").groupBy("level").agg(F.min(F.struct("lrp", "grid")).alias("b"))
    return best.select("level", F.round("b.lrp", 6).alias("lrp"), F.round(F.col("b.grid") / GRID, 2).alias("conf"))


def global_scores(flags: DataFrame, gt: DataFrame, conf: float) -> DataFrame:
    """Micro precision, recall and F1 at a confidence."""
    kept = flags.where(F.col("conf") >= conf).agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("tp"), F.lit(0)).alias("tp"))
    x = kept.crossJoin(gt.agg(F.count(F.lit(1)).alias("n_gt")))  # one row each
    p, r = F.col("tp") / (F.col("n") + 1e-9), F.col("tp") / (F.col("n_gt") + 1e-9)
    return x.select("tp", (F.col("n") - F.col("tp")).alias("fp"), (F.col("n_gt") - F.col("tp")).alias("fn"), F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * p * r / (p + r + 1e-9), 6).alias("f1"))


def best_iou_histogram(pred: DataFrame, gt: DataFrame) -> DataFrame:
    """Per class: predictions by their best IoU with a truth of the class, in ten bins (the last one closed)."""
    best = iou_pairs(pred, gt, 1e-9).groupBy("image_id", "cls_id", "pred_idx").agg(F.max("iou").alias("iou"))
    every = pred.select("image_id", "cls_id", "pred_idx").join(best, ["image_id", "cls_id", "pred_idx"], "left")
    return every.groupBy("cls_id", F.least(F.lit(9), F.floor(F.coalesce("iou", F.lit(0.0)) * 10)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def iou_matrix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    w = np.minimum(a[:, None, 2], b[None, :, 2]) - np.maximum(a[:, None, 0], b[None, :, 0])
    h = np.minimum(a[:, None, 3], b[None, :, 3]) - np.maximum(a[:, None, 1], b[None, :, 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0.0)
    area = lambda x: (x[:, 2] - x[:, 0]) * (x[:, 3] - x[:, 1])
    return inter / np.maximum(area(a)[:, None] + area(b)[None, :] - inter, 1e-12)


def greedy_matches(pred: DataFrame, gt: DataFrame, thr: float, by_class: bool = True) -> DataFrame:
    """Greedy assignment within an image (and class): predictions by falling confidence take the best free truth with IoU >= thr.

    Overlaps are found by an equi-join; the pass over one image's predictions is a fold over a sorted array, so it stays in the JVM and
    no image costs a call into Python. image_id, pred_idx, conf, pred_cls, gt_idx, gt_cls, iou; unmatched rows of either side have nulls.
    """
    g = gt.select("image_id", F.col("gt_idx").cast("long").alias("gt_idx"), F.col("cls_id").cast("long").alias("gt_cls"), *[F.col(c).alias(f"g_{c}") for c in ("x1", "y1", "x2", "y2")])
    p = pred.select("image_id", F.col("pred_idx").cast("long").alias("pred_idx"), "conf", F.col("cls_id").cast("long").alias("pred_cls"), "x1", "y1", "x2", "y2")
    on = (F.col("p.image_id") == F.col("g.image_id")) & ((F.col("p.pred_cls") == F.col("g.gt_cls")) if by_class else F.lit(True))
    both = p.alias("p").join(g.alias("g"), on).withColumn("iou", iou(box(), box("g_"))).where(F.col("iou") >= thr)
    near = both.groupBy("p.image_id", "pred_idx").agg(F.array_sort(F.collect_list(F.struct((-F.col("iou")).alias("d"), "gt_idx", "gt_cls"))).alias("near"))
    one = p.join(near, ["image_id", "pred_idx"], "left").select("image_id", F.struct((-F.col("conf")).alias("o"), "pred_idx", "conf", "pred_cls", "near").alias("p"))
    images = one.groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    step = """aggregate(ps, named_struct('used', cast(array() as array<bigint>), 'out', cast(array() as array<struct<gt_idx:bigint,gt_cls:bigint,iou:double>>)), (s, p) ->
      transform(array(get(filter(coalesce(p.near, cast(array() as array<struct<d:double,gt_idx:bigint,gt_cls:bigint>>)), c -> not array_contains(s.used, c.gt_idx)), 0)), k ->
        named_struct('used', if(k is null, s.used, array_append(s.used, k.gt_idx)), 'out', array_append(s.out, named_struct('gt_idx', k.gt_idx, 'gt_cls', k.gt_cls, 'iou', -k.d))))[0]).out"""
    rows = images.select("image_id", F.explode(F.arrays_zip("ps", F.expr(step).alias("m"))).alias("r"))
    matched = cut_lineage(rows.select("image_id", "r.ps.pred_idx", "r.ps.conf", "r.ps.pred_cls", "r.m.gt_idx", "r.m.gt_cls", "r.m.iou"))
    free = g.select("image_id", "gt_idx", "gt_cls").join(matched.where("gt_idx is not null").select("image_id", "gt_idx"), ["image_id", "gt_idx"], "left_anti")
    return matched.unionByName(free, allowMissingColumns=True)


def confusion(greedy: DataFrame) -> DataFrame:
    """Counts and row shares of true against predicted class; -1 is background on either side."""
    c = greedy.groupBy(F.coalesce("gt_cls", F.lit(-1)).alias("true_cls"), F.coalesce("pred_cls", F.lit(-1)).alias("pred_cls")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("share", F.round(F.col("n") / F.greatest(F.lit(1), F.sum("n").over(Window.partitionBy("true_cls"))), 6))


def nms(pred: DataFrame, thr: float, most: int = 300) -> DataFrame:
    """Class-wise non-maximum suppression per image: a box stays if its IoU with every kept better box is at most thr; the best `most` stay.

    Like greedy_matches: overlaps by an equi-join, the pass as a fold over an image's sorted boxes.
    """
    columns = pred.select("image_id", "cls_id", "pred_idx", "conf", "x1", "y1", "x2", "y2")
    better = columns.select("image_id", "cls_id", F.col("pred_idx").alias("b_idx"), F.col("conf").alias("b_conf"), *[F.col(c).alias(f"b_{c}") for c in ("x1", "y1", "x2", "y2")])
    first = (F.col("b_conf") > F.col("conf")) | ((F.col("b_conf") == F.col("conf")) & (F.col("b_idx") < F.col("pred_idx")))
    over = columns.join(better, ["image_id", "cls_id"]).where(first & (iou(box(), box("b_")) > thr)).groupBy("image_id", "pred_idx").agg(F.collect_list("b_idx").alias("by"))
    one = columns.join(over, ["image_id", "pred_idx"], "left").select("image_id", F.struct((-F.col("conf")).alias("o"), "pred_idx", F.coalesce("by", F.array().cast("array<int>")).alias("by")).alias("p"))
    none = F.array().cast(columns.select(F.array("pred_idx")).schema[0].dataType)
    kept = F.aggregate("ps", none, lambda s, p: F.when((F.size(s) < most) & ~F.arrays_overlap(s, p["by"]), F.array_append(s, p["pred_idx"])).otherwise(s))
    stay = one.groupBy("image_id").agg(F.array_sort(F.collect_list("p")).alias("ps")).select("image_id", F.explode(kept).alias("pred_idx"))
    return columns.join(stay, ["image_id", "pred_idx"]).select(*columns.columns)


def trapezoid(points: DataFrame, keys: list[str], x: str, y: str) -> DataFrame:
    """Area under a small curve by trapezoids."""
    w = Window.partitionBy(*keys).orderBy(x)
    step = points.withColumn("_a", (F.col(x) - F.lag(x).over(w)) * (F.col(y) + F.lag(y).over(w)) / 2)
    return step.groupBy(*keys).agg(F.round(F.sum("_a"), 6).alias("area"))
