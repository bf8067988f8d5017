"""Two-pass quantile filters for boxes cut by the frame's edge or too small to be real.

Pass one aggregates per class (exact percentiles of boxes that lie well inside the frame); pass two joins the few class rows back and
decides each box by one ordered CASE. Labels without a class or geometry are kept. Class tables are small and joined as they come.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.geometry import visibility
from framewright.operators.ordered import at_rank, ranks
from framewright.operators.skew import lookup_join
from framewright.session import cut_lineage


@dataclass(frozen=True)
class EdgeConfig:
    inset: float = 0.02
    proximity: float = 0.01
    edge_eps: float = 0.002
    sides: tuple[str, ...] = ("left", "top", "right", "bottom")
    min_visibility: float = 0.5
    min_w_px: float = 4.0
    min_h_px: float = 4.0
    rel_width: float = 0.35
    rel_height: float = 0.35
    min_area_px: float = 16.0
    max_aspect: float = 25.0
    least_samples: int = 5
    split_ratio: float = 0.5
    typical_quantile: float = 0.25
    rel_factor: float = 0.5


def margin(norm: float, px: float, width: Column, height: Column) -> Column:
    return F.greatest(F.lit(norm), F.lit(px) / F.greatest(width, height, F.lit(1)))


def is_inset(c: EdgeConfig) -> Column:
    return (F.col("x1") >= c.inset) & (F.col("y1") >= c.inset) & (F.col("x2") <= 1 - c.inset) & (F.col("y2") <= 1 - c.inset)


def edge_sides(near: float) -> Column:
    """The frame sides a box reaches within `near`."""
    tests = (("left", F.col("x1") <= near), ("top", F.col("y1") <= near), ("right", F.col("x2") >= 1 - near), ("bottom", F.col("y2") >= 1 - near))
    return F.array_compact(F.array(*[F.when(t, n) for n, t in tests]))


def in_zone(c: EdgeConfig) -> Column:
    return F.arrays_overlap(edge_sides(c.proximity), F.array(*[F.lit(s) for s in c.sides]))


def touches_edge(eps: float) -> Column:
    return F.size(edge_sides(eps)) > 0


CLASS = ["dataset", "cls_id"]
INSIDE = ("w_inset", "h_inset", "w_clear", "h_clear")
SIZES = ("w_all", "h_all")


def class_ranks(geo: DataFrame, c: EdgeConfig, measures: tuple[str, ...]) -> DataFrame:
    """The distributions of the box sizes of each class, one for each measure: of all boxes, of inset ones, of ones clear of the edge zone."""
    within = {"all": F.lit(True), "inset": is_inset(c), "clear": ~in_zone(c)}
    value = lambda m: F.when(within[m[2:]], F.col(f"{m[0]}_px"))
    each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), value(m).alias("px")) for m in measures]))
    return ranks(geo.where("cls_id is not null").select(*CLASS, each.alias("m")).select(*CLASS, "m.measure", "m.px"), [*CLASS, "measure"], "px")


def baseline(geo: DataFrame, c: EdgeConfig = EdgeConfig(), ranked: DataFrame | None = None) -> DataFrame:
    """Per class: inset boxes, percentiles of their size, and which sample the relative thresholds rest on."""
    at = {10: 0.1, 25: 0.25, 50: 0.5, 90: 0.9}
    if ranked is None:
        ranked = class_ranks(geo, c, INSIDE)
    q = ranked.where(F.col("measure").isin(*INSIDE)).groupBy(*CLASS, "measure").agg(*[at_rank("px", x * (F.col("total") - 1)).alias(f"p{p}") for p, x in at.items()])
    n = geo.where("cls_id is not null").groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_all"), F.count_if(is_inset(c)).alias("n_inset"), F.count_if(~in_zone(c)).alias("n_clear"))
    # Added up rather than joined: null data sets meet.
    s = n.unionByName(q, allowMissingColumns=True).groupBy(*CLASS).agg(F.max("n_all").alias("n_all"), F.max("n_inset").alias("n_inset"), F.max("n_clear").alias("n_clear"), *[F.max(F.when(F.col("measure") == m, F.col(f"p{p}"))).alias(f"{m}_{p}") for m in INSIDE for p in at])
    mode = F.when(F.col("n_inset") >= c.least_samples, "inset").when(F.col("n_clear") >= c.least_samples, "non_edge_samples").otherwise("absolute_only")
    pick = lambda v, p: F.round(F.when(F.col("mode") == "inset", F.col(f"{v}_inset_{p}")).when(F.col("mode") == "non_edge_samples", F.col(f"{v}_clear_{p}")), 6)
    return s.withColumn("mode", mode).select(*CLASS, "n_all", "n_inset", "mode", *[pick(v, p).alias(f"{v}_p{p}") for v in "wh" for p in at])


def edge_reason(c: EdgeConfig = EdgeConfig()) -> Column:
    """Why a box of the edge zone is dropped, first reason first; null keeps it. Needs w_p50 and h_p50 of its class."""
    seen = visibility(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    zone = in_zone(c)
    return F.when(zone & (seen < c.min_visibility), "visibility").when(zone & (F.col("w_px") < c.min_w_px), "abs_width").when(zone & (F.col("w_px") < c.rel_width * F.col("w_p50")), "rel_width").when(zone & (F.col("h_px") < c.min_h_px), "abs_height").when(zone & (F.col("h_px") < c.rel_height * F.col("h_p50")), "rel_height").when(zone, global_reason(c))


def global_reason(c: EdgeConfig = EdgeConfig()) -> Column:
    w, h = F.col("w_px"), F.col("h_px")
    return F.when(w * h < c.min_area_px, "min_area").when((w > 0) & (h > 0) & (F.greatest(w / h, h / w) > c.max_aspect), "max_aspect")


def size_baseline(geo: DataFrame, c: EdgeConfig = EdgeConfig(), ranked: DataFrame | None = None) -> DataFrame:
    """Per class: the stable size threshold (median, bulk above ratio x median, quantile of the bulk x factor).

    The bulk is the upper end of the sorted distribution, so its quantile is a rank in it: nothing is sorted twice.
    """
    key = [*CLASS, "measure"]
    r = (cut_lineage(class_ranks(geo, c, SIZES)) if ranked is None else ranked).where(F.col("measure").isin(*SIZES))
    # One row per class and measure each: written, so that the steps after them do not derive them again.
    med = cut_lineage(r.groupBy(*key).agg((c.split_ratio * at_rank("px", 0.5 * (F.col("total") - 1))).alias("least")))
    r = lookup_join(r, med, key, ["px"], "inner", null_safe=True)
    below = cut_lineage(r.groupBy(*key).agg(F.coalesce(F.sum(F.when(F.col("px") < F.col("least"), F.col("times"))), F.lit(0)).alias("below")))
    r = lookup_join(r, below, key, ["px"], "inner", null_safe=True).withColumn("bulk", F.col("total") - F.col("below"))
    rank = F.when(F.col("bulk") >= c.least_samples, F.col("below") + c.typical_quantile * (F.col("bulk") - 1)).otherwise(c.typical_quantile * (F.col("total") - 1))
    th = r.groupBy(*key).agg(F.round(c.rel_factor * at_rank("px", rank), 6).alias("least"))
    n = geo.where("cls_id is not null").groupBy(*CLASS).agg(F.count(F.lit(1)).alias("n_all"))
    both = n.unionByName(th, allowMissingColumns=True).groupBy(*CLASS)
    return both.agg(F.max("n_all").alias("n_all"), F.max(F.when(F.col("measure") == "w_all", F.col("least"))).alias("min_w"), F.max(F.when(F.col("measure") == "h_all", F.col("least"))).alias("min_h"))


def decisions(geo: DataFrame, c: EdgeConfig = EdgeConfig()) -> DataFrame:
    """Every label with reason (null: kept): edge reasons first, then small_size against the stable baseline of its class."""
    # The geometry feeds both passes; it is written once instead of being derived four times.
    geo = cut_lineage(geo)
    ranked = cut_lineage(class_ranks(geo, c, (*INSIDE, *SIZES)))
    base = baseline(geo, c, ranked).select(*CLASS, "w_p50", "h_p50")
    size = size_baseline(geo, c, ranked).select(*CLASS, "min_w", "min_h")
    both = base.unionByName(size, allowMissingColumns=True).groupBy(*CLASS).agg(*[F.max(x).alias(x) for x in ("w_p50", "h_p50", "min_w", "min_h")])
    g = lookup_join(geo, cut_lineage(both), CLASS, ["image_id"])
    small = F.when((F.col("w_px") < F.col("min_w")) & (F.col("h_px") < F.col("min_h")), "small_size")
    reason = F.when(F.col("cls_id").isNotNull() & F.col("w_px").isNotNull(), F.coalesce(edge_reason(c), small))
    return g.withColumn("reason", reason)


def forecast(decided: DataFrame) -> DataFrame:
    """Per data set and reason (kept where none): labels, and frames concerned, by class and in total, in one pass of grouping sets."""
    k = decided.withColumn("reason", F.coalesce("reason", F.lit("kept")))
    return k.groupingSets([[k["dataset"], k["reason"], k["cls_id"]], [k["dataset"], k["reason"]]], "dataset", "reason", "cls_id").agg(F.grouping("cls_id").cast("int").alias("all_classes"), F.count(F.lit(1)).alias("n_labels"), F.count_distinct("image_id").alias("n_frames"))


def frame_outcomes(decided: DataFrame) -> DataFrame:
    """Per frame: labels kept and dropped, and what becomes of it (untouched, trimmed, emptied)."""
    f = decided.groupBy("dataset", "image_id").agg(F.count_if(F.col("reason").isNull()).alias("kept"), F.count_if(F.col("reason").isNotNull()).alias("dropped"))
    return f.withColumn("outcome", F.when(F.col("dropped") == 0, "untouched").when(F.col("kept") > 0, "trimmed").otherwise("emptied"))


def prune_small(geo: DataFrame, min_w: float, min_h: float, mode: str) -> DataFrame:
    """Labels that survive fixed pixel limits; mode or drops when one side is short, and when both are."""
    w, h = F.col("w_px") < min_w, F.col("h_px") < min_h
    return geo.where(~F.coalesce((w | h) if mode == "or" else (w & h), F.lit(False)))


def prune_empty(frames: DataFrame, labels: DataFrame) -> DataFrame:
    """Frames without any valid label line."""
    return frames.join(labels.where("cls_id is not null").select("image_id").distinct(), "image_id", "left_anti")


def empirical_bounds(geo: DataFrame, low: float, high: float) -> DataFrame:
    """Percentile hull of boxes that touch no edge, per class and per class and frame size, in one pass.

    Bounds have nine digits: at six, sums of doubles on the half of the last digit come out differently from engine to engine.
    """
    g = geo.where("cls_id is not null").where(~touches_edge(0.002)).select("cls_id", "width", "height", "x1", "y1", "x2", "y2")
    bounds = {"x_low": ("x1", low), "y_low": ("y1", low), "x_high": ("x2", high), "y_high": ("y2", high)}
    levels = F.explode(F.array(F.struct(F.lit(0).alias("level"), "width", "height"), F.struct(F.lit(1).alias("level"), F.lit(None).cast("int").alias("width"), F.lit(None).cast("int").alias("height"))))
    g = g.select("cls_id", levels.alias("l"), "x1", "y1", "x2", "y2").select("cls_id", "l.*", "x1", "y1", "x2", "y2")
    key = ["cls_id", "width", "height", "level"]
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("bound"), F.col(v).alias("v"), F.lit(q).alias("q")) for n, (v, q) in bounds.items()]))
    r = ranks(g.select(*key, each.alias("b")).select(*key, "b.bound", "b.q", "b.v"), [*key, "bound", "q"], "v")
    per = r.groupBy(*key, "bound").agg(F.max("total").alias("n"), F.round(at_rank("v", F.col("q") * (F.col("total") - 1)), 9).alias("v"))
    return per.groupBy(*key).agg(F.max("n").alias("n"), *[F.max(F.when(F.col("bound") == n, F.col("v"))).alias(n) for n in bounds]).drop("level")


def hull(geo: DataFrame, keys: list[str]) -> DataFrame:
    """Min/max hull of boxes; hulls merge by the same aggregation."""
    return geo.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.round(f("x1" if a == 0 else a), 6).alias(n) for f, a, n in ((F.min, "x1", "x1"), (F.min, "y1", "y1"), (F.max, "x2", "x2"), (F.max, "y2", "y2"))])


def resolved(geo: DataFrame, special: DataFrame, general: DataFrame, columns: list[str]) -> DataFrame:
    """Class statistics joined back to each box, the (class, width, height) row before the class row."""
    s = special.select("cls_id", "width", "height", *[F.col(c).alias(f"_s_{c}") for c in columns])
    g = general.select("cls_id", *[F.col(c).alias(f"_g_{c}") for c in columns])
    return geo.join(s, ["cls_id", "width", "height"], "left").join(g, "cls_id", "left").select(*[geo[c] if c not in ("cls_id", "width", "height") else F.col(c) for c in geo.columns], *[F.coalesce(f"_s_{c}", f"_g_{c}").alias(c) for c in columns])
