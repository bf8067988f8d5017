"""Class-distribution statistics of annotated data sets.

Inputs are long tables: labels(dataset, split, image_id, line_no, kind, cls_id, ...) and frames(image_id, dataset, split). Every
statistic is one or two hash aggregations; nothing is collected. Null classes form no class; empty inputs give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ordered import quantiles


def class_split_counts(labels: DataFrame) -> DataFrame:
    """Per data set and class: instances by split and in total, images that show it, mean instances per image."""
    # Two levels, (class, image) first: the distinct image count needs no second expansion of the labels.
    per = labels.where("cls_id is not null").groupBy("dataset", "cls_id", "image_id", "split").agg(F.count(F.lit(1)).alias("n"))
    of = lambda s: F.coalesce(F.sum(F.when(F.col("split") == s, F.col("n"))), F.lit(0)).alias(f"n_{s}")
    out = per.groupBy("dataset", "cls_id").agg(of("train"), of("val"), of("test"), F.sum("n").alias("n_total"), F.count_distinct("image_id").alias("n_images"))
    return out.withColumn("per_image", F.round(F.col("n_total") / F.col("n_images"), 6))


def class_ids_by_name(classes: DataFrame) -> DataFrame:
    """Per class name over several data sets: its ids, as one id or mixed(a,b)."""
    ids = classes.where("name is not null and cls_id is not null").groupBy("name").agg(F.array_sort(F.collect_set("cls_id")).alias("ids"), F.count_distinct("dataset").alias("n_datasets"))
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    return ids.select("name", F.when(F.size("ids") == 1, text).otherwise(F.concat(F.lit("mixed("), text, F.lit(")"))).alias("id_set"), "n_datasets")


def gini(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Gini coefficient of non-negative values per key; 0 where all are zero."""
    ranked = counts.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(value)))
    n, total = F.count(F.lit(1)), F.sum(value)
    return ranked.groupBy(*keys).agg(F.when(total > 0, 2 * F.sum(F.col("_i") * F.col(value)) / (n * total) - (n + 1) / n).otherwise(F.lit(0.0)).alias("gini"))


def imbalance(counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Over positive class counts: max/min, population CV, Gini, mean/median."""
    some = counts.where(F.col(value) > 0)
    v = F.col(value)
    base = some.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_classes"), F.sum(v).alias("n_instances"), (F.max(v) / F.min(v)).alias("max_min"), (F.stddev_pop(v) / F.avg(v)).alias("cv"), (F.avg(v) / F.expr(f"percentile({value}, 0.5)")).alias("mean_median"))
    return base.join(gini(some, keys, value), keys).select(*keys, "n_classes", "n_instances", *[F.round(c, 6).alias(c) for c in ("max_min", "cv", "gini", "mean_median")])


def effective_number(n: Column, beta: float) -> Column:
    """Effective number of samples (1 - b^n) / (1 - b)."""
    b = min(max(beta, 0.0), 0.999999)
    return (1 - F.pow(F.lit(b), n)) / max(1e-12, 1 - b)


def dataset_profile(frames: DataFrame, labels: DataFrame, classes: DataFrame) -> DataFrame:
    """Per data set: frames, frames by split, empty frames, instances by kind, unknown class ids, labels without frame."""
    known = classes.where("cls_id is not null").select("dataset", "cls_id").distinct().withColumn("_k", F.lit(1))
    per_image = labels.join(known, ["dataset", "cls_id"], "left").groupBy("dataset", "image_id").agg(F.count_if(F.col("kind") == "bbox").alias("b"), F.count_if(F.col("kind") == "segment").alias("s"), F.count_if(F.col("_k").isNull()).alias("u"))
    both = frames.select("dataset", "image_id", "split", F.lit(True).alias("_f")).join(per_image, ["dataset", "image_id"], "full_outer")
    have, lines = F.col("_f").isNotNull(), F.coalesce(F.col("b") + F.col("s"), F.lit(0))
    return both.groupBy("dataset").agg(
        F.count_if(have).alias("n_frames"), *[F.count_if(have & (F.col("split") == s)).alias(f"frames_{s}") for s in ("train", "val", "test")],
        F.count_if(have & (lines == 0)).alias("empty_frames"), F.sum(F.coalesce("b", F.lit(0))).alias("n_boxes"), F.sum(F.coalesce("s", F.lit(0))).alias("n_polygons"),
        F.sum(F.coalesce("u", F.lit(0))).alias("unknown_ids"), F.count_if(~have).alias("labels_without_frame"),
    )


def quality_flag(profile: DataFrame) -> DataFrame:
    bad = F.col("unknown_ids") + F.col("labels_without_frame")
    return profile.withColumn("empty_pct", F.round(100.0 * F.col("empty_frames") / F.greatest(F.col("n_frames"), F.lit(1)), 4)).withColumn("quality", F.when(bad == 0, "OK").otherwise("CHECK"))


def balance_ready(labels: DataFrame, beta: float = 0.999, tail_share: float = 0.1) -> DataFrame:
    """Per data set: the figures that choose a balancing strategy."""
    c = labels.where("cls_id is not null").groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("image_id").alias("images"))
    top = c.withColumn("top", F.max("n").over(Window.partitionBy("dataset")))
    tail = F.col("n") < tail_share * F.col("top")
    n = F.col("n")
    out = top.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_classes"), F.sum(n).alias("n_instances"), F.max(n).alias("n_max"), F.min(n).alias("n_min"), F.expr("percentile(n, 0.5)").alias("n_median"),
        F.round(F.sum(effective_number(n, beta)), 4).alias("effective"), F.count_if(tail).alias("tail_classes"), F.round(F.sum(F.when(tail, n).otherwise(0)) / F.sum(n), 6).alias("tail_share"),
    )
    ratio = F.col("n_max") / F.greatest(F.lit(1), "n_min")
    return out.withColumn("ratio", F.round(ratio, 6)).withColumn("strategy", F.when((F.col("n_classes") >= 2) & (ratio > 20), "hybrid").otherwise("weights"))


def compare_datasets(labels: DataFrame, left: str, right: str) -> DataFrame:
    """Per class of two data sets: counts, delta, and whether it is common or on one side only."""
    c = labels.where(F.col("dataset").isin(left, right) & F.col("cls_id").isNotNull()).groupBy("cls_id").agg(F.count_if(F.col("dataset") == left).alias("left_n"), F.count_if(F.col("dataset") == right).alias("right_n"))
    side = F.when(F.col("right_n") == 0, "left_only").when(F.col("left_n") == 0, "right_only").otherwise("common")
    return c.withColumn("delta", F.col("right_n") - F.col("left_n")).withColumn("side", side)


def percentiles(values: DataFrame, keys: list[str], value: str, at: list[float]) -> DataFrame:
    """Exact percentiles with linear interpolation; keys without a value give no row."""
    names = {f"p{int(round(q * 100))}": q for q in at}
    return quantiles(values, keys, value, names).select(*keys, *[F.round(n, 6).alias(n) for n in names])


def label_kinds(labels: DataFrame) -> DataFrame:
    """Per frame: bbox, segment or mixed."""
    return labels.groupBy("dataset", "image_id").agg(F.when(F.count_if(F.col("kind") == "bbox") == F.count(F.lit(1)), "bbox").when(F.count_if(F.col("kind") == "segment") == F.count(F.lit(1)), "segment").otherwise("mixed").alias("label_kind"))


def presets_harness(labels: DataFrame, multipliers: dict[str, float]) -> DataFrame:
    """Per preset: instances before and after, and head to tail ratio, when every class is cut to multiplier x median."""
    c = labels.where("split = 'train' and cls_id is not null").groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))
    med = c.groupBy("dataset").agg(F.expr("percentile(n, 0.5)").alias("med"))
    presets = F.explode(F.array(*[F.struct(F.lit(k).alias("preset"), F.lit(m).alias("mult")) for k, m in multipliers.items()]))
    x = c.join(med, "dataset").withColumn("p", presets).withColumn("after", F.least(F.col("n"), F.greatest(F.lit(1), F.floor(F.col("p.mult") * F.col("med")))))
    return x.groupBy("dataset", F.col("p.preset").alias("preset")).agg(F.sum("n").alias("before"), F.sum("after").alias("after"), F.round(F.max("after") / F.min("after"), 6).alias("head_tail"))
