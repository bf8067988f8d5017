"""Artifacts, back ends and outputs of model runs: what is missing, what fits, and one shape for all outputs.

Small tables (capabilities, required artifacts, labels) meet large ones by joins whose lookup side is counted before it is broadcast.
Defined results: null task types or formats have no back end; a null expectation is not asked for and a null record proves nothing against
one; empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.operators.skew import lookup_join

CAPABILITY = "backend string, place int, task_type string, model_format string, can_train boolean, can_test boolean, can_infer boolean"
USES = ("train", "test", "infer")


def backends_for(models: DataFrame, capabilities: DataFrame, use: str) -> DataFrame:
    """Models (task_type, model_format) with backend, the first one registered that can do what is asked (null: none)."""
    if use not in USES:
        raise ValueError(f"use is one of {USES}")
    key = lambda c: F.lower(F.trim(c))
    able = capabilities.where(F.col(f"can_{use}")).groupBy(key("task_type").alias("_t"), key("model_format").alias("_f")).agg(F.min_by("backend", "place").alias("backend"))
    keyed = models.withColumns({"_t": key("task_type"), "_f": key("model_format")})
    return lookup_join(keyed, able, ["_t", "_f"], models.columns[:1]).drop("_t", "_f")


def incompatible_models(models: DataFrame, capabilities: DataFrame, use: str = "test") -> DataFrame:
    """Models that no back end serves (backend_format_incompatible), or that name another back end than theirs (backend_type_mismatch)."""
    got = backends_for(models, capabilities, use)
    code = F.when(F.col("backend").isNull(), "backend_format_incompatible")
    if "backend_type" in models.columns:
        code = code.when(~F.col("backend").eqNullSafe(F.col("backend_type")), "backend_type_mismatch")
    return got.withColumn("error_code", code).where("error_code is not null")


def artifact_gaps(runs: DataFrame, present: DataFrame, required: DataFrame, run: str = "run_dir") -> DataFrame:
    """run, model_format, missing (names in order) and complete, of every run by the artifacts its format requires (model_format, artifact)."""
    wanted = runs.select(run, "model_format").distinct().join(required.select("model_format", "artifact").distinct(), "model_format", "left")
    there = present.select(run, "artifact").distinct().withColumn("_there", F.lit(True))
    gap = wanted.join(there, [run, "artifact"], "left").withColumn("_gap", F.when(F.col("artifact").isNotNull() & F.col("_there").isNull(), F.col("artifact")))
    out = gap.groupBy(run, "model_format").agg(F.array_sort(F.collect_set("_gap")).alias("missing"))
    return out.withColumn("complete", F.size("missing") == 0)


def matching_artifacts(expected: DataFrame, recorded: DataFrame, run: str = "run_dir") -> DataFrame:
    """Expectations (run, model_format, target, data_yaml, imgsz, conf, iou) with matched: whether a recorded test answers them.

    A record answers if its status is ok, target and data agree, and no parameter that both name differs; compiled formats whose
    metrics are all zero do not count. Of several records of a target any one may answer.
    """
    keys = [run, "model_format", "target", "data_yaml"]
    ok = recorded.where(F.lower(F.trim("status")) == "ok")
    if "all_zero" in recorded.columns:
        ok = ok.where(~(F.lower("model_format").isin("engine", "trt") & F.coalesce("all_zero", F.lit(False))))
    parts = ("imgsz", "conf", "iou")
    r = ok.select(*keys, *[F.col(p).cast("double").alias(f"_{p}") for p in parts], F.lit(True).alias("_r"))
    both = expected.withColumn("_id", F.monotonically_increasing_id()).join(r, keys, "left")
    agree: Column = F.col("_r").isNotNull()
    for p in parts:
        agree = agree & F.coalesce(F.col(p).cast("double") == F.col(f"_{p}"), F.lit(True))
    return both.groupBy("_id").agg(*[F.first(c).alias(c) for c in expected.columns], F.bool_or(agree).alias("matched")).drop("_id")


def first_names(outputs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys, cls_id and the first name that the outputs give the class, by order; the id where none does. Negative and null ids count for nothing."""
    named = F.min_by(F.when(F.trim("class_name") != "", F.col("class_name")), F.when(F.trim("class_name") != "", F.col(order)))
    return outputs.where("cls_id >= 0").groupBy(*keys, "cls_id").agg(F.coalesce(named, F.col("cls_id").cast("string")).alias("class_name"))


def normalized_outputs(rows: DataFrame, task: str) -> DataFrame:
    """External rows with outputs (detections or segments of the task), capability_gap and its reason.

    Rows have task_outputs struct<detections, segments, classification> and flat detections, either of which may be null; flat ones
    stand in where the task's outputs are missing altogether.
    """
    flat, own = F.coalesce("detections", F.array()), F.col("task_outputs")
    name = {"segmentation": "segments", "classification": "classification"}.get(task, "detections")
    found = F.coalesce(own[name], flat if name == "detections" else F.array())
    out = rows.withColumn("outputs", found)
    gap = (F.size("outputs") == 0) & F.lit(name != "detections")
    return out.withColumn("capability_gap", gap).withColumn("capability_gap_reason", F.when(gap, f"missing_task_outputs.{name}"))


def row_predictions(rows: DataFrame, key: str) -> DataFrame:
    """key, idx and the predictions of report rows: segments of segmentation rows, else the task's detections, else the flat ones."""
    some = lambda c: F.when(F.size(c) > 0, c)
    own = F.col("task_outputs")
    found = F.coalesce(F.when(F.col("task_type") == "segmentation", some(own["segments"])), some(own["detections"]), F.col("detections"))
    return rows.select(key, F.posexplode(found).alias("idx", "p")).where("p is not null").select(key, "idx", "p.*")


def diagnostics_boxes(records: DataFrame, side: str) -> DataFrame:
    """image_path, idx, cls_id and box of the gts or preds arrays of diagnostics records; missing numbers are 0, null elements give no row."""
    x = records.select(F.coalesce("image_path", F.lit("")).alias("image_path"), F.posexplode(side).alias("idx", "b")).where("b is not null")
    number = lambda c, t: F.coalesce(F.col(f"b.{c}").cast(t), F.lit(0).cast(t)).alias(c)
    conf = [number("conf", "double")] if side == "preds" else []
    return x.select("image_path", "idx", number("cls_id", "int"), *[number(c, "double") for c in ("x1", "y1", "x2", "y2")], *conf)


def overlay(frames: DataFrame, truths: DataFrame, predictions: DataFrame) -> DataFrame:
    """Every frame with the numbers of its truths and predictions, and of classes that only one of them has."""
    n = truths.select("image_id", "cls_id", F.lit(1).alias("g"), F.lit(0).alias("p")).unionByName(predictions.select("image_id", "cls_id", F.lit(0).alias("g"), F.lit(1).alias("p")))
    per = n.groupBy("image_id", "cls_id").agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
    per = per.groupBy("image_id").agg(F.sum("g").alias("n_gt"), F.sum("p").alias("n_pred"), F.count_if(F.col("p") == 0).alias("gt_only"), F.count_if(F.col("g") == 0).alias("pred_only"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return frames.select("image_id").distinct().join(per, "image_id", "left").select("image_id", *[zero(c) for c in ("n_gt", "n_pred", "gt_only", "pred_only")])


def balanced_sources(frames: DataFrame, commands: DataFrame | None = None, least: float = 0.6) -> DataFrame:
    """Per data set: share of frames whose stem ends in bal_<n>, and whether it is the output of a balance step (by its recorded command or by that share)."""
    out = frames.where("split is not null").groupBy("dataset").agg(F.avg(F.col("stem").rlike(r"bal_\d+$").cast("int")).alias("share"))
    flag = F.coalesce(F.col("share") >= least, F.lit(False))
    if commands is not None:
        made = commands.where(F.lower(F.trim("command")) == "balance").select("dataset").distinct().withColumn("_made", F.lit(True))
        out, flag = out.join(made, "dataset", "left"), flag | F.col("_made").isNotNull()
    return out.withColumn("balanced", flag).select("dataset", F.round("share", 6).alias("share"), "balanced")


def display_labels(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (run_dir, run_name, model) with display_label: the label of the first of run_dir, run_name (or the folder's name) and model that has one, else the name."""
    empty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    folder = F.regexp_replace(empty("run_dir"), r"/+$", "")
    keyed = rows.withColumns({"_k0": folder, "_k1": F.coalesce(empty("run_name"), F.regexp_extract(folder, r"([^/]+)$", 1)), "_k2": empty("model")})
    once = labels.where("key is not null").groupBy("key").agg(F.min("label").alias("label"))
    for i in range(3):
        keyed = lookup_join(keyed, once.select(F.col("key").alias(f"_k{i}"), F.col("label").alias(f"_l{i}")), [f"_k{i}"], rows.columns[:1])
    return keyed.withColumn("display_label", F.coalesce("_l0", "_l1", "_l2", empty("_k1"), "_k2", F.lit("?"))).select(*rows.columns, "display_label")


def instances_by_class(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Instances and the frames that have them, per class."""
    return labels.where("cls_id is not null").groupBy(*keys, "cls_id").agg(F.count(F.lit(1)).alias("n_instances"), F.count_distinct("image_id").alias("n_frames"))
