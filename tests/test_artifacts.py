"""Back ends, artifacts, outputs, leases and stores on hand-made cases: nulls, ties, repeats, empty tables, extra columns."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from framewright.operators import artifacts
from framewright.plans import registry
from framewright.sources import store
from framewright.streaming import queue

OUT = "struct<detections:array<struct<c:int>>,segments:array<struct<c:int>>,classification:array<struct<c:int>>>"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(seconds=n)


def test_backends(spark):
    models = spark.createDataFrame([(1, "Detection", " PT ", "ultralytics", 0), (2, "detection", "tflite", None, 0), (3, "segmentation", "onnx", "tensorrt", 0), (4, None, "pt", "x", 0), (4, None, "pt", "x", 0)], "id int, task_type string, model_format string, backend_type string, place int")
    caps = registry.capabilities(spark)
    assert {r.id: r.backend for r in artifacts.backends_for(models, caps, "test").collect()} == {1: "ultralytics", 2: None, 3: "onnxruntime", 4: None}
    assert {r.id: r.backend for r in artifacts.backends_for(models, caps, "train").collect()} == {1: "ultralytics", 2: None, 3: None, 4: None}
    assert {(r.id, r.error_code) for r in artifacts.incompatible_models(models, caps).collect()} == {(2, "backend_format_incompatible"), (3, "backend_type_mismatch"), (4, "backend_format_incompatible")}
    assert artifacts.incompatible_models(models.limit(0), caps).count() == 0
    with pytest.raises(ValueError):
        artifacts.backends_for(models, caps, "sell")


def test_registry():
    r = registry.default_registry()
    assert r.resolve("metrics", task="detect")(["mAP50", "x"]) == ["mAP50"]
    assert r.resolve("metrics", task="other")(["top1"]) == ["top1"]
    assert r.resolve("test", fmt="onnx") is r.resolve("test")
    r.register("test", len, fmt="onnx")
    assert r.resolve("test", "detect", " ONNX ") is len
    for wrong in (lambda: r.register("test", len, fmt="onnx"), lambda: r.resolve("draw")):
        with pytest.raises((ValueError, LookupError)):
            wrong()
    assert "p4_found" in registry.analyses() and ("read", None, "csv") in set(r)


def test_artifact_gaps_and_matches(spark):
    runs = spark.createDataFrame([("a", "pt", 1), ("a", "pt", 2), ("b", "pt", 1), ("c", "onnx", 1)], "run_dir string, model_format string, artifact int")
    present = spark.createDataFrame([("a", "m"), ("a", "t"), ("b", "m"), ("b", "m"), (None, "t")], "run_dir string, artifact string")
    required = spark.createDataFrame([("pt", "m"), ("pt", "t")], "model_format string, artifact string")
    assert {r.run_dir: (r.missing, r.complete) for r in artifacts.artifact_gaps(runs, present, required).collect()} == {"a": ([], True), "b": (["t"], False), "c": ([], True)}
    want = spark.createDataFrame([("a", "pt", "t", "y", 640, None, 0.5), ("a", "pt", "t", "z", None, None, None), ("b", "engine", "t", "y", None, None, None), ("c", "pt", "t", "y", 320, None, None)], "run_dir string, model_format string, target string, data_yaml string, imgsz int, conf double, iou double")
    have = spark.createDataFrame([("a", "pt", "t", "y", 320, 0.2, 0.5, "OK", False), ("a", "pt", "t", "y", None, 0.1, 0.5, " ok", False), ("b", "engine", "t", "y", None, None, None, "ok", True), ("c", "pt", "t", "y", 320, None, None, "failed", False)], "run_dir string, model_format string, target string, data_yaml string, imgsz int, conf double, iou double, status string, all_zero boolean")
    assert {(r.run_dir, r.data_yaml): r.matched for r in artifacts.matching_artifacts(want, have).collect()} == {("a", "y"): True, ("a", "z"): False, ("b", "y"): False, ("c", "y"): False}
    assert artifacts.matching_artifacts(want.limit(0), have).count() == 0


def test_outputs(spark):
    d = [(1,)]
    rows = spark.createDataFrame([("a", "segmentation", (d, [(7,)], None), d), ("b", "detection", (None, None, None), [(2,), None]), ("c", "detection", None, None), ("d", "segmentation", (d, [], None), None)], f"k string, task_type string, task_outputs {OUT}, detections array<struct<c:int>>")
    assert {(r.k, r.idx, r.c) for r in artifacts.row_predictions(rows, "k").collect()} == {("a", 0, 7), ("b", 0, 2), ("d", 0, 1)}
    seg = {r.k: (len(r.outputs), r.capability_gap, r.capability_gap_reason) for r in artifacts.normalized_outputs(rows, "segmentation").collect()}
    assert seg["a"] == (1, False, None) and seg["b"] == (0, True, "missing_task_outputs.segments")
    det = {r.k: (len(r.outputs), r.capability_gap) for r in artifacts.normalized_outputs(rows, "detection").collect()}
    assert det == {"a": (1, False), "b": (2, False), "c": (0, False), "d": (1, False)}
    rec = spark.createDataFrame([("i", [(1, 0.5, None, 2.0, 3.0), None], None), (None, None, [(None, 1.0, 1.0, 2.0, 2.0, 0.9)])], "image_path string, gts array<struct<cls_id:int,x1:double,y1:double,x2:double,y2:double>>, preds array<struct<cls_id:int,x1:double,y1:double,x2:double,y2:double,conf:double>>")
    assert [tuple(r) for r in artifacts.diagnostics_boxes(rec, "gts").collect()] == [("i", 0, 1, 0.5, 0.0, 2.0, 3.0)]
    assert [tuple(r) for r in artifacts.diagnostics_boxes(rec, "preds").collect()] == [("", 0, 0, 1.0, 1.0, 2.0, 2.0, 0.9)]
    out = spark.createDataFrame([(3, 1, " "), (3, 2, "b"), (3, 0, None), (3, 5, "c"), (4, 1, None), (-1, 1, "x"), (None, 1, "y")], "cls_id int, pos int, class_name string")
    assert {r.cls_id: r.class_name for r in artifacts.first_names(out, [], "pos").collect()} == {3: "b", 4: "4"}


def test_overlay_sources_and_labels(spark):
    f = spark.createDataFrame([("i",), ("j",), ("i",)], "image_id string")
    g = spark.createDataFrame([("i", 1), ("i", 1), ("i", 2), ("z", 1)], "image_id string, cls_id int")
    p = spark.createDataFrame([("i", 1), ("i", 3), ("i", None)], "image_id string, cls_id int")
    assert {tuple(r) for r in artifacts.overlay(f, g, p).collect()} == {("i", 3, 3, 1, 2), ("j", 0, 0, 0, 0)}
    s = spark.createDataFrame([("d", "train", "x_bal_1"), ("d", "train", "bal_22"), ("d", "val", "y"), ("d", None, "y"), ("e", "val", "bal_x"), ("g", "val", None)], "dataset string, split string, stem string")
    made = spark.createDataFrame([("e", " Balance "), ("g", "split"), (None, "balance")], "dataset string, command string")
    assert {r.dataset: (r.share, r.balanced) for r in artifacts.balanced_sources(s, made).collect()} == {"d": (0.666667, True), "e": (0.0, True), "g": (None, False)}
    rows = spark.createDataFrame([("/r/a/", None, "m"), ("/r/b", "nb", "m"), (None, "", "m"), (None, None, None), ("/r/c", " ", "q")], "run_dir string, run_name string, model string")
    labels = spark.createDataFrame([("/r/a", "A"), ("nb", "B"), ("m", "M"), (None, "Z"), ("m", "N")], "key string, label string")
    assert [r.display_label for r in artifacts.display_labels(rows, labels).collect()] == ["A", "B", "M", "?", "c"]


def test_leases(spark):
    rows = [("r1", "h", 1, at(0), at(10)), ("r2", "h", 2, at(0), at(500)), ("r3", "k", 1, at(0), None), ("r4", "k", 9, None, at(990)), ("r5", "h", 3, None, None)]
    leases = spark.createDataFrame(rows, "resource string, host string, pid int, acquired_at timestamp, last_heartbeat timestamp")
    alive = spark.createDataFrame([(1,), (9,), (9,)], "pid int")
    now = F.lit(at(1000)).cast("timestamp")
    got = queue.stale_leases(leases, now, "h", alive)
    assert {r.resource: r.stale for r in got.collect()} == {"r1": False, "r2": True, "r3": True, "r4": False, "r5": True}
    wanted = spark.createDataFrame([("r2", "n", 7), ("r2", "m", 8), ("r4", "n", 7), ("r9", "n", 7)], "resource string, host string, pid int")
    after = {r.resource: (r.host, r.pid, r.taken) for r in queue.taken_over(got, wanted, now).collect()}
    assert after == {"r1": ("h", 1, False), "r2": ("m", 8, True), "r3": ("k", 1, False), "r4": ("k", 9, False), "r5": ("h", 3, False), "r9": ("n", 7, True)}


def test_versions_under_a_lock(spark, tmp_path):
    path = str(tmp_path / "catalog")
    row = lambda *x: spark.createDataFrame([x], "dataset string, n int, at int")
    assert store.latest(spark, path) is None
    store.merged(row("a", 1, 1), path, ["dataset"], "at")
    store.merged(row("b", 2, 1), path, ["dataset"], "at")
    got = store.merged(row("a", 5, 2), path, ["dataset"], "at", keep=1)
    assert {tuple(r) for r in got.collect()} == {("a", 5, 2), ("b", 2, 1)} and store.versions(spark, path) == [2, 3]
    open(f"{path}/_lock_4", "w").close()
    with pytest.raises(store.Taken):
        store.merged(row("c", 1, 1), path, ["dataset"], "at")
    assert store.latest(spark, path).count() == 2
    built = []
    for _ in range(2):
        kept = store.kept(spark, str(tmp_path / "cache"), "f00", lambda: built.append(1) or row("x", 1, 1))
        assert kept.count() == 1
    assert len(built) == 1
