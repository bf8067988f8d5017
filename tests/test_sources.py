"""Readers and writers on small trees made here."""

import json
import os
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F

from framewright.functions import geometry as G
from framewright.sources import documents, labels, sinks


def put(root, path, text):
    p = os.path.join(root, path)
    os.makedirs(os.path.dirname(p), exist_ok=True)
    with open(p, "w", encoding="utf-8") as f:
        f.write(text)


@pytest.fixture
def tree(tmp_path):
    r = str(tmp_path / "ds")
    put(r, "train/images/a.jpg", "x")
    put(r, "train/images/a.png", "xx")
    put(r, "train/images/b.jpg", "x")
    put(r, "train/labels/a.txt", "0 0.5 0.5 0.2 0.2\n# note\n\n1 0.1 0.1 0.2 0.2 0.3 0.1\nbad line\n2 0.5 0.5 0.2\n")
    put(r, "valid/labels/c.txt", "1 0.5 0.5 x 0.2\n")
    put(r, "data.yaml", "train: x\nnames:\n  - cat\n  - 'dog'\nnc: 2\n")
    return r


def test_label_scan_and_pairs(spark, tree):
    rows = labels.read_labels(spark, tree)
    assert {(r.split, r.kind, r.valid, r.cls_id) for r in rows.collect()} == {("train", "bbox", True, 0), ("train", "segment", True, 1), ("train", None, False, None), ("train", None, False, 2), ("val", None, False, 1)}
    p = {os.path.basename(r.path): (r.n_valid, r.n_broken) for r in labels.label_profile(rows).collect()}
    assert p == {"a.txt": (2, 2), "c.txt": (0, 1)}
    files = labels.listing(spark, tree)
    got = {r.rel: r.status for r in labels.pairs(files, files, "images", "labels").collect()}
    assert got == {"a": "pair", "b": "orphan_image", "c": "orphan_label"}
    assert [r.image_path.endswith("a.jpg") for r in labels.pairs(files, files, "images", "labels").where("rel = 'a'").collect()] == [True]


def test_layouts_lists_and_names(spark, tree, tmp_path):
    assert labels.detect_layout(labels.listing(spark, tree), tree).first().layout == "split"
    put(str(tmp_path / "o"), "notes/readme.md", "x")
    assert labels.detect_layout(labels.listing(spark, str(tmp_path / "o")), str(tmp_path / "o")).first().layout == "unknown"
    put(str(tmp_path / "f"), "images/a.jpg", "x")
    put(str(tmp_path / "f"), "labels/a.txt", "x")
    put(str(tmp_path / "f"), "obj.names", "cat\ndog\n")
    assert labels.detect_layout(labels.listing(spark, str(tmp_path / "f")), str(tmp_path / "f")).first().layouts == ["darknet", "flat"]
    assert [tuple(r) for r in labels.read_names(spark, str(tmp_path / "f/obj.names")).orderBy("cls_id").collect()] == [(0, "cat"), (1, "dog")]
    assert sorted((r.cls_id, r.name) for r in labels.read_data_yaml(spark, tree + "/data.yaml").collect()) == [(0, "cat"), (1, "dog")]
    put(str(tmp_path / "y"), "a.yaml", "names: [cat, \"dog\"]\nnc: 2\n")
    put(str(tmp_path / "y"), "b.yaml", "nc: 2\nnames:\n  0: cat\n  4: 'big dog'\n")
    got = {(os.path.basename(r.path), r.cls_id, r.name) for r in labels.read_data_yaml(spark, str(tmp_path / "y")).collect()}
    assert got == {("a.yaml", 0, "cat"), ("a.yaml", 1, "dog"), ("b.yaml", 0, "cat"), ("b.yaml", 4, "big dog")}
    put(str(tmp_path / "l"), "l.txt", "a\n# c\n\nb\na\n")
    assert sorted(r.value for r in labels.read_list(spark, str(tmp_path / "l/l.txt")).collect()) == ["a", "b"]


def test_cvat_round_trip(spark, tmp_path):
    rows = [("f1.jpg", 100, 50, "bbox", 0, 0.5, 0.5, 0.2, 0.4, None), ("f1.jpg", 100, 50, "segment", 1, None, None, None, None, [(0.1, 0.2), (0.5, 0.2), (0.3, 0.9)])]
    df = spark.createDataFrame(rows, "image_id string, width int, height int, kind string, cls_id int, cx double, cy double, w double, h double, points array<struct<x:double,y:double>>")
    names = spark.createDataFrame([(0, "cat")], "cls_id int, name string")
    out = str(tmp_path / "x")
    sinks.write_cvat(df, names, out, "t")
    back = {r.kind: r for r in documents.read_cvat(spark, out).collect()}
    assert back["bbox"].label == "cat" and back["segment"].label == "id_1"
    assert all(abs(a - b) < 1e-3 for a, b in zip(back["bbox"].box, (0.5, 0.5, 0.2, 0.4), strict=True))
    assert [round(p.x, 3) for p in back["segment"].points] == [0.1, 0.5, 0.3]


def test_label_files_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "bbox", 0.5, 0.5, 0.2, 0.2, None), ("a", 0, "segment", None, None, None, None, [(0.1, 0.1), (0.2, 0.1), (0.2, 0.3)]), ("b", None, "bbox", 0.1, 0.1, 0.1, 0.1, None)], "image_id string, cls_id int, kind string, cx double, cy double, w double, h double, points array<struct<x:double,y:double>>")
    t = sinks.label_texts(df, ["image_id"]).withColumn("rel_path", F.concat(F.lit("train/"), "image_id", F.lit(".txt")))
    assert sinks.write_texts(t, str(tmp_path)).count() == 1
    with open(tmp_path / "train/a.txt", encoding="utf-8") as f:
        assert f.read() == "0 0.100000 0.100000 0.200000 0.100000 0.200000 0.300000\n1 0.50000000 0.50000000 0.20000000 0.20000000\n"
    assert labels.read_labels(spark, str(tmp_path)).where("valid").count() == 2


def test_detections_archives_runs_and_metrics(spark, tmp_path):
    r = str(tmp_path)
    put(r, "det/a.json", json.dumps({"detections": [{"classId": 1, "class_name": "cat", "x": 1, "y": 2, "width": 3, "height": 4, "score": 0.5}]}))
    assert [(x.class_name, x.x2, x.y2) for x in documents.read_detections(spark, r + "/det").collect()] == [("cat", 4.0, 6.0)]
    os.makedirs(r + "/arc")
    with zipfile.ZipFile(r + "/arc/a.zip", "w") as z:
        z.writestr("images/a.jpg", "xyz")
    with tarfile.open(r + "/arc/b.tar", "w") as t:
        t.add(r + "/det/a.json", "in/a.json")
    put(r, "arc/broken.zip", "nothing")
    got = documents.archive_members(spark, r + "/arc").collect()
    assert {(x.member, x.size > 0) for x in got if x.member} == {("images/a.jpg", True), ("in/a.json", True)}
    assert [os.path.basename(x.archive) for x in got if x.member is None] == ["broken.zip"]
    put(r, "runs/m1/training_metadata.json", json.dumps({"training_info": {"model": "m", "epochs": 3}, "status": {"training_ok": True}, "system": {"hostname": "h", "devices": [{"name": "gpu", "memory_gb": 8.0}]}}))
    put(r, "runs/m1/train/results.csv", "epoch, mAP\n1,0.5\n")
    put(r, "runs/m2/test_metrics.csv", "Class, mAP50 ,n\nall,0.7,3\ncat,0.5,x\n")
    put(r, "runs/m3/test_metrics.csv", "Class,mAP50\na,0.2\nb,0.4\n")
    got = {os.path.basename(x.run_dir): (x.metadata, x.metrics) for x in documents.run_folders(spark, r + "/runs").collect()}
    assert got == {"m1": (True, False), "m2": (False, True), "m3": (False, True)}
    rows = {(x.path.split("/")[-2], x.metric): round(x.value, 3) for x in documents.metrics_row(documents.read_metrics_csv(spark, r + "/runs")).collect()}
    assert rows["m2", "mAP50"] == 0.7 and rows["m3", "mAP50"] == 0.3 and rows["m2", "n"] == 3.0
    m = documents.read_metadata(spark, r + "/runs/m1/training_metadata.json").first()
    assert (m.model, m.sys_device, m.training_ok) == ("m", "gpu", True)
    assert documents.latest_file(spark, r + "/runs", "*.csv").count() == 1


def test_snapshot_and_dual_write(spark, tmp_path):
    df = spark.createDataFrame([(1, None), (2, "b")], "a int, b string")
    one, two = (sinks.snapshot(x, str(tmp_path / n)).first() for x, n in ((df, "s1"), (df.orderBy(F.desc("a")), "s2")))
    assert one == two and one.n_rows == 2
    assert sinks.dual_write(df, str(tmp_path / "l"), str(tmp_path / "u")).first().equal
    sinks.write_json_atomic(str(tmp_path / "j.json"), {"b": 1})
    assert json.load(open(tmp_path / "j.json", encoding="utf-8")) == {"b": 1}
    assert "names:\n  0: \"cat\"" in sinks.data_yaml(["cat"])


def test_geometry(spark):
    one = spark.range(1)
    c = lambda *x: tuple(F.lit(float(v)) for v in x)
    get = lambda e: one.select(e.alias("v")).first().v
    assert get(G.iou(c(0, 0, 2, 2), c(1, 1, 3, 3))) == pytest.approx(1 / 7)
    assert get(G.iou(c(0, 0, 1, 1), c(1, 1, 2, 2))) == 0
    assert tuple(get(G.to_box(*c(-10, 0, 50, 50), *c(100, 100)))) == (0.25, 0.25, 0.5, 0.5)
    assert get(G.to_box(*c(5, 5, 5, 9), *c(100, 100))) is None
    assert get(G.tile_starts(F.lit(1000), 640, 0.2)) == [0, 360] and get(G.tile_starts(F.lit(300), 640, 0.2)) == [0]
    r = get(G.rotate_quarter(*c(0.2, 0.3, 0.1, 0.4), 1))
    assert tuple(round(x, 6) for x in r) == (0.7, 0.2, 0.4, 0.1)
    back = get(G.rotate_quarter(*c(*r), 3))
    assert tuple(round(x, 6) for x in back) == (0.2, 0.3, 0.1, 0.4)
    assert tuple(get(G.crop_box(c(10, 10, 30, 30), c(20, 20, 40, 40)))) == (0.25, 0.25, 0.5, 0.5)
    assert get(G.crop_box(c(0, 0, 5, 5), c(20, 20, 40, 40))) is None
    assert get(G.side_of(c(1, 1, 5, 5), c(0, 0, 100, 100), 0.5)) == "left-top" and get(G.side_of(c(90, 40, 99, 60), c(0, 0, 100, 100), 5)) == "right"
    assert [get(x) for x in G.pixel_corners(c(0.5, 1.5, 2.5, 3.6))] == [0, 2, 2, 4]
    pts = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((10.0, 10.0), (50.0, 10.0), (50.0, 40.0))])
    assert [p.x for p in get(G.to_segment(pts, *c(100, 100)))] == [0.1, 0.5, 0.5]
    assert get(G.letterbox(*c(200, 100), 100)).pad_y == 25


def test_queue_runs_retries_and_restarts(spark, tmp_path):
    from framewright.streaming import queue

    log = str(tmp_path / "log")
    queue.append_log(spark, log, [("a", 1, "waiting", 0, None), ("b", 2, "waiting", 0, None)])
    ran = []
    for i in range(3):
        q = queue.run_queue(spark, log, str(tmp_path / f"cp{i}"), lambda t: ran.append(t) or (0 if t == "a" else 1))
        q.awaitTermination(60)
    state = {r.task: (r.status, r.attempt) for r in queue.queue_state(spark.read.schema(queue.LOG).json(log)).collect()}
    assert ran[0] == "a" and state["a"] == ("done", 1) and state["b"][0] == "failed"
    due = queue.due_tasks(queue.queue_state(spark.read.schema(queue.LOG).json(log)), F.current_timestamp(), 2)
    assert due.count() == 0
    later = F.current_timestamp() + F.expr("interval 1 hour")
    assert [r.task for r in queue.due_tasks(queue.queue_state(spark.read.schema(queue.LOG).json(log)), later, 2).collect()] == ["b"]
    assert [r.active for r in queue.active_peers(spark.createDataFrame([("h",)], "host string").withColumn("at", F.current_timestamp()), later, 60).collect()] == [False]
