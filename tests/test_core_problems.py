"""The general data problems against brute force and hand-made cases: nulls, empty tables, repeats, ties, clashing extra columns."""

import datetime as dt
import json
from collections import Counter

import pytest
from pyspark.sql import functions as F

from framewright.operators import compaction, dewey, drift, quarantine
from framewright.operators.schema_match import Field, match_fields, name_similarity, words_of

FILES = "raw_path string, run_dir string, namespace string, producer string, written_at timestamp_ntz, ingested_at timestamp_ntz, body string, pos int, block int, fields string"


def at(n):
    return dt.datetime(2025, 1, 1) + dt.timedelta(hours=n)


def files(spark, bodies, producer="s1"):
    rows = [(p, "r", "test_metrics", producer, at(i), at(i), b, 7, 7, "x") for i, (p, b) in enumerate(bodies)]
    return spark.createDataFrame(rows, FILES)


def shared(files):
    """word -> the most fields of one file that bear it, over all files."""
    most = Counter()
    for path, body in files:
        n = Counter(w for f in drift.parse_file(path, body) or () for w in words_of(f[0]))
        most |= Counter({w: k for w, k in n.items() if k > 1})
    return most


def walk(rows, most=None):
    """Changes by one sequential pass."""
    most = shared(rows) if most is None else most
    field = lambda n, t, x: Field(n, t, x, tuple(sorted((w, most[w]) for w in words_of(n) if w in most)))
    out, state, shape = set(), None, {}
    for path, body in rows:
        found = drift.parse_file(path, body)
        cur, now = {n: t for n, t, _, _ in found}, {n: x for n, _, _, x in found}
        if state is not None:
            gone, come = [n for n in state if n not in cur], [n for n in cur if n not in state]
            ren = {b: a for a, b in match_fields(tuple(sorted(field(n, state[n], shape[n]) for n in gone)), tuple(sorted(field(n, cur[n], now[n]) for n in come)))} if gone and come else {}
            out |= {(path, "removed", n) for n in gone if n not in ren.values()} | {(path, "renamed" if n in ren else "added", n) for n in come}
            new = {}
            for n, t in cur.items():
                old = state.get(ren.get(n, n))
                if t and old and t != old:
                    out.add((path, "retyped", n))
                new[n] = t or old
            state = new
        else:
            state = cur
        shape = now
    return out


def test_drift_equals_a_sequential_pass(spark, sf, monkeypatch):
    m = spark.read.parquet(f"{sf}/metric_files.parquet")
    series, every = {}, []
    for r in m.dropDuplicates(["raw_path"]).collect():
        series.setdefault((r.producer, r.namespace), []).append((r.written_at, r.raw_path, r.body))
        every.append((r.raw_path, r.body))
    want = set().union(*(walk([(p, b) for _, p, b in sorted(s)], shared(every)) for s in series.values()))
    assert {tuple(r) for r in drift.changes(m).collect()} == want and want


def test_drift_across_block_borders(spark, monkeypatch):
    bodies = []
    for i in range(23):
        value = "null" if i in (3, 4, 5, 6) else '"x"' if i > 14 else "1"
        name = "mAP50" if i < 9 else "map_50"
        bodies.append((f"f{i:02}.json", f'{{"{name}": {value}, "epoch": {i}' + (', "lr": 0.1}' if i % 7 else "}")))
    want = walk(bodies)
    for block in (3, 5, 1000):
        monkeypatch.setattr(drift, "BLOCK", block)
        assert {tuple(r) for r in drift.changes(files(spark, bodies)).collect()} == want
    assert ("f15.json", "retyped", "map_50") in want


def test_drift_edge_cases(spark):
    assert drift.changes(files(spark, [("a.json", "{}")]).limit(0)).count() == 0
    odd = [("a.csv", "﻿ Seed , x \n1,\n"), ("b.csv", "Seed,x\r\n1,2\r\n"), ("c.csv", ""), ("d.json", "[1]"), ("e.csv", None), ("f.csv", "Seed,x\n\n1,big\n"), ("g.json", '{"Seed": 1, "x": 5}')]
    f = files(spark, odd)
    f = f.unionByName(f)
    assert {tuple(r) for r in drift.changes(f).collect()} == {("f.csv", "retyped", "x"), ("g.json", "retyped", "x")}
    assert {r.raw_path for r in drift.unreadable_files(f).collect()} == {"c.csv", "d.json"}
    assert drift.consistent_table(f).where("metric = 'x' and number is not null").count() == 2


def test_consistent_table_follows_renames(spark):
    rows = files(spark, [("a.json", '{"grad_norm_clip": 1, "mAP50": 2}'), ("b.json", '{"grad_norm": 3, "mAP50": 4}'), ("c.json", '{"Grad_Norm": 5, "mAP50-95": 6}')])
    rows = rows.unionByName(files(spark, [("d.json", '{"grad_norm_clip": 7}')], "s2"))
    got = {(r.raw_path, r.field): r.metric for r in drift.consistent_table(rows).collect()}
    assert {m for (_, f), m in got.items() if f.lower().startswith("g")} == {"grad_norm"} and len(got) == 7
    assert got["a.json", "mAP50"] == got["b.json", "mAP50"] != got["c.json", "mAP50-95"]


def test_flooding_keeps_different_metrics_apart():
    assert name_similarity(Field("mAP50"), Field("mAP50-95")) == 0
    n = "number"
    assert set(match_fields((("gpu_mem", n), ("map_50_95", n)), (("GPU_mem", n),))) == {("gpu_mem", "GPU_mem")}
    assert match_fields((("params", n),), (("nImages", n),)) == ()
    assert set(match_fields((("lr", n), ("loss_box", n)), (("train/box_loss", n), ("learning_rate", n)))) == {("lr", "learning_rate"), ("loss_box", "train/box_loss")}
    fans = (("loss", 2), ("train", 3))
    assert match_fields((Field("train/box_loss", n, None, fans),), (Field("train/cls_loss", n, None, fans),)) == ()
    assert match_fields((("velocity", n),), (("speed", n),)) == ()  # neither names nor structure say so


def test_flooding_decides_by_structure():
    shape = lambda v: json.dumps(drift.skeleton(v), sort_keys=True)
    box = shape({"x": 1, "y": 2, "label": "a", "sub": {"p": [1, 2], "q": True}})
    same = match_fields((Field("alpha", "object", box), Field("beta", "object", shape({"k": 1}))), (Field("omega", "object", box), Field("gamma", "object", shape({"z": "t"}))))
    assert same == (("alpha", "omega"),)
    # Children whose names are spelled otherwise still carry the score to a parent that shares no word.
    near = match_fields((Field("alpha", "object", shape({"learning_rate": 1, "batchSize": 2, "momentum": 3})),), (Field("omega", "object", shape({"lr": 1, "batch_size": 2, "Momentum": 3})),))
    assert near == (("alpha", "omega"),)
    lists = match_fields((Field("rows", "list", shape([{"a": 1, "b": "x"}, {"a": 2}])),), (Field("items", "list", shape([{"a": 1, "b": "y"}])),))
    assert lists == (("rows", "items"),)
    # The same name over another structure is not enough where the structure speaks against it.
    assert match_fields((Field("opt_cfg", "object", shape({"a": 1, "b": 2, "c": 3})),), (Field("opt_log", "object", shape({"u": "", "v": "", "w": ""})),)) == ()


@pytest.mark.parametrize(
    ("fmt", "raw", "reason"),
    [
        ("yolo", "1 0.5 0.5 0.1 0.1", None), ("yolo", "1\t.5  5e-1 +0.1 1.", None), ("yolo", "0 0.1 0.1 0.2 0.2 0.3 0.3", None), ("yolo", "1 0.5 0.5 0.1", "column_count"), ("yolo", "0 0.1 0.1 0.2 0.2 0.3", "column_count"),
        ("yolo", "1.0 0.5 0.5 0.1 0.1", "number"), ("yolo", "1 0.5 NaN 0.1 0.1", "number"), ("yolo", "1 1e999 0.5 0.1 0.1", "number"), ("yolo", "1 0x1F 0.5 0.1 0.1", "number"), ("yolo", "1 1_0 0.5 0.1 0.1", "number"), ("yolo", "1 1.5 0.5 0.1 0.1", "range"), ("yolo", "1 0.5 0.5 0 0.1", "range"), ("yolo", "77 0.5 0.5 0.1 0.1", "class_id"), ("yolo", "99999999999999999999 0.5 0.5 0.1 0.1", "class_id"), ("yolo", "-1 2 0.5 0.1 0.1", "range"),
        ("csv", 'f,1,0.5,0.5,0.1,0.1,"a ""b"", c"', None), ("csv", "f,1,0.5,0.5,0.1,0.1,", None), ("csv", 'f,1,0.5,0.5,0.1,0.1,"open', "quoting"), ("csv", 'f,1,0.5,0.5,0.1,0.1,"a" b', "quoting"), ("csv", 'f,1,0.5,0.5,0.1,0.1,a "b" c', "quoting"), ("csv", "f,1,0.5,0.5,0.1,0.1,a,b", "column_count"), ("csv", "f,1,0,5,0.5,0.1,0.1,x", "column_count"), ("csv", "f,1,,0.5,0.1,0.1,x", "number"),
        ("yolo", "  ", "skipped"), ("yolo", " # 1 2", "skipped"), ("yolo", None, "skipped"),
    ],
)
def test_broken_lines(spark, fmt, raw, reason):
    if reason == "skipped":
        rows = spark.createDataFrame([(1, "d", "train", "x", 1, fmt, raw)], "line_id long, dataset string, split string, rel_label string, line_no int, fmt string, raw string")
        assert quarantine.parsed_lines(rows).count() == 0
        return
    try:
        cls = quarantine.parse_line(raw, fmt)[1]
        got = None if cls in (0, 1) else "class_id"
    except quarantine.Broken as e:
        got = str(e)
    assert got == reason


def test_broken_lines_table(spark):
    rows = [(i, "d" if i != 3 else None, "train", "x", i, "yolo", r, "z", "z") for i, r in enumerate(["1 0.5 0.5 0.1 0.1", "5 0.5 0.5 0.1 0.1", "x", "1 0.5 0.5 0.1 0.1", "", "#"])] * 2
    lines = spark.createDataFrame(rows, "line_id long, dataset string, split string, rel_label string, line_no int, fmt string, raw string, reason string, coords string")
    classes = spark.createDataFrame([("d", 1), ("d", 1), (None, 5), ("d", None)], "dataset string, cls_id int")
    assert sorted(map(tuple, quarantine.broken_lines(lines, classes).collect())) == [(1, "class_id"), (2, "column_count"), (3, "class_id")]
    assert [r.line_id for r in quarantine.valid_lines(lines, classes).collect()] == [0]
    assert quarantine.broken_lines(lines.limit(0), classes).count() == 0
    assert tuple(quarantine.line_report(lines, classes).where("dataset = 'd'").first())[2:] == (1, 1, 1)


def test_records_over_several_lines(spark):
    assert quarantine.parse_line('f,1,0.5,0.5,0.1,0.1,"a\nb ""c"""', "csv")[4] == 'a\nb "c"'
    for raw, reason in (("f,1,0.5,0.5,0.1,0.1,x\ng,1,0.5,0.5,0.1,0.1,y", "column_count"), ('f,1,0.5,0.5,0.1,0.1,"a\nb', "quoting")):
        with pytest.raises(quarantine.Broken, match=reason):
            quarantine.parse_line(raw, "csv")
    df = spark.createDataFrame([(1, 'a,"b\r\nc"\nd\n'), (2, ""), (3, None), (None, "x")], "file_id int, body string")
    assert sorted(map(tuple, quarantine.file_records(df, "file_id", "body").collect())) == [("1", 0, 'a,"b\nc"'), ("1", 1, "d")]


def test_assembled_records():
    assert list(quarantine.assemble(['a,"b', 'c"', "d", 'e,"f"'])) == ['a,"b\nc"', "d", 'e,"f"']


LABELS = "file_id long, export_id long, dataset string, split string, label_path string, n_bytes int, content string, delivered_at timestamp_ntz, stem string, camera string, pos int"


def test_deliveries(spark):
    same = ["d/part-0001/train/labels/cam1/f_1.txt", "d\\part-0007\\train\\labels\\CAM1\\f_1.TXT", "./d/part-0001/train/labels/cam1//f_1 (1).txt", "file:///x/d/part-1/train/labels/cam1/f_1-copy.txt", "d/part-0001/train/labels/cam1/f_1%2Etxt"]
    rows = [(i, 1, "d", "train", p, 4, "abc\n", at(i), "q", "q", 1) for i, p in enumerate(same)]
    rows[4] = rows[4][:5] + (9, "abc\n") + rows[4][7:]  # cut off
    rows += [(10, 1, "d", "val", same[0], 4, "abc\n", at(0), "q", "q", 1), (11, 1, "d", "train", same[0].replace("cam1", "cam2"), 0, "", at(0), "q", "q", 1), (12, 1, "d", "train", "d/x/cam1/f_2.txt", 3, None, at(0), None, None, None), (13, 1, None, None, None, 1, "a", at(0), "q", "q", 1)]
    df = spark.createDataFrame(rows, LABELS)
    assert {r.file_id for r in compaction.superseded_files(df).collect()} == {0, 1, 2, 4, 12}
    tie = spark.createDataFrame([(5, 1, "d", "train", same[0], 1, "a", at(0), "q", "q", 1), (6, 1, "d", "train", same[1], 1, "b", at(0), "q", "q", 1)], LABELS)
    assert [r.file_id for r in compaction.kept_files(tie).collect()] == [6]
    assert compaction.superseded_files(df.limit(0)).count() == 0


def test_consolidation_loses_and_repeats_nothing(spark, sf, tmp_path):
    f = spark.read.parquet(f"{sf}/label_files.parquet")
    report = compaction.write_consolidated(f, str(tmp_path / "out"), target_bytes=2000).collect()
    assert report and all(r.whole for r in report) and sum(r.parts_count for r in report) < sum(r.files_wanted for r in report)
    sizes = [r.n_bytes for r in compaction.consolidated(f, 2000).collect()]
    assert max(sizes) < 6000


def test_repeated_rows_and_comments_are_not_multiplied(spark, tmp_path):
    text = "# cam1/own remark\n1 0.5 0.5 0.1 0.1\n"
    row = (1, 1, "d", "train", "d/p/train/labels/cam1/a.txt", len(text), text, at(0), "q", "q", 1)
    rows = [row, row, row] + [(2, 1, None, None, "x/cam2/b.txt", 4, "1 2\n", at(0), "q", "q", 1)] * 2 + [(3, 1, "d", None, None, 0, "", at(0), "q", "q", 1), (None, 1, "d", "train", "d/cam9/z.txt", 1, "a", at(0), "q", "q", 1)]
    rows += [(4, 1, "d", "val", "d/cam1/c.txt", 2, "ab", at(1), "q", "q", 1), (4, 1, "d", "val", "d/cam1/c.txt", 3, "abc", at(2), "q", "q", 1), (1, 1, "d", "val", "d/cam1/other.txt", 2, "xy", at(0), "q", "q", 1)]
    df = spark.createDataFrame(rows, LABELS)
    got = {(r.dataset, r.split): (r.n_files, r.n_records, r.file_ids) for r in compaction.consolidated(df).collect()}
    assert got == {("d", "train"): (1, 1, [1]), (None, None): (1, 1, [2]), ("d", None): (1, 0, [3]), ("d", "val"): (2, 2, [4, 1])}
    report = compaction.write_consolidated(df, str(tmp_path / "out")).collect()
    assert len(report) == 4 and all(r.whole and r.files_lost == r.files_repeated == 0 for r in report)
    assert compaction.superseded_files(df).count() == 0
    short = compaction.reconcile(df, compaction.consolidated(df).where("dataset is not null")).where("not whole").collect()
    assert [(r.dataset, r.files_lost, r.records_wanted, r.records_written) for r in short] == [(None, 1, 1, 0)]
    empty = df.limit(0)
    assert compaction.consolidated(empty).count() == 0 and compaction.reconcile(empty, compaction.consolidated(empty)).count() == 0
    assert [r.kept_files for r in compaction.export_parts(df, spark.createDataFrame([(1, "d", 10, 1, 3)], "export_id long, dataset string, export_files_per_dir int, parts_count int, images_exported int")).collect()] == [5]


def test_dewey_links(spark):
    payload = {"runs": {"test_metrics": json.dumps([{"per_class": [None, {"thresholds": []}, {"thresholds": {"iou": 1}}]}, None])}, "models": [{}, {"provenance": {"inputs": [{"a": 1}]}}], "other": [{"metrics": [{"x": 1}]}]}
    rows = [("a", json.dumps(payload), "z"), ("a", json.dumps(payload), "z"), ("b", '{"runs": [', "z"), ("c", None, "z"), (None, "{}", "z"), ("d", '{"runs": NaN}', "z"), ("e", "[" * 30000, "z"), ("f", "", "z")]
    df = spark.createDataFrame(rows, "key string, body string, dewey string")
    got = {tuple(r)[1:] for r in dewey.links(df, "key", "body").collect()}
    base = "runs[0].test_metrics[0]"
    assert got == {("", "runs[0]"), ("runs[0]", base), (base, f"{base}.per_class[1]"), (base, f"{base}.per_class[2]"), (f"{base}.per_class[2]", f"{base}.per_class[2].thresholds[0]"), ("", "models[0]"), ("", "models[1]"), ("models[1]", "models[1].provenance.inputs[0]"), ("", "other[0].metrics[0]")}
    assert dewey.links(df.limit(0), "key", "body").count() == 0


def test_dewey_parents_are_truncations(spark, sf):
    flat = dewey.flatten(spark.read.parquet(f"{sf}/run_payloads.parquet"), "payload_id", "payload").cache()
    rows = flat.where("parent_dewey <> ''").select("dewey", "parent_dewey").collect()
    assert rows and all(r.dewey.startswith(r.parent_dewey + ".") for r in rows)
    child = dewey.flat_table(flat, "runs.test_metrics.per_class", {"ap50": "double"})
    parent = flat.where("schema_path = 'runs.test_metrics'").select("record_key", F.col("dewey").alias("parent_dewey"))
    assert child.join(parent, ["record_key", "parent_dewey"]).count() == child.count() > 0


def test_dewey_tables_hold_every_leaf(spark, sf):
    def leaves(v, name=""):
        v = dewey.as_list(v) if name in dewey.LISTS else v
        below = v.items() if isinstance(v, dict) else ((("", x) for x in v) if isinstance(v, list) else None)
        if below is None:
            return [] if v is None else [v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)]
        return [x for k, y in below for x in leaves(y, k)]

    made = {"id": 7, "runs": [{"test_refs": ["t1", None, "t2"], "test_metrics": {"all": {"map": 0.5, "by": {"x": [[1, 2], [{"y": True}]]}}}}, "odd"], "models": '[{"provenance": {"tool": "t"}}]'}
    rows = [("a", json.dumps(made)), ("b", "[1, {\"c\": null, \"d\": 2}]"), ("c", '"alone"'), ("d", "null")]
    for t, k, x in (("run_payloads", "payload_id", "payload"), ("dataset_catalog", "dataset", "catalog_entry")):
        rows += [(f"{t} {r[0]}", r[1]) for r in spark.read.parquet(f"{sf}/{t}.parquet").select(k, x).distinct().collect()]
    flat = dewey.flatten(spark.createDataFrame(rows, "k string, t string"), "k", "t").collect()
    assert len({(r.record_key, r.dewey) for r in flat}) == len(flat)
    for key, text in rows:
        try:
            want = sorted(leaves(json.loads(text, parse_constant=dewey.no_constant))) if text is not None else []
        except ValueError:
            want = []
        assert sorted(v for r in flat if r.record_key == key for v in r.fields.values()) == want
    at = {(r.child_path, r.kind): (r.fields, r.parent_dewey, r.dewey) for r in flat if r.record_key == "a"}
    assert at["", "root"][:2] == ({"id": "7"}, "") and at["runs[0].test_refs[2]", "value"][0] == {"value": "t2"}
    assert at["runs[0].test_metrics[0].all", "object"][:2] == ({"map": "0.5"}, at["runs[0].test_metrics[0]", "element"][2])
    assert at["models[0].provenance", "object"][0] == {"tool": "t"} and at["runs[1]", "value"][0] == {"value": "odd"}


def test_found_queries_have_their_columns(spark, sf):
    import __spark_entry__

    q = __spark_entry__.queries()
    assert dict(q["p1_found"](spark, sf).dtypes) == {"raw_path": "string", "change": "string", "field": "string"}
    assert dict(q["p3_found"](spark, sf).dtypes) == {"line_id": "bigint", "reason": "string"}
    assert dict(q["p4_found"](spark, sf).dtypes) == {"file_id": "bigint"}
    assert dict(q["p6_found"](spark, sf).dtypes) == {"record_key": "string", "parent_path": "string", "child_path": "string"}
    assert q["p4_found"](spark, sf).where(F.col("file_id").isNull()).count() == 0
