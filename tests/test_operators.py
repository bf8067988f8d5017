"""Operators that SQL cannot express, or whose edge cases the tables do not hold, against brute force."""

import json
import random

import numpy as np
from pyspark.sql import functions as F

from framewright.operators import balance, catalog, dedup, evaluation, runs


def test_near_pairs_equal_brute_force(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(63) for _ in range(30)]
    values = set(base)
    for v in base:
        for _ in range(4):
            x = v
            for _ in range(rng.randint(1, 7)):
                x ^= 1 << rng.randrange(63)
            values.add(x)
    values = sorted(values)
    want = {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 5}
    df = spark.createDataFrame([("d", v) for v in values] + [("d", None), ("e", values[0])], "dataset string, ahash long")
    assert {(r.ahash, r.other) for r in dedup.near_pairs(df).collect()} == want and want


def test_leaders_are_components(spark):
    pairs = [(i, i + 1) for i in range(0, 40)] + [(100, 101)]
    got = {r.ahash: r.leader for r in dedup.leaders(spark.createDataFrame([("d", a, b) for a, b in pairs], "dataset string, ahash long, other long")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100}


def test_greedy_matching_equals_a_loop(spark):
    rng = np.random.default_rng(4)
    def boxes(n):
        xy = rng.random((n, 2)) * 60
        return np.concatenate([xy, xy + 10 + rng.random((n, 2)) * 30], axis=1)
    p, g = boxes(40), boxes(25)
    conf, pc, gc = rng.random(40), rng.integers(0, 2, 40), rng.integers(0, 2, 25)
    pred = spark.createDataFrame([("i", i, int(pc[i]), float(conf[i]), *map(float, p[i])) for i in range(40)] + [("j", 0, 0, 0.5, 0.0, 0.0, 1.0, 1.0)], "image_id string, pred_idx int, cls_id int, conf double, x1 double, y1 double, x2 double, y2 double")
    gt = spark.createDataFrame([("i", i, int(gc[i]), *map(float, g[i])) for i in range(25)] + [("k", 0, 0, 0.0, 0.0, 1.0, 1.0)], "image_id string, gt_idx int, cls_id int, x1 double, y1 double, x2 double, y2 double")
    m, used, want = evaluation.iou_matrix(p, g), set(), {}
    for i in np.argsort(-conf, kind="stable"):
        free = [j for j in range(25) if j not in used and pc[i] == gc[j] and m[i, j] >= 0.4]
        if free:
            j = max(free, key=lambda j: (m[i, j], -j))
            used.add(j)
            want[int(i)] = j
    rows = evaluation.greedy_matches(pred, gt, 0.4).collect()
    assert {r.pred_idx: r.gt_idx for r in rows if r.image_id == "i" and r.iou is not None} == want and want
    assert {(r.image_id, r.pred_idx, r.gt_idx) for r in rows if r.image_id in "jk"} == {("j", 0, None), ("k", None, 0)}
    kept = {r.pred_idx for r in evaluation.nms(pred.where("image_id = 'i'"), 0.3).collect()}
    mm = evaluation.iou_matrix(p, p)
    loop = []
    for i in np.argsort(-conf, kind="stable"):
        if all(pc[i] != pc[j] or mm[i, j] <= 0.3 for j in loop):
            loop.append(i)
    assert kept == {int(i) for i in loop}


def test_optimal_lrp_of_a_known_case(spark):
    flags = spark.createDataFrame([("a", 0, 0, 0.9, 0.9, 1), ("a", 0, 1, 0.6, None, 0), ("a", 0, 2, 0.4, 0.8, 1)], "image_id string, cls_id int, pred_idx int, conf double, iou double, tp int")
    gt = spark.createDataFrame([("a", 0, 0), ("a", 0, 1)], "image_id string, cls_id int, gt_idx int")
    r = {x.level: x for x in evaluation.optimal_lrp(evaluation.threshold_curves(flags, gt)).collect()}["0"]
    # At 0.4 and below: (0.1 + 0.2) / 0.5 + 1 false positive over 3; above 0.6: 0.1 / 0.5 + 1 miss over 2.
    assert abs(r.lrp - min((0.3 / 0.5 + 1) / 3, (0.1 / 0.5 + 1) / 2)) < 1e-6


def test_merged_labels_fold_copies(spark):
    frames = spark.createDataFrame([("a", "h", "train"), ("b", "h", "val"), ("c", "x", "val")], "image_id string, content_hash string, split string")
    rows = [("a", 1, 0, 0.5, 0.5, 0.2, 0.2), ("b", 1, 0, 0.5, 0.5, 0.2, 0.2), ("b", 2, 0, 0.5001, 0.5, 0.2, 0.2), ("b", 3, 1, 0.5, 0.5, 0.2, 0.2), ("c", 1, 0, 0.1, 0.1, 0.1, 0.1), ("c", 2, 0, 0.1, 0.1, 0.1, 0.1)]
    labels = spark.createDataFrame([(*r, "bbox") for r in rows], "image_id string, line_no int, cls_id int, cx double, cy double, w double, h double, kind string")
    got = sorted((r.content_hash, r.cls_id, r.cx) for r in dedup.merged_labels(labels, frames).collect())
    assert got == [("h", 0, 0.5), ("h", 1, 0.5), ("x", 0, 0.1), ("x", 0, 0.1)]


def test_budget_parts_and_names(spark):
    df = spark.createDataFrame([(i, "s" if i < 5 else "t", 3) for i in range(8)], "i int, stem string, cost int")
    assert {r.i for r in balance.budget_prefix(df, ["i"], "cost", 10).collect()} == {0, 1, 2}
    assert {r.i: r.unique_name for r in balance.unique_names(df, [], "stem", ["i"]).collect()}[4] == "s__5"
    assert {r.i: r.part_no for r in balance.parts(df, [], ["i"], 3).collect()}[6] == 2


def test_patched_json_and_ancestors(spark):
    df = spark.createDataFrame([('{"a": ["ds_a", "x/ds_a/y", "ds_ab"], "b": {"c": 1}}',), ("{bad",), (None,)], "j string")
    got = [r.v for r in df.select(catalog.patch_json(F.col("j"), "ds_a", "new").alias("v")).collect()]
    assert got == ['{"a": ["new", "x/new/y", "ds_ab"], "b": {"c": 1}}', "{bad", None]
    edges = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", "b"), ("c", "c"), ("d", None)], "output string, input string")
    assert {(r.output, r.ancestor, r.depth) for r in catalog.ancestors(edges).collect()} == {("c", "b", 1), ("c", "a", 2), ("b", "a", 1), ("a", "b", 1)}


def test_lineage_reads_uneven_shapes(spark):
    one = {"command": "merge", "inputs": [{"name": "a", "hash": "1"}, {"name": "b", "hash": "2"}]}
    lone, text = {"command": "filter", "inputs": {"name": "c", "hash": "3"}}, {"command": "split", "inputs": json.dumps([{"name": "d", "hash": "4"}])}
    entries = [("w", {"history": [one, None, lone, text]}), ("x", {"history": lone}), ("y", {"history": json.dumps([text, one])}), ("z", {"history": None}), ("v", {"other": {"history": [one]}}), ("w", {"history": [lone]})]
    df = spark.createDataFrame([(d, json.dumps(e)) for d, e in entries] + [("u", '{"history": ['), ("t", None)], "dataset string, catalog_entry string")
    merge, c, d = [("merge", "a", "1"), ("merge", "b", "2")], ("filter", "c", "3"), ("split", "d", "4")
    want = [("w", 0, *m) for m in merge] + [("w", 2, *c), ("w", 3, *d), ("w", 0, *c), ("x", 0, *c), ("y", 0, *d)] + [("y", 1, *m) for m in merge]
    assert sorted(map(tuple, catalog.lineage(df).collect())) == sorted(want)


def test_rename_plan_reaches_every_reference(spark):
    import __spark_entry__
    from framewright.plans import q_catalog

    texts = [json.dumps({"history": json.dumps([{"name": "ds_a"}]), "p": "x\\ds_a\\y"}), '{"n":  "ds_ab"}', '{"name": "ds_a", ', '{"a":  1}', None]
    df = spark.createDataFrame([(t,) for t in texts], "j string")
    got = {r.old_value: r.new_value for r in catalog.rename_plan({"t": (df, "j")}, "ds_a", "new", ("t",)).collect()}
    assert got == {texts[0]: json.dumps({"history": json.dumps([{"name": "new"}]), "p": "x\\new\\y"}), texts[2]: None}
    sf = "/root/testdata/sf0.01"
    plan = [r for q in ("rename_plan", "rename_documents") for r in __spark_entry__.queries()[q](spark, sf).collect()]
    want = {"runs"} | {f"{t}.dataset" for t in ("annotations", "dataset_catalog", "images", "label_files")} | {"runs.dataset_name", "run_payloads.payload", "run_payloads.run_dir", "metric_files.raw_path", "label_files.label_path"}
    assert want <= {r.table_name for r in plan} and len(plan) == len(set(plan))
    assert all(f"{t}.{c}" in {f"{n}.{x}" for n, cs in q_catalog.REFERENCES.items() for x in cs.split()} for t in q_catalog.REFERENCES for c in spark.read.parquet(f"{sf}/{t}.parquet").columns if c == "dataset")


def test_ancestors_of_long_chains(spark):
    edges = spark.createDataFrame([(f"v{i + 1}", f"v{i}") for i in range(25)] + [("v0", "v24")], "output string, input string")
    got = {(r.output, r.ancestor): r.depth for r in catalog.ancestors(edges).collect()}
    assert got["v25", "v0"] == 25 and got["v0", "v1"] == 24 and len(got) == 25 * 24 + 25


def test_report_table_helpers(spark):
    df = spark.createDataFrame([(1, 1, None, "1"), (2, 2, None, "2")], "a int, b int, c int, d string")
    assert runs.without_empty_columns(df).columns == ["a", "b", "d"]
    assert runs.without_repeated_columns(df).columns == ["a", "c"]
    sel = spark.createDataFrame([("r1",), ("r2",)], "run string")
    rows = spark.createDataFrame([("r1", 5), ("r3", 6)], "run string, v int")
    assert {(r.run, r.v, r.status) for r in runs.fill_missing(sel, rows, "run").collect()} == {("r1", 5, "ok"), ("r2", None, "missing")}
    x = runs.with_fallback(spark.createDataFrame([("d1", "n1"), ("d2", "n2")], "run_dir string, run_name string"), spark.createDataFrame([("d1", 1.0)], "run_dir string, fps double"), spark.createDataFrame([("n2", 2.0), ("n1", 9.0)], "run_name string, fps double"), "fps")
    assert {r.run_dir: r.fps for r in x.collect()} == {"d1": 1.0, "d2": 2.0}


def test_budget_admission_equals_a_walk(spark):
    import random

    from framewright.operators import balance

    rng = random.Random(7)
    rows = [(i, rng.choice([None, 0.0, rng.randint(1, 40) * 1.0]), rng.randint(0, 3)) for i in range(150)] + [(900, 1e9, 0)]
    used, want = 0.0, set()
    for i, c, _ in sorted(rows, key=lambda r: (r[2], r[0])):
        if used + (c or 0.0) <= 300:
            used += c or 0.0
            want.add(i)
    df = spark.createDataFrame(rows, "id int, c double, o int").withColumn("pos", F.lit("x"))
    got = balance.budget_admission(df.drop("pos"), ["o", "id"], "c", 300).collect()
    assert {r.id for r in got} == want and len(got) == len(want)
    assert balance.budget_admission(df.drop("pos").limit(0), ["o", "id"], "c", 300).count() == 0


def test_greedy_leaders_equal_a_walk(spark):
    import random

    from framewright.operators import dedup

    rng = random.Random(8)
    edges = sorted({(d, a, b) for d in ("x", "y") for a, b in (sorted(rng.sample(range(60), 2)) for _ in range(70))})
    want = set()
    for d in ("x", "y"):
        taken = set()
        for n in sorted({v for e in edges if e[0] == d for v in e[1:]}):
            if n not in taken:
                want.add((d, n))
                taken |= {b for e, a, b in edges if e == d and a == n}
    df = spark.createDataFrame(edges, "dataset string, a long, b long")
    assert set(map(tuple, dedup.greedy_leaders(df).collect())) == want
    assert dedup.greedy_leaders(df.limit(0)).count() == 0
