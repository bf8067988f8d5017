import datetime as dt
import math
import random
from collections import Counter

import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import proportions  # noqa: E402

LINES = "dataset string, split string, image_id string, line_no int, cls_id int, loaded_at timestamp_ntz, pos int, need string"
PLANS = "plan_id long, dataset string, split string, sample_size int, cls_id int, target_pct int, min_items int, pos int"


def test_sample_meets_targets_and_floors(spark):
    rng = random.Random(9)
    t = dt.datetime(2025, 1, 1)
    lines, i = [], 0
    for cls, n in ((0, 3000), (1, 400), (2, 12), (3, 2), (None, 30)):
        for _ in range(n):
            i += 1
            lines.append(("d", rng.choice(["train", "TRAIN", "training"]), f"i{i // 3}", i, cls, t, 1, "x"))
    lines += [x[:5] + (t + dt.timedelta(days=1),) + x[6:] for x in lines[:200]] + [("d", None, "n", 1, 3, t, 1, "x"), (None, "train", "n", 2, 3, t, 1, "x")]
    plans = [(1, "d", "Train", 200, 0, 61, 0, 5), (1, "d", "Train", 200, 1, 33, 0, 5), (1, "d", "Train", 200, 2, 5, 8, 5), (1, "d", "Train", 200, 3, 1, 4, 5), (2, "d", "val", 10, 0, 100, 0, 5), (3, "d", "train", 0, 0, 0, 0, 5), (4, "d", "train", 7, 1, 33, 1, 5), (4, "d", "train", 7, 9, 67, None, 5), (None, "d", "train", 5, 0, 100, 0, 5)]
    plans += plans[:1]
    sample, report = proportions.draw(spark.createDataFrame(lines, LINES), spark.createDataFrame(plans, PLANS))
    rows = [tuple(r) for r in sample.collect()]
    assert len(rows) == len(set(rows))
    drawn = Counter((r[0], r[3]) for r in rows)
    assert drawn[1, 0] in (122, 123) and drawn[1, 1] in (66, 67) and drawn[1, 2] in (10, 11) and drawn[1, 3] == 2
    rep = {(r.plan_id, r.cls_id): r for r in report.collect()}
    assert len(rep) == 8 and all(rep[k].drawn == drawn[k] for k in rep)
    assert all(r.drawn >= min(r.need, r.available) for r in rep.values())
    assert {k for k, r in rep.items() if r.short} == {(1, 3), (2, 0), (4, 9)}
    assert rep[4, 1].need == math.ceil(33 * 7 / 100)


def test_floors_are_repaired_inside_the_sample(spark):
    t = dt.datetime(2025, 1, 1)
    lines = [("d", "train", f"i{c}_{i}", 1, c, t, 1, "x") for c, n in ((0, 900), (1, 700), (2, 60), (3, 40), (4, 5)) for i in range(n)]
    plans = []
    for p, size in ((1, 100), (2, 137), (3, 1000), (4, 30)):
        plans += [(p, "d", "train", size, c, pct, least, 1) for c, pct, least in ((0, 53, 0), (1, 31, 10), (2, 13, 25), (3, 3, 12))]
    plans += [(5, "d", "train", 200, 0, 50, 0, 1), (5, "d", "train", 200, 4, 50, 10, 1)]
    sample, report = proportions.draw(spark.createDataFrame(lines, LINES), spark.createDataFrame(plans, PLANS))
    got = {}
    for r in report.collect():
        got.setdefault(r.plan_id, {})[r.cls_id] = r.drawn
    assert {p: sum(x.values()) for p, x in got.items()} == {1: 100, 2: 137, 3: 930, 4: 47, 5: 105}
    assert got[1][2] == 25 and got[1][3] == 12 and got[2][2] == 25 and got[2][3] == 12 and got[4] == {0: 0, 1: 10, 2: 25, 3: 12}
    assert got[3] == {0: 530, 1: 310, 2: 60, 3: 30}
    assert {(r.plan_id, r.cls_id) for r in report.where("short").collect()} == {(3, 2), (5, 4)}
    assert sample.distinct().count() == sum(sum(x.values()) for x in got.values())


def test_every_line_is_equally_likely(spark):
    t = dt.datetime(2025, 1, 1)
    lines = spark.createDataFrame([("d", "train", f"i{i}", 1, i % 2, t, 1, "x") for i in range(40)], LINES)
    plans = spark.createDataFrame([(p, "d", "train", 10, c, 50, 0, 1) for p in range(60) for c in (0, 1)], PLANS)
    got = Counter(r.image_id for s in range(3) for r in proportions.draw(lines, plans, seed=s)[0].collect())
    assert len(got) == 40 and sum(got.values()) == 1800 and min(got.values()) > 15


def test_empty(spark):
    s, r = proportions.draw(spark.createDataFrame([], LINES), spark.createDataFrame([], PLANS))
    assert s.count() == 0 and r.count() == 0
