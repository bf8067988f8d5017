import random

import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import overlap  # noqa: E402

SCHEMA = "dataset string, split string, image_id string, content_hash string, ahash long, source_ref string, side string, key long"


def signed(x):
    return x - (1 << 64) if x >= 1 << 63 else x


def test_pairs_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(overlap, "SLOT", 7)
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(40)]
    rows = []
    for i in range(500):
        h = rng.choice(base)
        for _ in range(rng.randint(0, 8)):
            h ^= 1 << rng.randrange(64)
        if i < 120:
            h = base[0]  # a group of copies
        rows.append((rng.choice(["d"] * 5 + ["e", None]), rng.choice(["Train", "training", " test", "VAL", None]), f"i{i:04}", rng.choice([None, f"{i % 60:x}A", f"{i % 60:x}a"]), signed(h) if i % 17 else None, "s", "z", 1))
    rows += rows[:50]
    kind = {"Train": 0, "training": 0, " test": 1, "VAL": 1}
    uniq = list(dict.fromkeys(rows))
    want = set()
    for a in uniq:
        for b in uniq:
            if a[0] and a[0] == b[0] and kind.get(a[1]) == 0 and kind.get(b[1]) == 1:
                near = a[4] is not None and b[4] is not None and ((a[4] ^ b[4]) & (2**64 - 1)).bit_count() <= 5
                if near or a[3] and b[3] and a[3].lower() == b[3].lower():
                    want.add((min(a[2], b[2]), max(a[2], b[2])))
    df = spark.createDataFrame(rows, SCHEMA)
    got = [tuple(r) for r in overlap.found_pairs(df).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 1000
    assert sum(r.near_or_same_pairs for r in overlap.overlap_report(df).collect()) == len(want)


def test_empty(spark):
    assert overlap.found_pairs(spark.createDataFrame([], SCHEMA)).count() == 0
