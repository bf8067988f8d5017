import random
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import packing  # noqa: E402


def test_nnls_finds_the_optimum():
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, x = rng.random((12, 8)), np.maximum(0, rng.normal(size=8))
        got = packing.nnls(a, a @ x)
        assert np.allclose(got, x, atol=1e-6)
        b = rng.random(12)
        g = packing.nnls(a, b)
        w = a.T @ (b - a @ g)
        assert g.min() >= 0 and w.max() < 1e-6 and abs(w[g > 0]).max(initial=0) < 1e-6


@pytest.mark.parametrize("capacity", [7, 100, 1000])
def test_histogram_packing_is_whole_and_tight(capacity):
    rng = random.Random(capacity)
    h = Counter(min(capacity, 1 + int(rng.expovariate(3 / capacity))) for _ in range(5000))
    p = packing.Packing(dict(h), capacity)
    load, seen = defaultdict(int), Counter()
    for length, start, end, shift, per, bundle, bundles in p.rows:
        for pos in range(start, end):
            load[(bundle + (pos + shift) // per) // bundles] += length
            seen[length, pos] += 1
    assert set(seen.values()) == {1} and Counter(k[0] for k in seen) == h
    assert max(load.values()) <= capacity and set(load) == set(range(p.n_containers))
    assert sum(load.values()) / (capacity * p.n_containers) > 0.97


@pytest.mark.parametrize(("capacity", "mean"), [(1000, 40), (8192, 120), (4097, 30), (300, 2)])
def test_bundles_fill_large_containers(capacity, mean):
    rng = random.Random(capacity)
    h = Counter(min(capacity, 1 + int(rng.expovariate(1 / mean))) for _ in range(20_000))
    p = packing.Packing(dict(h), capacity)
    load, seen, by_pattern = Counter(), Counter(), 0
    for length, start, end, shift, per, bundle, bundles in p.rows:
        by_pattern += (end - start) * (bundles > 1)
        for pos in range(start, end):
            load[(bundle + (pos + shift) // per) // bundles] += length
            seen[length, pos] += 1
    assert set(seen.values()) == {1} and Counter(k[0] for k in seen) == h
    assert max(load.values()) <= capacity and set(load) == set(range(p.n_containers))
    assert sum(load.values()) / (capacity * p.n_containers) > 0.99 and by_pattern > 0.6 * 20_000


def test_documents_are_packed_once_and_whole(spark):
    rng = random.Random(4)
    texts = ["word " * rng.choice([1, 3, 20, 60, 400]) for _ in range(300)] + [None, "", "x" * 3000, "word " * 128]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, length int")
    docs = docs.unionByName(docs.where("doc_id < 5"))
    specs = spark.createDataFrame([(1, "a", 128), (2, "b", 1000), (2, "b", 1000), (3, "c", 0), (4, "d", None)], "spec_id int, purpose string, capacity_tokens int")
    rows = packing.packed(docs, specs).collect()
    enc = packing.encoding(packing.TOKENIZER)
    want = {i: len(enc.encode_ordinary(t)) for i, t in enumerate(texts) if t}
    for spec, cap in ((1, 128), (2, 1000)):
        mine = [r for r in rows if r.spec_id == spec]
        per, load = defaultdict(list), Counter()
        for r in mine:
            per[r.doc_id].append((r.token_from, r.n_tokens))
            load[r.container_id] += r.n_tokens
        assert max(load.values()) <= cap and sorted(load) == list(range(len(load)))
        for i, n in want.items():
            at = 0
            for start, k in sorted(per[i]):
                assert start == at
                at += k
            assert at == n and len(per[i]) == -(-n // cap)
        assert set(per) == set(want)
    assert {r.spec_id for r in rows} == {1, 2}
    fill = {r.spec_id: r.fill for r in packing.fill_report(packing.packed(docs, specs), specs).collect()}
    assert min(fill.values()) > 0.9


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    specs = spark.createDataFrame([(1, "a", 128)], "spec_id int, purpose string, capacity_tokens int")
    assert packing.packed(docs, specs).count() == 0 and packing.packed(docs, specs.limit(0)).count() == 0
