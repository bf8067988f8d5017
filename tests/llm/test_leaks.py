import random

import numpy as np
import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import leaks  # noqa: E402
from framewright.llm.text import fold, words  # noqa: E402

RNG = random.Random(8)
VOCAB = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrstx"]
PASSAGES = [" ".join(RNG.choice(VOCAB) for _ in range(n)) for n in (60, 40, 25, 9)]


def document(piece):
    pad = lambda: " ".join(RNG.choice(VOCAB) for _ in range(80))
    return f"{pad()}. {piece}, {pad()}"


def changed(passage, at, how):
    w = passage.split()
    for i in at:
        w[i] = {"change": "qqq", "misspell": w[i] + "zz", "drop": ""}[how]
    return " ".join(x for x in w if x)


CASES = [
    (PASSAGES[0], {1}), (" ".join(PASSAGES[0].split()[10:31]), {1}), (" ".join(PASSAGES[0].split()[10:27]), set()), (changed(PASSAGES[0], (5, 15, 25, 35, 45, 55), "change"), {1}), (changed(PASSAGES[1], (6, 13, 26, 33), "misspell"), {2}), (changed(PASSAGES[1], (6, 13, 26, 33), "drop"), {2}),
    (changed(PASSAGES[0], range(4, 60, 5), "change"), set()), (PASSAGES[2].upper().replace(" ", "\n> "), {3}), (PASSAGES[2].replace("a", "а").replace(" ", " <b>", 1), {3}), (PASSAGES[3], {4}), (" ".join(PASSAGES[3].split()[:8]), set()), (f"{PASSAGES[1]} {PASSAGES[2]}", {2, 3}), ("", set()),
]


def test_planted_passages(spark):
    docs = [(i, document(p), "x") for i, (p, _) in enumerate(CASES)] + [(100, None, "x"), (101, "", "x"), (102, "z" * 200_000, "x"), (103, document(PASSAGES[0]) * 40, "x"), (None, PASSAGES[0], "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(i + 1, p) for i, p in enumerate(PASSAGES)] + [(9, None), (10, ""), (None, "x"), (1, PASSAGES[0])], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.found_passages(df, items).collect()}
    assert got == {(i, k) for i, (_, want) in enumerate(CASES) for k in want} | {(103, 1)}
    assert leaks.found_passages(df.limit(0), items).count() == 0 and leaks.found_passages(df, items.limit(0)).count() == 0


def test_items_in_blocks_give_the_same(spark):
    df = spark.createDataFrame([(i, document(p)) for i, p in enumerate(PASSAGES)], "doc_id long, text string")
    items = spark.createDataFrame(list(enumerate(PASSAGES)), "item_id long, passage string")
    one = set(map(tuple, leaks.found_passages(df, items).collect()))
    assert set(map(tuple, leaks.found_passages(df, items, most_fingerprints=60).collect())) == one and len(one) == 4


def test_short_passages(spark):
    short = {n: " ".join(RNG.choice(VOCAB) for _ in range(n)) for n in (1, 3, 5, 7, 8, 12, 17)}
    short[20] = " ".join(RNG.choice(VOCAB) + RNG.choice(VOCAB) for _ in range(20))
    docs, want = [], set()
    for n, p in short.items():
        for k in range(min(n, 4)):
            # k words changed inside: the first k at even distances, so that no long run stays untouched
            at = [(j + 1) * n // (k + 1) for j in range(k)]
            docs.append((len(docs), document(changed(p, [x if x < n - 1 else n - 2 for x in at], "change"))))
            if n > 1 and k <= leaks.edits_of(n):
                want.add((docs[-1][0], n))
    docs += [(900, document(" ".join(short[12].split()[:11]))), (901, document(changed(short[20], (0, 19), "misspell"))), (902, document(changed(short[20], (0,), "change")))]
    items = spark.createDataFrame([(n, p) for n, p in short.items() if n > 1], "item_id long, passage string")
    got = {(r.doc_id, r.item_id) for r in leaks.found_passages(spark.createDataFrame(docs, "doc_id long, text string"), items).collect()}
    assert got == want | {(901, 20)}


def test_one_word_passage_is_found_wherever_the_word_is(spark):
    docs = spark.createDataFrame([(1, "the Зебра, here"), (2, "no")], "doc_id long, text string")
    assert [r.doc_id for r in leaks.found_passages(docs, spark.createDataFrame([(1, "зебра")], "item_id long, passage string")).collect()] == [1]


def test_no_true_case_fails_the_weighted_gate(spark):
    own = [RNG.choice(VOCAB) + "q" for _ in range(6)]
    common = [RNG.choice(VOCAB) for _ in range(14)]
    passage = [*common[:7], *own[:3], *common[7:], *own[3:]]
    items = [(0, " ".join(passage))] + [(i, " ".join([*common[:7], *(f"{RNG.choice(VOCAB)}{i}" for _ in range(6)), *common[7:]])) for i in range(1, 201)]
    text = changed(" ".join(passage), (8, 18), "change")
    got = leaks.found_passages(spark.createDataFrame([(7, document(text))], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, passage string"))
    assert (7, 0) in {(r.doc_id, r.item_id) for r in got.collect()}


def test_gate_and_windows_by_brute_force():
    for _ in range(300):
        n = RNG.randint(4, 45)
        item = [RNG.choice(VOCAB[:40]) for _ in range(n)]
        index = leaks.PassageIndex([(1, " ".join(item)), (2, " ".join(RNG.choice(VOCAB[:40]) for _ in range(30)))])
        length = min(n, leaks.STRETCH)
        begin = RNG.randint(0, n - length)
        piece = item[begin : begin + length]
        for at in RNG.sample(range(1, length - 1), min(leaks.edits_of(n), length - 2)):
            piece[at] = RNG.choice(["qqq", "", "zz yy"])
        doc = [RNG.choice(VOCAB[40:]) for _ in range(30)] + " ".join(x for x in piece if x).split() + [RNG.choice(VOCAB[40:]) for _ in range(30)]
        assert any(i == 0 for _, i in index.candidates([doc]))
        assert index.items[0][1].similar(doc)
        if "yy" not in doc:
            assert (0, 1) in {x[:2] for x in index.held([doc])}


def test_index_finds_all_within_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 2**64, 3000, dtype=np.uint64)
    asked = prints[:400].copy()
    for k in range(400):
        for b in rng.choice(64, k % 6, replace=False):
            asked[k] ^= np.uint64(1) << np.uint64(b)
    q, p = leaks.HammingIndex(prints).near(asked)
    want = {(i, j) for i in range(400) for j in np.flatnonzero(np.bitwise_count(prints ^ asked[i]) <= leaks.RADIUS)}
    assert set(zip(q.tolist(), p.tolist(), strict=True)) == want


def test_folding():
    assert fold("Ре-\nfuel&amp;ling") == "pefuel&ling"
    assert words("<i>cut‑proof</i> gl­ove\n> next") == ["cutproof", "glove", "next"]
