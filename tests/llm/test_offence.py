import random

import numpy as np
import pytest

pytest.importorskip("framewright.llm")
from framewright.llm import offence  # noqa: E402

RNG = random.Random(6)
THINGS = ["forklift mast", "hard hat", "rubber boot", "dust mask", "cable drum", "site fence"]
CLEAN = ["Please redraw the box around the {}.", "The {} is hidden behind the crane.", "Frames with a {} were moved to train.", "Do not merge {} and ladder; both are counted.", "The word idiot is hidden by the filter of the {} tool."]
RUDE = ["You are a useless {}, nobody asked for you.", "Shut up, you {}, and fix your boxes.", "I will break your fingers, you {}."]
NAMES = ["idiot", "moron", "dimwit", "halfwit", "cretin"]


def doc(rude):
    s = [RNG.choice(CLEAN).format(RNG.choice(THINGS)) for _ in range(RNG.randint(2, 6))]
    if rude:
        s.insert(RNG.randrange(len(s)), RNG.choice(RUDE).format(RNG.choice(NAMES)))
    return " ".join(s)


def test_held_out_documents(spark):
    train = [(i, doc(i % 5 == 0), "chat", 0.5) for i in range(400)]
    test = [(1000 + i, doc(i % 4 == 0), "mail", 0.5) for i in range(200)]
    odd = [(5000, None, "chat", 0.1), (5001, "", "chat", 0.1), (5002, "word " * 50_000, None, 0.1), (5003, ("fine. " * 3000) + "You are a useless m o r o n, nobody asked for you.", "chat", 0.1), (5004, "SHUT UP, you imbeciiiile, and fix your bоxes", "chat", 0.1), (None, "x", "chat", 0.1)]
    docs = spark.createDataFrame(train + test + odd, "doc_id long, text string, source string, score double")
    votes = [(i, (i % 5 == 0) ^ (i % 97 == 1), "r") for i in range(400)] + [(3, None, "r"), (None, 1, "r"), (7, 1, "q"), (99999, 1, "r")]
    labels = spark.createDataFrame([(d, None if o is None else int(o), r) for d, o, r in votes], "doc_id long, offensive int, reviewer string")
    scores = offence.scored(docs, labels)
    got = {r.doc_id: (r.score, r.offensive) for r in scores.collect()}
    hits = [got[1000 + i][1] == (i % 4 == 0) for i in range(200)]
    assert sum(hits) >= 194
    assert got[5000] == (None, False) and got[5001] == (None, False) and not got[5002][1] and got[5003][1] and got[5004][1]
    rates = {r.source: r.n_documents for r in offence.source_rates(scores).collect()}
    assert sum(rates.values()) == 605


def test_without_labels_or_documents(spark):
    docs = spark.createDataFrame([(1, "text", "a")], "doc_id long, text string, source string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, offensive int")
    assert [r.offensive for r in offence.scored(docs, labels).collect()] == [False]
    assert offence.scored(docs.limit(0), labels).count() == 0


def test_models_are_distributions():
    m = offence.Model(offence.GramSet(["abab", "abba"]).of(), offence.GramSet(["bcbc", "cccb"]).of())
    # The letter after "ab": each of the alphabet, or the end; the rest is for letters never seen.
    total = [sum(float(m.probabilities(["ab" + x])[0][c][2]) for x in ("a", "b", "c", "")) for c in range(2)]
    assert 0.9 < total[0] <= 1.0 and 0.8 < total[1] <= 1.0  # the second never saw "ab"


def test_counts_of_chosen_texts_are_counts_of_their_own():
    rng = np.random.default_rng(5)
    texts = ["".join(rng.choice(list("abcde "), rng.integers(1, 40))) for _ in range(60)]
    chosen = rng.random(60) < 0.5
    for a, b in zip(offence.GramSet(texts).of(chosen), offence.GramSet([t for t, on in zip(texts, chosen, strict=True) if on]).of(), strict=True):
        assert all((x == y).all() for x, y in zip(a, b, strict=True))


def test_lookup_finds_what_is_there():
    keys = np.unique(np.random.default_rng(6).integers(0, 2**64, 5000, dtype=np.uint64))
    look = offence.Lookup(keys)
    look.bits, tight = np.uint64(4), offence.Lookup.__new__(offence.Lookup)  # few slots: most keys meet another
    tight.__dict__ |= {"n": look.n, "bits": np.uint64(4), "keys": look.keys, "slot": np.full(16, look.n, np.int32)}
    s = tight.slots(keys)
    tight.slot[s[::-1]] = np.arange(len(keys), dtype=np.int32)[::-1]
    late = np.flatnonzero(tight.slot[s] != np.arange(len(keys)))
    tight.late_keys, tight.late = keys[late], late.astype(np.int32)
    for x in (offence.Lookup(keys), tight):
        assert (x.places(keys) == np.arange(len(keys))).all() and (x.places(keys + np.uint64(1)) == len(keys)).all()


def test_plain_spelling():
    assert offence.sentences("you are a m-o-r-o-n, n.u.d.e") == ["you are a moron nude"]
    assert offence.sentences("d r e c k s a c k! idi0t. stuuuupid") == ["drecksack", "idiot", "stupid"]
