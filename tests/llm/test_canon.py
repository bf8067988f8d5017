import random

import pytest

pytest.importorskip("framewright.llm")
from framewright.llm.canon import MOST, Automaton, ReferenceTrie, limit, new_class_map, unmatched  # noqa: E402
from framewright.llm.queries import QUERIES  # noqa: E402

REF = [("hard_hat", 0), ("hi_vis_vest", 6), ("ladder", 24), ("cut_glove", 8), ("Schutzhelm", 0), ("Gehörschutz", 4), ("каска", 0), ("bare_head", 38), ("bare_hand", 39)]


def osa(a, b):
    d = [[i + j if i * j == 0 else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_equals_edit_distance():
    rng = random.Random(1)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(2))
        m = Automaton(a, MOST)
        s = m.start()
        for c in b:
            s = m.step(s, c)
        want = osa(a, b)
        assert m.distance(s) == (want if want <= MOST else None), (a, b)


def test_trie_equals_brute_force():
    rng = random.Random(2)
    entries = [("".join(rng.choice("abcd") for _ in range(rng.randint(3, 10))), i) for i in range(60)]
    t = ReferenceTrie(entries)
    for _ in range(200):
        w = list(rng.choice(entries)[0])
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice("abcd")
        w = "".join(w)
        want = {i: d for e, i in entries if (d := osa(e, w)) <= limit(len(e))}
        assert t.within(w) == want


@pytest.mark.parametrize(
    ("label", "want"),
    [("Hard-Hat", 0), ("hat, hard", 0), ("HardHat", 0), ("12_hard_hat", 0), ("class: hard hat", 0), ("(hard hat)", 0), ("hard hat (occluded)", 0), ("hi vis vest - partly hidden", 6), ("hаrd hаt", 0), ("GEHOERSCHUTZ", 4), ("gehörschuz", 4), ("КАСКА 2", 0), ("lader", 24), ("Cu Glvoe", 8), ("hard_hat​ #3", 0), ("obj_12", None), ("??", None), ("", None), (None, None), ("head count", None), ("x" * 5000, None), ("bare hend", None), ("bare heaad", 38)],
)
def test_readings(label, want):
    assert ReferenceTrie(REF).read(label)[0] == want


def test_ties_are_reported_not_guessed():
    assert ReferenceTrie([("abcdefgh", 1), ("abcdefgx", 2)]).read("abcdefgy") == (None, 1, "ambiguous")


def test_long_entries_and_long_names():
    words = ["red", "fire", "resistant", "winter", "safety", "jacket"]
    t = ReferenceTrie([*REF, ("_".join(words), 77), ("red fire resistant winter safety trousers", 78), ("a" * 400 + "b", 79)])
    rng = random.Random(3)
    for _ in range(50):
        typed = words[:]
        rng.shuffle(typed)
        at = [i for i, w in enumerate(typed) if len(w) > 4]
        for i in rng.sample(at, 2):
            typed[i] = typed[i][:2] + "q" + typed[i][3:]
        assert t.read(" ".join(typed)) == (77, 2, "near")
    assert t.read("jacket winter red resistent fire safety")[0] == 77
    assert t.read("jackets winters reds resistant fire safety")[0] is None  # three edits
    assert t.read("a" * 399 + "b") == (79, 1, "near") and t.read("a" * 100_000)[0] is None
    for odd in ("(" * 100_000, "x " * 50_000 + "#", "hard hat" + " " * 100_000, "hard hat " + "(a)" * 30_000):
        assert t.read(odd)[0] in (None, 0)
    assert t.read("hard hat" + " " * 100_000 + "- far")[0] == 0 and t.read("ladd")[2] == "shortened" and t.read("har ha")[2] == "none"


def test_shortened_equals_a_walk_over_all():
    rng = random.Random(4)
    entries = [(" ".join("".join(rng.choice("abc") for _ in range(rng.randint(3, 6))) for _ in range(rng.randint(1, 3))), i) for i in range(200)]
    t = ReferenceTrie(entries)
    for _ in range(400):
        typed = [w[: rng.randint(2, 5)] for w in rng.choice(entries)[0].split()]
        least = 3 if len(typed) > 1 else 4
        want = {i for e, i in entries if len(e.split()) == len(typed) and all(len(a) >= least and b.startswith(a) for a, b in zip(typed, e.split(), strict=True))}
        assert t.shortened(typed) == want


def test_mapping_tables(spark, sf):
    ref = spark.createDataFrame([(0, "hard_hat", "g"), (None, "x", "g")], "class_id int, name string, group_name string")
    alias = spark.createDataFrame([("Bauhelm", "hard_hat"), (None, "hard_hat"), ("q", "nothing")], "alias string, canonical string")
    classes = spark.createDataFrame([(1, "d", 3, "Bauhelm", 9), (2, "d", 4, None, 9), (3, None, 4, "x", 9), (4, "d", 5, "dog", 9), (4, "d", 5, "dog", 9)], "class_row_id long, dataset string, cls_id int, name string, class_id int")
    assert sorted(map(tuple, new_class_map(classes, ref, alias).collect()), key=str) == [("d", 3, "Bauhelm", 0), ("d", 4, None, None), ("d", 5, "dog", None)]
    named = classes.selectExpr("'classes' as origin", "name as label").unionByName(spark.createDataFrame([("cvat_boxes", "dog")], "origin string, label string"))
    assert {(r.origin, r.label): r.n_rows for r in unmatched(named, ref, alias).collect()} == {("classes", None): 1, ("classes", "x"): 1, ("classes", "dog"): 2, ("cvat_boxes", "dog"): 1}
    assert new_class_map(classes, ref.limit(0), alias).where("new_id is not null").count() == 0
    assert dict(QUERIES["p5_found"](spark, sf).dtypes) == {"origin": "string", "record_id": "bigint", "class_id": "int"}
