import random

from pyspark.sql import functions as F

from framewright.operators.ordered import numbered
from framewright.operators.skew import lookup_join, spread


def test_numbering_matches_a_plain_window(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 8 + ["a", None]), i, rng.randint(0, 9) or None) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, i int, v int")
    got = {(r.k, r.i): (r.pos, r.cum) for r in numbered(df.repartition(7), ["k"], ["i"], "v").collect()}
    assert len(got) == 3000
    want, seen = {}, {}
    for k, i, v in sorted(rows, key=lambda r: r[1]):
        n, s = seen.get(k, (0, 0))
        want[k, i] = (n, s)
        seen[k] = (n + 1, s + (v or 0))
    assert got == want


def test_numbering_without_keys_and_empty(spark):
    df = spark.range(500).withColumn("v", F.lit(2))
    assert sorted((r.pos, r.cum) for r in numbered(df, [], ["id"], "v").collect()) == [(i, 2 * i) for i in range(500)]
    assert numbered(df.limit(0), ["v"], ["id"]).count() == 0


def test_lookup_join_salted_equals_broadcast(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else str(i)) for i in range(600)] + [(999, None)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int")
    a = sorted(lookup_join(big, small, ["k"], ["i"]).collect(), key=lambda r: r.i)
    b = sorted(lookup_join(big, small, ["k"], ["i"], max_rows=0, salts=4).collect(), key=lambda r: r.i)
    assert [(r.i, r.v) for r in a] == [(r.i, r.v) for r in b] and len(a) == 601


def test_spread_keeps_rows(spark):
    assert spread(spark.range(10).coalesce(1), ["id"]).count() == 10
