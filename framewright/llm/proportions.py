"""A sample whose categories have target proportions: systematic unequal-probability sampling with floors.

Lines are ordered at random within sorted categories, inclusion probabilities are summed along that order, and a line is drawn where
the sum crosses an integer shifted by one random start per plan. All sums are integers (hundredths of a line), so no rounding
depends on the order of addition. Within a category all probabilities are equal, so the sum at a line is start + rank * probability:
the ranks come from one numbering of all strata (prefix sums across partitions, shared by all plans), the starts from prefix sums
over the categories, and the crossings are computed per plan and category. A plan therefore never scans its population again, and a
hot data set is spread by rank.

Floors are repaired inside the sample: a category drawn below its minimum is raised to it, and as many lines are given back by the
categories that stand above theirs, in proportion to what they have to give; only where the minima alone exceed the sample does the
draw grow. A category that has fewer lines than asked for gives all it has and is reported; of what is then free in the sample,
others get only what lifts them to their own share rounded up, so the proportions among them hold. Categories whose number was
changed are drawn again evenly spaced, from the same start.

Defined results: a label line counts once (its latest load); rows without image_id, line_no, data set, split or class count for
nothing; a plan for a split or class without lines draws none and is reported short; null sizes, shares and minima count as 0;
repeated target rows count once; rows of one plan may name several data sets and splits and share its start; empty tables give empty
results; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.splits import canonical_split
from framewright.operators.ordered import numbered
from framewright.operators.skew import lookup_join
from framewright.session import cut_lineage

STRATUM = ["dataset", "split", "cls_id"]
CHUNK = 10_000


def label_lines(annotations: DataFrame) -> DataFrame:
    """image_id, line_no, dataset, split, cls_id: each label line once, as last loaded."""
    last = F.max(F.struct("loaded_at", "dataset", canonical_split(F.col("split")).alias("split"), "cls_id"))
    once = annotations.where("image_id is not null and line_no is not null").groupBy("image_id", "line_no").agg(last.alias("r"))
    return once.select("image_id", "line_no", "r.dataset", "r.split", "r.cls_id").where("dataset is not null and split is not null and cls_id is not null")


def targets_of(plans: DataFrame) -> DataFrame:
    """plan_id, stratum, quota (hundredths of a line), least (min_items), size (of the sample) and need (whole lines) of each target row."""
    quota = F.coalesce("target_pct", F.lit(0)).cast("long") * F.coalesce("sample_size", F.lit(0)).cast("long")
    t = plans.where("plan_id is not null").select("plan_id", "dataset", canonical_split(F.col("split")).alias("split"), "cls_id", quota.alias("quota"), F.coalesce("min_items", F.lit(0)).cast("long").alias("least"), F.coalesce("sample_size", F.lit(0)).cast("long").alias("size"))
    t = t.groupBy("plan_id", *STRATUM).agg(F.max("quota").alias("quota"), F.max("least").alias("least"), F.max("size").alias("size"))
    return t.withColumn("need", F.greatest("least", F.expr("(quota + 99) div 100")))


def random_order(*columns: str) -> Column:
    """Sixty bits of an md5 over the columns: an order that any engine can repeat."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns])), 1, 15), 16, 10).cast("long")


def ranked_lines(annotations: DataFrame, plans: DataFrame, seed: int) -> DataFrame:
    """Lines of the strata that any plan asks for, with their random rank in the stratum."""
    asked = targets_of(plans).where("dataset is not null and split is not null").select(*STRATUM).distinct()
    lines = label_lines(annotations).join(asked, STRATUM, "left_semi").withColumn("_s", F.lit(seed))
    lines = lines.withColumn("_r", random_order("image_id", "line_no", "_s")).drop("_s")
    return cut_lineage(numbered(lines, STRATUM, ["_r", "image_id", "line_no"]).drop("_r"))


def quotas(plans: DataFrame, ranked: DataFrame, seed: int) -> DataFrame:
    """Each target with available lines, n (sum of its inclusion probabilities), start and u (hundredths), k (crossings) and draw."""
    strata = ranked.groupBy(*STRATUM).agg((F.max("pos") + 1).alias("available"))
    t = targets_of(plans).join(strata, STRATUM, "left").withColumn("available", F.coalesce("available", F.lit(0).cast("long")))
    t = t.withColumn("n", F.least("quota", F.col("available") * 100)).withColumn("_s", F.lit(seed))
    t = t.withColumn("u", random_order("plan_id", "_s") % 100).drop("_s")
    t = numbered(t, ["plan_id"], STRATUM, "n").drop("pos").withColumnRenamed("cum", "start")
    # Integers m with start < 100 m + u <= start + n.
    t = t.withColumn("m0", F.floor((F.col("start") - F.col("u")) / 100) + 1).withColumn("k", F.floor((F.col("start") + F.col("n") - F.col("u")) / 100) - F.col("m0") + 1)
    t = t.withColumn("raise", F.greatest(F.least("least", "available") - F.col("k"), F.lit(0)))
    # What a category could give back, and what it lacks of its need beyond the minimum; one that is short gives nothing.
    enough = F.col("available") >= F.col("need")
    t = t.withColumn("room", F.when(enough, F.greatest(F.col("k") - F.col("least"), F.lit(0))).otherwise(0))
    t = t.withColumn("lack", F.greatest(F.least("need", "available") - F.col("k") - F.col("raise"), F.lit(0)))
    per = t.groupBy("plan_id").agg((F.sum("k") + F.sum("raise") - F.max("size")).alias("over"), F.sum("room").alias("rooms"), F.sum("lack").alias("lacks"))
    per = per.select("plan_id", (F.col("over") > 0).alias("back"), F.when(F.col("over") > 0, F.least("over", "rooms")).otherwise(F.least(-F.col("over"), "lacks")).alias("move"), F.greatest(F.when(F.col("over") > 0, F.col("rooms")).otherwise(F.col("lacks")), F.lit(1)).alias("of"))
    t = lookup_join(t, per, ["plan_id"], STRATUM, "inner").withColumn("part", F.when(F.col("back"), F.col("room")).otherwise(F.col("lack")))
    t = numbered(t, ["plan_id"], STRATUM, "part").drop("pos")
    share = lambda upto: F.expr(f"cast(move as decimal(19,0)) * cast({upto} as decimal(19,0)) div of")
    moved = (share("cum + part") - share("cum")) * F.when(F.col("back"), -1).otherwise(1)
    return t.withColumn("draw", F.col("k") + F.col("raise") + moved).select("plan_id", *STRATUM, "need", "available", "n", "start", "u", "m0", "k", "draw")


def drawn_ranks(t: DataFrame) -> DataFrame:
    """plan_id, stratum, pos of every line to draw, from the rows of quotas; in chunks, so that no task expands a large draw alone."""
    each = t.where("draw > 0").withColumn("_c", F.explode(F.expr(f"sequence(0L, (draw - 1) div {CHUNK})")))
    each = each.withColumn("j", F.explode(F.expr(f"sequence(_c * {CHUNK}, least(_c * {CHUNK} + {CHUNK}, draw) - 1)")))
    # The first rank whose sum of probabilities reaches the crossing: ceil(at * available / n) - 1.
    crossing = F.expr("(cast((m0 + j) * 100 + u - start as decimal(19,0)) * cast(available as decimal(18,0)) - 1) div n")
    spaced = F.expr("cast(j * 100 + u as decimal(19,0)) * cast(available as decimal(18,0)) div (draw * 100)")
    pos = F.when(F.col("draw") == F.col("k"), crossing).otherwise(spaced).cast("long")
    return each.select("plan_id", *STRATUM, pos.alias("pos"))


def draw(annotations: DataFrame, plans: DataFrame, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """(sample: plan_id and label lines, report: one row per target with need, available, drawn and short).

    short is read off the draw: a category fell short if fewer lines than needed were drawn although all it has were.
    """
    ranked = ranked_lines(annotations, plans, seed)
    t = cut_lineage(quotas(plans, ranked, seed))
    sample = drawn_ranks(t).join(ranked, [*STRATUM, "pos"]).select("plan_id", *STRATUM, "image_id", "line_no")
    # Added up with the targets instead of joined to them: null classes and splits meet, and a hot plan is no burden.
    keys = ["plan_id", *STRATUM]
    rows = sample.groupBy(*keys).agg(F.count(F.lit(1)).alias("drawn")).withColumns({"need": F.lit(0).cast("long"), "available": F.lit(0).cast("long")})
    both = t.select(*keys, F.lit(0).cast("long").alias("drawn"), "need", "available").unionByName(rows)
    report = both.groupBy(*keys).agg(F.sum("need").alias("need"), F.sum("available").alias("available"), F.sum("drawn").alias("drawn"))
    return sample, report.withColumn("short", (F.col("drawn") < F.col("need")) & (F.col("drawn") == F.col("available")))
