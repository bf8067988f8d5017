"""Balancing, repeat-factor and weighted sampling, head trimming and splitting.

Random choices are uniforms from md5 over the row's key and a seed, so any engine and any partitioning draws the same rows. Windows are
partitioned by (data set, class, hash group) or closed forms are used, so that no hot class is walked in one task; global orders go
through framewright.operators.ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.ordered import numbered
from framewright.operators.skew import lookup_join
from framewright.session import cut_lineage
from framewright.operators.statistics import effective_number


def uniform(*columns: str, seed: int = 0) -> Column:
    """A uniform in [0, 1) from eight hex digits of md5(columns:seed)."""
    key = F.concat_ws(":", *[F.col(c).cast("string") for c in columns], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def hash_bucket(seed: str, column: str, groups: Column | int) -> Column:
    """md5(seed:value) reduced to a group, on 60 bits."""
    return F.pmod(F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col(column))), 1, 15), 16, 10).cast("long"), F.lit(groups) if isinstance(groups, int) else groups)


def class_weights(counts: DataFrame, mode: str, beta: float = 0.999, min_count: int = 1, keys: tuple[str, ...] = ("dataset",)) -> DataFrame:
    """Weight per class, of mean 1 in its data set. Modes: inverse, sqrt, effective."""
    n = F.greatest(F.col("n"), F.lit(min_count), F.lit(1))
    raw = {"inverse": 1 / n, "sqrt": 1 / F.sqrt(n), "effective": 1 / F.greatest(effective_number(n, beta), F.lit(1e-12))}[mode]
    return counts.withColumn("_r", raw).withColumn("weight", F.col("_r") / F.avg("_r").over(Window.partitionBy(*keys))).drop("_r")


def head_damping(counts: DataFrame, quantile: float = 0.85, least: float = 0.35) -> DataFrame:
    """Multiplier under 1 for classes above the quantile of their data set's counts; 1 under three classes."""
    q = counts.groupBy("dataset").agg(F.count(F.lit(1)).alias("_k"), F.expr(f"percentile(n, {quantile})").alias("_q"), F.expr("percentile(n, 0.5)").alias("_m"))
    damp = F.greatest(F.lit(least), F.least(F.lit(1.0), F.sqrt(F.col("_m") / F.col("n"))))
    return counts.join(q, "dataset").withColumn("multiplier", F.when((F.col("_k") >= 3) & (F.col("n") > F.col("_q")), damp).otherwise(F.lit(1.0))).drop("_k", "_q", "_m")


def image_weights(labels: DataFrame, weights: DataFrame, low: float, high: float) -> DataFrame:
    """Per image: max, mean and sum of its instances' class weights, clipped; images without classed labels weigh 1."""
    w = labels.join(weights.select("dataset", "cls_id", "weight"), ["dataset", "cls_id"], "left")
    cut = lambda c: F.coalesce(F.greatest(F.lit(low), F.least(F.lit(high), c)), F.lit(1.0))
    return w.groupBy("dataset", "image_id").agg(cut(F.max("weight")).alias("w_max"), cut(F.avg("weight")).alias("w_mean"), cut(F.sum("weight")).alias("w_sum"))


def repeat_factors(labels: DataFrame, threshold: float, power: float, cap: int, instance_aware: bool = False, seed: int = 0) -> DataFrame:
    """Per train image: repeat factor and whole repeats after stochastic rounding, 1 to cap.

    Image-based: r = max over classes of (t / share of images)^p. Instance-aware: mean over instances, share of instances.
    """
    train = labels.where("split = 'train' and cls_id is not null")
    per = train.groupBy("dataset", "image_id", "cls_id").agg(F.count(F.lit(1)).alias("k"))
    total = per.groupBy("dataset").agg(F.count_distinct("image_id").alias("_i"), F.sum("k").alias("_l"))
    freq = per.groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("_ci"), F.sum("k").alias("_cl")).join(total, "dataset")
    share = F.col("_cl") / F.col("_l") if instance_aware else F.col("_ci") / F.col("_i")
    factor = freq.select("dataset", "cls_id", F.greatest(F.lit(1.0), F.pow(F.lit(threshold) / share, F.lit(power))).alias("r"))
    rows = per.join(factor, ["dataset", "cls_id"])
    r = F.sum(F.col("r") * F.col("k")) / F.sum("k") if instance_aware else F.max("r")
    out = rows.groupBy("dataset", "image_id").agg(r.alias("factor"))
    whole = F.floor("factor") + (uniform("image_id", seed=seed) < F.col("factor") - F.floor("factor")).cast("int")
    return out.withColumn("repeats", F.least(F.lit(cap), F.greatest(F.lit(1), whole)).cast("int"))


def expand(images: DataFrame, repeats: str = "repeats") -> DataFrame:
    """Each row as often as its repeats say, with copy_no."""
    return images.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col(repeats))))


def sample_without_replacement(items: DataFrame, weight: str, n: int, key: str, seed: int = 0) -> DataFrame:
    """n rows by weighted sampling (Efraimidis and Spirakis: the largest u^(1/w)); a top-n, never a full sort."""
    score = F.log(F.greatest(uniform(key, seed=seed), F.lit(1e-12))) / F.greatest(F.col(weight), F.lit(1e-12))
    return items.withColumn("_s", F.round(score, 9)).orderBy(F.desc("_s"), key).limit(n).drop("_s")


def sample_with_replacement(items: DataFrame, weight: str, draws: int, key: str, seed: int = 0) -> DataFrame:
    """Draw counts per row for `draws` inverse-CDF draws at systematic points: prefix sums over the whole table, no single-task window."""
    placed = numbered(items, [], [key], weight)
    total = items.agg(F.sum(weight).alias("t")).first().t or 0
    x = placed.withColumn("_t", F.lit(total))
    u = (F.conv(F.substring(F.md5(F.lit(f"start:{seed}")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0))
    low, high = F.col("cum") / F.col("_t") * draws, (F.col("cum") + F.col(weight)) / F.col("_t") * draws
    return x.withColumn("draws", (F.ceil(high - u) - F.ceil(low - u)).cast("int")).where("draws > 0").drop("_t", "cum", "pos")


def sampler_probabilities(labels: DataFrame) -> DataFrame:
    """Weighted loader: class weight = all / class instances, image = mean over instances, p = share within the data set."""
    c = labels.where("split = 'train' and cls_id is not null")
    n = c.groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))
    total = n.groupBy("dataset").agg(F.sum("n").alias("_t"))
    w = c.join(n.join(total, "dataset").select("dataset", "cls_id", (F.col("_t") / F.col("n")).alias("_cw")), ["dataset", "cls_id"]).groupBy("dataset", "image_id").agg(F.avg("_cw").alias("_w"))
    return w.join(w.groupBy("dataset").agg(F.sum("_w").alias("_s")), "dataset").select("dataset", "image_id", (F.col("_w") / F.col("_s")).alias("p"))


def head_trim(labels: DataFrame, mult: float, seed: str, groups: int = 32, min_count: int = 0, max_fraction: float = 1.0) -> DataFrame:
    """Train lines dropped from classes above mult x median: one line at a time from the fullest hash group.

    The loop has a closed form: a line's level is its place from the end of its group, and the lines of the highest levels go first,
    lower groups first within a level. Levels are counted per class, so the cut is found on (class, level) counts, not on lines.
    """
    train = labels.where("split = 'train' and cls_id is not null")
    n = train.groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))
    med = n.groupBy("dataset").agg(F.floor(mult * F.floor(F.expr("percentile(n, 0.5)"))).alias("cap"))
    excess = F.least(F.col("n") - F.col("cap"), F.floor(F.col("n") * max_fraction), F.greatest(F.lit(0), F.col("n") - min_count))
    over = n.join(med, "dataset").where("n > cap").select("dataset", "cls_id", "n", excess.alias("excess"))
    lines = train.join(over, ["dataset", "cls_id"]).withColumn("g", hash_bucket(seed, "image_id", F.least(F.lit(groups), F.col("n"))))
    # Places in a group and sums over levels by distributed numbering: a class with a third of all lines fills no task.
    lines = numbered(lines, ["dataset", "cls_id", "g"], ["image_id", "line_no"], total=True).withColumn("level", F.col("total") - F.col("pos"))
    cells = lines.groupBy("dataset", "cls_id", "level").agg(F.count(F.lit(1)).alias("_c")).withColumn("_down", -F.col("level"))
    cells = numbered(cells, ["dataset", "cls_id"], ["_down"], "_c").select("dataset", "cls_id", "level", F.col("cum").alias("before"))
    at = Window.partitionBy("dataset", "cls_id", "level").orderBy("g")  # at most `groups` lines
    out = lines.join(cells, ["dataset", "cls_id", "level"]).withColumn("place", F.col("before") + F.row_number().over(at))
    return out.where("place <= excess").select("dataset", "cls_id", "image_id", "line_no")


def tail_priority(labels: DataFrame, gamma: float, alpha: float) -> DataFrame:
    """Per train image: rarity of its rarest class, and soft weight by class frequency."""
    c = labels.where("split = 'train' and cls_id is not null")
    n = c.groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))
    top = n.groupBy("dataset").agg(F.max("n").alias("top"), F.sum("n").alias("total"))
    w = n.join(top, "dataset").select("dataset", "cls_id", F.pow(F.col("top") / F.greatest(F.lit(1), "n"), F.lit(gamma)).alias("p"), F.pow(F.col("total") / F.col("n"), F.lit(alpha)).alias("s"))
    return c.join(w, ["dataset", "cls_id"]).groupBy("dataset", "image_id").agg(F.max("p").alias("priority"), F.avg("s").alias("soft_weight"))


def split_by_ratio(items: DataFrame, bucket: list[str], key: str, train: float, val: float, seed: int = 0) -> DataFrame:
    """train, val or test for each item of a bucket, by md5 order and whole bounds int(n * ratio); hot buckets stay spread."""
    total = items.groupBy(*bucket).agg(F.count(F.lit(1)).alias("_n"))
    placed = numbered(items.withColumn("_h", F.md5(F.concat_ws(":", F.col(key), F.lit(str(seed))))), bucket, ["_h", key])
    low, high = F.floor(F.col("_n") * train), F.floor(F.col("_n") * (train + val))
    return placed.join(total, bucket).withColumn("new_split", F.when(F.col("pos") < low, "train").when(F.col("pos") < high, "val").otherwise("test")).drop("_n", "_h", "pos")


def one_split_per_source(frames: DataFrame, key: str) -> DataFrame:
    """Frames with the split their source keeps: train before val before test (aggregate and join back, no window over a source)."""
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2)
    best = frames.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(rank).alias("_b"))
    return frames.join(best, key, "left").withColumn("kept_split", F.when(F.col("_b") == 0, "train").when(F.col("_b") == 1, "val").when(F.col("_b") == 2, "test")).withColumn("moved", ~F.col("kept_split").eqNullSafe(F.col("split"))).drop("_b")


def eval_targets(labels: DataFrame, share: float = 0.1) -> DataFrame:
    """Per data set and class with 3 or more train images: evaluation images it has, and how many it needs."""
    per = labels.where("cls_id is not null and split is not null").groupBy("dataset", "cls_id").agg(F.count_distinct("image_id").alias("images"), F.count_distinct(F.when(F.col("split") != "train", F.col("image_id"))).alias("eval_images"))
    need = F.when(F.col("images") < 3, 0).otherwise(F.greatest(F.lit(1), F.bround(share * F.col("images"), 0))).cast("long")
    return per.withColumn("needed", need).withColumn("missing", F.greatest(F.lit(0), F.col("needed") - F.col("eval_images")))


def eval_cover(labels: DataFrame, share: float = 0.1, seed: int = 0) -> DataFrame:
    """Train images to move to val so that each class reaches its target: per class the first missing images by md5 order.

    An image may serve several classes; it is listed once with the classes it was taken for. Classes are ranked apart, so the order of
    the reference's greedy loop plays no part and nothing is collected.
    """
    short = eval_targets(labels, share).where("missing > 0").select("dataset", "cls_id", "missing")
    images = labels.where("split = 'train' and cls_id is not null").select("dataset", "cls_id", "image_id").distinct()
    images = lookup_join(images, short, ["dataset", "cls_id"], ["image_id"], "inner")
    ranked = numbered(images.withColumn("_h", F.md5(F.concat_ws(":", F.col("image_id"), F.lit(str(seed))))), ["dataset", "cls_id"], ["_h", "image_id"])
    return ranked.where("pos < missing").groupBy("dataset", "image_id").agg(F.array_sort(F.collect_set("cls_id")).alias("for_classes"))


def budget_prefix(items: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """Items admitted in order while the running total stays within the budget (stops at the first miss)."""
    placed = numbered(items, [], order, cost)
    return placed.where(F.col("cum") + F.col(cost) <= budget).drop("cum", "pos")


def budget_admission(items: DataFrame, order: list[str], cost: str, budget: float) -> DataFrame:
    """Items admitted in order where one that would exceed the budget is skipped and later ones that still fit are taken.

    Rounds of prefix sums: all items up to the first miss are admitted at once, and what no longer fits at all is left out, so a round
    ends with at least one item less and as a rule with the budget all but used. Null and negative costs count as 0.
    """
    left = cut_lineage(items.withColumn("_cost", F.greatest(F.coalesce(F.col(cost), F.lit(0)).cast("double"), F.lit(0.0))))
    admitted, room = left.limit(0), float(budget)
    while True:
        placed = cut_lineage(numbered(left.where(F.col("_cost") <= room), [], order, "_cost"))
        first = placed.where(F.col("cum") + F.col("_cost") > room).agg(F.min("pos")).first()[0]
        taken = placed if first is None else placed.where(F.col("pos") < first)
        admitted = admitted.unionByName(taken.drop("pos", "cum"))
        if first is None:
            return admitted.drop("_cost")
        room -= taken.agg(F.sum("_cost")).first()[0] or 0.0
        left = placed.where(F.col("pos") > first).drop("pos", "cum")


def scaled_copies(base: int, weight: Column, strength: float) -> Column:
    return F.bround(base * (1 + weight * strength), 0).cast("int")


def trigger_probability(weight: Column, base: float) -> Column:
    return F.greatest(F.lit(0.02), F.least(F.lit(1.0), base * F.sqrt(weight)))


def unique_names(items: DataFrame, keys: list[str], stem: str, order: list[str]) -> DataFrame:
    """stem, stem__2, stem__3 for items of one stem, in order (numbered without a window over a hot stem)."""
    placed = numbered(items, [*keys, stem], order)
    return placed.withColumn("unique_name", F.when(F.col("pos") == 0, F.col(stem)).otherwise(F.concat(F.col(stem), F.lit("__"), (F.col("pos") + 1).cast("string")))).drop("pos")


def parts(items: DataFrame, keys: list[str], order: list[str], per_part: Column | int) -> DataFrame:
    """part_no of each item when every part holds exactly per_part items."""
    return numbered(items, keys, order).withColumn("part_no", F.floor(F.col("pos") / per_part)).drop("pos")
