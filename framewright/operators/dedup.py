"""Duplicates, label-set merging and content signatures of one data collection.

Groups are found by aggregation and joins on hashes; orders inside a group use min_by or max_by, not windows, because a group of copies
may hold a large share of all rows. The LLM-data operators have their own search; these serve the statistics of one table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators.evaluation import iou_matrix
from framewright.operators.skew import lookup_join, stated_tasks
from framewright.session import cut_lineage


def split_rank():
    return F.when(F.col("split") == "train", 0).when(F.col("split") == "val", 1).when(F.col("split") == "test", 2).otherwise(3)


def exact_groups(frames: DataFrame) -> DataFrame:
    """Groups of frames with one size and content hash: files, splits, and whether they cross splits."""
    g = frames.where("content_hash is not null and n_bytes is not null").groupBy("dataset", "n_bytes", "content_hash").agg(F.count(F.lit(1)).alias("n_files"), F.count_distinct("split").alias("n_splits"))
    return g.where("n_files > 1").withColumn("cross_split", F.col("n_splits") > 1)


def duplicate_counts(frames: DataFrame) -> DataFrame:
    """Per data set: exact groups, files in them, and groups that cross splits."""
    return exact_groups(frames).groupBy("dataset").agg(F.count(F.lit(1)).alias("groups"), F.sum("n_files").alias("files"), F.count_if("cross_split").alias("duplicate_cross_split_groups"))


def pruned_duplicates(frames: DataFrame) -> DataFrame:
    """Frames dropped by deduplication: all but the lowest (split rank, image_id) of each hash; null hashes are kept."""
    keep = frames.where("content_hash is not null").groupBy("content_hash").agg(F.min(F.struct(split_rank().alias("r"), "image_id")).alias("k")).select("k.image_id")
    return frames.where("content_hash is not null").join(keep, "image_id", "left_anti")


# Three runs of a 64-bit hash, by first bit and length.
RUNS = ((0, 22), (22, 21), (43, 21))
FILTER = 1 << 17


def run_keys(column: str, neighbours: bool) -> Column:
    """Hashes of (data set, run number, bits of the run) of a 64-bit hash, one a row; with neighbours also with each single bit turned."""
    keys = []
    for i, (first, bits) in enumerate(RUNS):
        value = f"(shiftrightunsigned({column}, {first}) & {(1 << bits) - 1})"
        turned = f"transform(sequence(-1, {bits - 1}), _bit -> xxhash64(dataset, {i}, {value} ^ if(_bit < 0, 0L, shiftleft(1L, _bit))))"
        keys.append(turned if neighbours else f"array(xxhash64(dataset, {i}, {value}))")
    return F.explode(F.expr(f"array_distinct(concat({', '.join(keys)}))"))


def hamming_pairs(left: DataFrame, right: DataFrame, most: int = 5) -> DataFrame:
    """dataset, a, b: all pairs of a hash of left (dataset, a) and one of right (dataset, b) of a data set within `most` (up to 5) bits.

    Of three runs of bits one differs in at most one bit, so the smaller side stores each run and its one-bit neighbours (67 keys) and the
    other asks with its three runs: keys of 21 bits, where equal bands of six would have 10 and a thousand times the candidates. Stored
    keys that no asking hash has are dropped before they are moved, by a bitmap of FILTER words (a broadcast of fixed size). Only
    key and hash are moved; the data set comes back by a join of the few hits with both sides, which also undoes chance meetings of keys.
    """
    if most > 5:
        raise ValueError("three runs serve at most 5 differing bits")
    tasks = stated_tasks(left.sparkSession)
    n_left, n_right = left.count(), right.count()
    few, many, x, y = (left, right, "a", "b") if n_left <= n_right else (right, left, "b", "a")
    # By the hash alone: a partitioning that the inputs may have already would be taken as it is, in one task if they are small.
    stored = few.repartition(tasks, x).select(run_keys(x, True).alias("_key"), x)
    asked = many.repartition(tasks, y).select(run_keys(y, False).alias("_key"), y)
    if 3 * max(n_left, n_right) < 16 * FILTER:  # beyond that most bits are set and nothing would be dropped
        word, bit = F.expr(f"_key & {FILTER - 1}"), F.expr(f"cast(shiftrightunsigned(_key, {FILTER.bit_length() - 1}) & 63 as int)")
        bits = asked.groupBy(word.alias("_word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(_key, {FILTER.bit_length() - 1}) & 63 as int))")).alias("_bits"))
        stored = stored.withColumn("_word", word).join(F.broadcast(bits), "_word").where(F.getbit("_bits", bit) == 1).select("_key", x)
    hits = stored.join(asked, "_key").where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= most).select("a", "b").distinct()
    return hits.join(left, "a").join(right, ["dataset", "b"]).select("dataset", "a", "b")


def near_pairs(frames: DataFrame, most: int = 5) -> DataFrame:
    """dataset, ahash, other: pairs of distinct hash values of a data set within `most` (up to 5) bits, the lower one first."""
    h = cut_lineage(frames.where("ahash is not null").select("dataset", "ahash").distinct())
    found = hamming_pairs(h.select("dataset", F.col("ahash").alias("a")), h.select("dataset", F.col("ahash").alias("b")), most)
    return found.where("a < b").select("dataset", F.col("a").alias("ahash"), F.col("b").alias("other"))


def label_signatures(labels: DataFrame) -> DataFrame:
    """Per image: the md5 of its sorted label lines (boxes and polygons), rounded to 6 digits, and their number."""
    cls = F.coalesce(F.col("cls_id").cast("string"), F.lit("-"))
    box = F.concat_ws(" ", cls, *[F.format_string("%.6f", c) for c in ("cx", "cy", "w", "h")])
    polygon = F.concat_ws(" ", cls, F.array_join(F.transform("points", lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), " "))
    line = F.when(F.col("kind") == "bbox", box).otherwise(polygon)
    return labels.groupBy("dataset", "image_id").agg(F.md5(F.array_join(F.array_sort(F.collect_list(line)), "|")).alias("signature"), F.count(F.lit(1)).alias("n_labels"))


def merged_labels(labels: DataFrame, frames: DataFrame, thr: float = 0.95) -> DataFrame:
    """Union of the box labels of frames with one content hash, without equal lines and same-class boxes of IoU >= thr.

    Arrival order is (split rank, image_id, line_no). Equal lines are removed by aggregation first, so that a large group of copies
    brings each different box once to the fold. A frame without copies keeps its labels and is not folded.
    """
    f = frames.where("content_hash is not null").select("image_id", "content_hash", split_rank().alias("r"))
    copies = f.groupBy("content_hash").agg(F.count(F.lit(1)).alias("_c")).where("_c > 1").select("content_hash", F.lit(True).alias("_many"))
    b = labels.where("kind = 'bbox'").join(f, "image_id").join(copies, "content_hash", "left")
    alone = b.where("_many is null").select("content_hash", "cls_id", "cx", "cy", "w", "h")
    b = b.where("_many")
    once = b.groupBy("content_hash", "cls_id", *[F.round(c, 8).alias(c) for c in ("cx", "cy", "w", "h")]).agg(F.min(F.struct("r", "image_id", "line_no")).alias("o"))

    def fold(x: pd.DataFrame) -> pd.DataFrame:
        x = x.sort_values(["r", "image_id", "line_no"], kind="stable")
        xy = np.stack([x["cx"] - x["w"] / 2, x["cy"] - x["h"] / 2, x["cx"] + x["w"] / 2, x["cy"] + x["h"] / 2], axis=1).astype(float)
        m, cls, kept = iou_matrix(xy, xy), x["cls_id"].to_numpy(), []
        for i in range(len(x)):
            if not any(cls[i] == cls[j] and m[i, j] >= thr for j in kept):
                kept.append(i)
        return x.iloc[kept][["content_hash", "cls_id", "cx", "cy", "w", "h"]]

    flat = once.select("content_hash", "cls_id", "cx", "cy", "w", "h", "o.r", "o.image_id", "o.line_no")
    return alone.unionByName(flat.groupBy("content_hash").applyInPandas(fold, "content_hash string, cls_id int, cx double, cy double, w double, h double"))


def dataset_hashes(frames: DataFrame) -> DataFrame:
    """First 8 hex digits of an md5 per data set over its frames' names and sizes.

    The reference sorts all lines of a data set into one text; here each line's md5 is added up modulo 2^60, which needs no order, so a
    hot data set is summed on many tasks.
    """
    line = F.concat_ws(":", F.col("stem"), F.col("n_bytes").cast("string"))
    part = F.conv(F.substring(F.md5(line), 1, 10), 16, 10).cast("decimal(38,0)")
    return frames.groupBy("dataset").agg(F.substring(F.md5(F.sum(part).cast("string")), 1, 8).alias("dataset_hash"), F.count(F.lit(1)).alias("n"))


def average_hash(pixels, n: int = 64):
    """Bits of an 8x8 grey array (value at or above the mean), first pixel highest, as a signed 64-bit number."""
    mean = F.aggregate(pixels, F.lit(0.0), lambda a, x: a + x) / n
    return F.aggregate(pixels, F.lit(0).cast("long"), lambda a, x: F.shiftleft(a, 1).bitwiseOR(F.when(x >= mean, F.lit(1)).otherwise(F.lit(0)).cast("long")))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def template_similarity(vectors: DataFrame, references: DataFrame) -> DataFrame:
    """Per vector: the best reference of its label and the cosine with it."""
    r = references.select("label", F.col("vec_id").alias("ref_id"), F.col("embedding").alias("ref"))
    x = vectors.join(r, "label").withColumn("sim", F.round(cosine(F.col("embedding"), F.col("ref")), 6))
    return x.groupBy("vec_id").agg(F.max(F.struct("sim", (-F.col("ref_id")).alias("k"))).alias("b")).select("vec_id", (-F.col("b.k")).alias("ref_id"), F.col("b.sim").alias("sim"))


def orientation_score(orb, gradient, similarity):
    return 2 * orb + (100 * (1 - F.least(F.lit(1.0), gradient))).cast("int") + (120 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), (similarity + 1) / 2))).cast("int")


def leaders(pairs: DataFrame) -> DataFrame:
    """Near-duplicate classes as connected hash values: each value with the least value it is linked to, by min-label rounds.

    Rounds halve paths (label of the label), so they grow with the logarithm of the longest chain; each round is cut from its lineage.
    """
    edges = pairs.select("dataset", F.col("ahash").alias("a"), F.col("other").alias("b"))
    edges = cut_lineage(edges.unionByName(edges.select("dataset", F.col("b").alias("a"), F.col("a").alias("b"))))
    label = cut_lineage(edges.groupBy("dataset", "a").agg(F.least(F.min("b"), F.min("a")).alias("leader")))
    while True:
        near = edges.join(label.select("dataset", F.col("a").alias("b"), F.col("leader").alias("l")), ["dataset", "b"]).groupBy("dataset", "a").agg(F.min("l").alias("l"))
        new = label.join(near, ["dataset", "a"]).select("dataset", "a", F.col("leader").alias("old"), F.least("leader", "l").alias("leader"))
        jump = new.select("dataset", F.col("a").alias("leader"), F.col("leader").alias("up"))
        new = cut_lineage(new.join(jump, ["dataset", "leader"], "left").select("dataset", "a", "old", F.least("leader", F.coalesce("up", "leader")).alias("leader")))
        changed = new.where("leader <> old").limit(1).count()
        label = new.drop("old")
        if not changed:
            return label.select("dataset", F.col("a").alias("ahash"), "leader")


def greedy_leaders(edges: DataFrame) -> DataFrame:
    """dataset, node: the nodes that a pass in order would make leaders, where a node near an earlier leader is none.

    Edges (dataset, a, b) lead from the earlier node to the later one. In each round all nodes whose earlier neighbours are settled become
    leaders and settle their later neighbours, which gives the pass's own result without walking the nodes one by one.
    """
    edges = cut_lineage(edges)
    node = lambda df, c: df.select("dataset", F.col(c).alias("node"))
    open_ = cut_lineage(node(edges, "a").unionByName(node(edges, "b")).distinct())
    chosen = open_.limit(0)
    while open_.limit(1).count():
        waiting = node(edges.join(open_.select("dataset", F.col("node").alias("a")), ["dataset", "a"], "left_semi"), "b")
        new = cut_lineage(open_.join(waiting, ["dataset", "node"], "left_anti"))
        taken = node(edges.join(new.select("dataset", F.col("node").alias("a")), ["dataset", "a"], "left_semi"), "b")
        open_ = cut_lineage(open_.join(new.unionByName(taken), ["dataset", "node"], "left_anti"))
        chosen = chosen.unionByName(new)
    return chosen


def near_group_counts(frames: DataFrame) -> DataFrame:
    """Per data set: near-duplicate groups and those that cross splits, as a pass over the frames in order (split, id) finds them.

    A frame that no earlier leader took leads a group of all later frames within 5 bits, taken or not. Frames of one hash have the
    same neighbours, so the pass runs over hashes in the order of their first frames; frames that come later are known from the last one
    of each hash and split.
    """
    order = F.struct(split_rank().alias("r"), "image_id")
    f = frames.where("dataset is not null and ahash is not null").select("dataset", "ahash", order.alias("o"))
    last = f.groupBy("dataset", "ahash", F.col("o.r").alias("r")).agg(F.max("o").alias("last"))
    first = cut_lineage(f.groupBy("dataset", "ahash").agg(F.min("o").alias("first")))
    pairs = cut_lineage(near_pairs(frames.where("dataset is not null")))
    at = lambda c, n: first.select("dataset", F.col("ahash").alias(c), F.col("first").alias(n))
    both = pairs.join(at("ahash", "x"), ["dataset", "ahash"]).join(at("other", "y"), ["dataset", "other"])
    edges = both.select("dataset", F.when(F.col("x") < F.col("y"), F.col("ahash")).otherwise(F.col("other")).alias("a"), F.when(F.col("x") < F.col("y"), F.col("other")).otherwise(F.col("ahash")).alias("b"))
    linked = pairs.select("dataset", F.col("ahash").alias("node")).unionByName(pairs.select("dataset", F.col("other").alias("node"))).distinct()
    alone = first.select("dataset", F.col("ahash").alias("node")).join(linked, ["dataset", "node"], "left_anti")
    led = greedy_leaders(edges).unionByName(alone).join(first.select("dataset", F.col("ahash").alias("node"), "first"), ["dataset", "node"])
    near = pairs.select("dataset", F.col("ahash").alias("node"), F.col("other").alias("ahash")).unionByName(pairs.select("dataset", F.col("other").alias("node"), "ahash"))
    own = led.select("dataset", "node", F.col("node").alias("ahash"))
    later = near.unionByName(own).join(led, ["dataset", "node"]).join(last, ["dataset", "ahash"]).where(F.col("last") > F.col("first"))
    group = later.groupBy("dataset", "node").agg(F.bool_or(F.col("r") != F.col("first.r")).alias("cross"))
    return group.groupBy("dataset").agg(F.count(F.lit(1)).alias("near_groups"), F.count_if("cross").alias("near_cross_split_groups"))


def farthest_first(vectors: DataFrame, k: int) -> DataFrame:
    """Per label, k values spread by Hamming distance (k-centre): rounds of one aggregate each, start at the least id.

    Each round keeps every value's distance to the nearest chosen one and takes the farthest; no group is collected.
    """
    state = cut_lineage(vectors.select("label", "vec_id", "sig").where("sig is not null").withColumn("near", F.lit(65)).withColumn("turn", F.lit(None).cast("int")))
    for turn in range(k):
        pick = state.where("turn is null").groupBy("label").agg(F.max(F.struct("near", (-F.col("vec_id")).alias("v"), "sig")).alias("p")).select("label", (-F.col("p.v")).alias("v"), F.col("p.sig").alias("s"))
        x = lookup_join(state, pick, ["label"], ["vec_id"])
        near = F.least("near", F.coalesce(F.bit_count(F.col("sig").bitwiseXOR(F.col("s"))), F.col("near")))
        state = cut_lineage(x.select("label", "vec_id", "sig", near.alias("near"), F.when(F.col("vec_id") == F.col("v"), F.lit(turn)).otherwise(F.col("turn")).alias("turn")))
    return state.where("turn is not null").select("label", "turn", "vec_id")


def best_first(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key by an order, for keys with few rows."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
