"""Same or near-same frames across splits.

A frame has no words; its 64-bit average hash is its text, and position-tagged runs of bits are the n-grams. Evaluation frames
are indexed by the hashes of their runs, the training frames are scanned for hits, and containment is the share of equal bits:
at least (64 - MAX_BITS) of 64. Three runs of 21 and 22 bits are used: of five differing bits one run holds at most one, so one side (the
one with fewer hashes, as a rule the evaluation frames) stores each run and its one-bit neighbours and the other asks with three
(framewright.operators.dedup.hamming_pairs). No pair is lost.

Frames with one hash form a class first; classes are compared, and only hits are written out as pairs, with large classes cut into
slots. Defined results: rows without data set, image_id or split count for nothing; null hashes match nothing; several listings of
an image count once; empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.functions.splits import canonical_split
from framewright.operators.dedup import hamming_pairs
from framewright.session import cut_lineage

MAX_BITS = 5
SLOT = 2000


def frames(images: DataFrame) -> DataFrame:
    """dataset, image_id, side (train or eval), content hash in lower case, ahash: distinct."""
    split = canonical_split(F.col("split"))
    side = F.when(split == "train", "train").when(split.isNotNull(), "eval")
    return images.select("dataset", "image_id", side.alias("side"), F.lower("content_hash").alias("content_hash"), "ahash").where("dataset is not null and image_id is not null and side is not null").distinct()


def classes_of(rows: DataFrame, column: str, side: str) -> DataFrame:
    """dataset, key and number of slots of each class of frames with one value on one side."""
    return rows.where((F.col("side") == side) & F.col(column).isNotNull()).groupBy("dataset", F.col(column).alias("key")).agg(F.count(F.lit(1)).alias("n")).select("dataset", "key", F.ceil(F.col("n") / SLOT).cast("int").alias("slots"))


def class_pairs(rows: DataFrame) -> DataFrame:
    """dataset, train_key, eval_key and slots of all pairs of ahash classes within MAX_BITS."""
    train, held = (classes_of(rows, "ahash", side) for side in ("train", "eval"))
    hits = hamming_pairs(train.select("dataset", F.col("key").alias("a")), held.select("dataset", F.col("key").alias("b")), MAX_BITS)
    pairs = hits.select("dataset", F.col("a").alias("train_key"), F.col("b").alias("eval_key"))
    for side, c in (("train", train), ("eval", held)):
        pairs = pairs.join(c.select("dataset", F.col("key").alias(f"{side}_key"), F.col("slots").alias(f"{side}_slots")), ["dataset", f"{side}_key"])
    return pairs


def members(rows: DataFrame, column: str, side: str) -> DataFrame:
    slot = F.xxhash64("image_id")
    return rows.where((F.col("side") == side) & F.col(column).isNotNull()).select("dataset", F.col(column).alias(f"{side}_key"), slot.alias("_h"), F.col("image_id").alias(f"{side}_id"))


def written_out(pairs: DataFrame, rows: DataFrame, column: str) -> DataFrame:
    """Class pairs as frame pairs. A class of k slots is met by k copies of the pair, so no task gets a whole large class."""
    for side in ("train", "eval"):
        own = members(rows, column, side)
        size = classes_of(rows, column, side).select("dataset", F.col("key").alias(f"{side}_key"), "slots")
        own = own.join(size.where("slots > 1"), ["dataset", f"{side}_key"], "left")
        own = own.withColumn("_slot", F.pmod("_h", F.coalesce("slots", F.lit(1)))).drop("_h", "slots")
        pairs = pairs.withColumn("_slot", F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"{side}_slots").cast("long") - 1))).join(own, ["dataset", f"{side}_key", "_slot"]).drop("_slot")
    return pairs.select("dataset", "train_id", "eval_id")


def cross_split_pairs(images: DataFrame) -> DataFrame:
    """dataset, train_id, eval_id, exact: every pair of a train frame and a val or test frame that is the same or nearly so."""
    # Both searches and the writing out read the frames: brought down to their distinct rows once.
    rows = cut_lineage(frames(images))
    near = written_out(class_pairs(rows), rows, "ahash").withColumn("exact", F.lit(False))
    t, e = classes_of(rows, "content_hash", "train"), classes_of(rows, "content_hash", "eval")
    same = t.withColumnRenamed("slots", "train_slots").join(e.withColumnRenamed("slots", "eval_slots"), ["dataset", "key"])
    same = same.select("dataset", F.col("key").alias("train_key"), F.col("key").alias("eval_key"), "train_slots", "eval_slots")
    equal = written_out(same, rows, "content_hash").withColumn("exact", F.lit(True))
    return equal.unionByName(near).where("train_id <> eval_id").groupBy("dataset", "train_id", "eval_id").agg(F.bool_or("exact").alias("exact"))


def found_pairs(images: DataFrame) -> DataFrame:
    p = cross_split_pairs(images)
    return p.select(F.least("train_id", "eval_id").alias("image_a"), F.greatest("train_id", "eval_id").alias("image_b")).distinct()


def overlap_report(images: DataFrame) -> DataFrame:
    """Per data set, evaluation split and source of the evaluation frame: pairs, exact pairs and frames concerned."""
    pairs = cross_split_pairs(images)
    split = canonical_split(F.col("split"))
    source = images.where("dataset is not null and image_id is not null").select("dataset", F.col("image_id").alias("eval_id"), split.alias("split"), "source_ref").where("split in ('val', 'test')").groupBy("dataset", "eval_id").agg(F.max("split").alias("split"), F.max("source_ref").alias("source_ref"))
    per = pairs.groupBy("dataset", "eval_id").agg(F.count(F.lit(1)).alias("n"), F.count_if("exact").alias("e"))
    return per.join(source, ["dataset", "eval_id"]).groupBy("dataset", "split", "source_ref").agg(F.sum("n").alias("near_or_same_pairs"), F.sum("e").alias("same_pairs"), F.count(F.lit(1)).alias("eval_frames"))
