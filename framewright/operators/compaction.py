"""Far too many small files: which deliveries count, and how to consolidate them into few well-sized files.

Planning is SQL only: deliveries of one label file are recognised by a normalised key, the kept manifest is frozen (no content in
it), ordered, and its bytes are summed without a window over a whole data set; target-sized intervals of that sum become the new files.
The rewrite brings each content to its part in one shuffle, and each part is bounded by the target size plus one file. Every
part lists the file_ids it holds, so that the reconciliation needs to guess nothing from the text.

Defined results: repeated rows count once (of rows of one file_id with different texts the latest complete one); rows without file_id are no deliveries; a null content never counts as complete; rows without data set, split or path form
deliveries of their own null key; of deliveries at the same time the higher file_id counts; an empty label file is kept with
no records; lines of a label file that begin with # are its own comments; empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from framewright.functions.splits import canonical_split
from framewright.operators.ordered import numbered
from framewright.operators.skew import lookup_join

TARGET_BYTES = 8 * 1024 * 1024
# Fixed value: the markers that copies of a file bear at the end of their stem.
COPY_MARKER = r"(?i)(\s*\(\d+\)|[\s._-]*\bcopy\b(\s*\(?\d+\)?)?|[-_ ]+copy\d*)+$"


def clean_path(path: Column) -> Column:
    """Forward slashes, percent signs decoded, no scheme, no empty or dot parts."""
    p = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    p = F.replace(F.coalesce(p, path), F.lit("\\"), F.lit("/"))
    p = F.regexp_replace(p, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    return F.regexp_replace(F.regexp_replace(p, r"(^|/)(\./)+", "$1"), r"/{2,}", "/")


def delivery_key(files: DataFrame) -> DataFrame:
    """Add camera, stem and delivery_split, which with the data set name one label file."""
    p = clean_path(F.col("label_path"))
    name = F.trim(F.regexp_extract(p, r"([^/]*)$", 1))
    stem = F.regexp_replace(F.regexp_replace(name, COPY_MARKER, ""), r"(?i)\.txt\s*$", "")
    stem = F.lower(F.trim(F.regexp_replace(stem, COPY_MARKER, "")))
    split = F.coalesce(canonical_split(F.col("split")), F.col("split"))
    return files.withColumns({"camera": F.lower(F.regexp_extract(p, r"(?i)(?:^|/)(cam\d+)/", 1)), "stem": stem, "delivery_split": split})


KEY = ["dataset", "delivery_split", "camera", "stem"]


def complete() -> Column:
    return F.coalesce(F.octet_length("content") == F.col("n_bytes"), F.lit(False))


def kept_files(files: DataFrame) -> DataFrame:
    """The manifest: file_id, export_id, key, n_bytes and digest of the latest complete delivery of each label file, one row per label file.

    Pre-aggregated, so neither a hot key nor an often repeated row is a burden, and no content is moved.
    """
    sent = F.struct("delivered_at", "file_id", F.xxhash64("content").alias("digest"), "export_id", F.octet_length("content").cast("long").alias("n_bytes"))
    latest = delivery_key(files).where(complete() & F.col("file_id").isNotNull()).groupBy(*KEY).agg(F.max(sent).alias("r"))
    return latest.select("r.file_id", "r.export_id", *KEY, "r.n_bytes", "r.digest")


def superseded_files(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """file_id of every row whose records are not in the new files: all but the kept delivery of each label file."""
    held = consolidated(files, target_bytes).select(F.explode("file_ids").alias("file_id"))
    return files.where("file_id is not null").select("file_id").distinct().join(held, "file_id", "left_anti")


def plan(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The frozen manifest of kept files with the new part of each: a part holds files whose byte intervals start in it."""
    manifest = kept_files(files).withColumn("_size", F.col("n_bytes") + 1)
    placed = numbered(manifest, ["dataset", "delivery_split"], ["camera", "stem", "file_id"], "_size")
    return placed.withColumn("part_no", F.floor(F.col("cum") / target_bytes)).drop("_size", "cum")


def consolidated(files: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """One row per new file: data set, split, part_no, n_files, n_records, file_ids (in order), content and n_bytes.

    Content holds the kept label files in manifest order; each starts with a line `#` camera/stem so that none is lost in it.
    Repeated rows of a file collapse in the partial sets before the shuffle.
    """
    placed = plan(files, target_bytes).select("file_id", "digest", "dataset", "delivery_split", "part_no", "pos", "camera", "stem")
    texts = files.where(complete()).select("file_id", F.xxhash64("content").alias("digest"), "content")
    with_text = lookup_join(texts, placed, ["file_id", "digest"], ["digest"], "inner")
    head = F.concat(F.lit("# "), F.col("camera"), F.lit("/"), F.col("stem"), F.lit("\n"))
    head = F.coalesce(head, F.lit("# /\n"))
    body = F.when(F.col("content") == "", "").when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n")))
    piece = F.struct("pos", "file_id", record_count().alias("n"), F.concat(head, body).alias("text"))
    parts = with_text.groupBy("dataset", "delivery_split", "part_no").agg(F.array_sort(F.collect_set(piece)).alias("t"))
    return parts.select(
        "dataset", F.col("delivery_split").alias("split"), "part_no", F.size("t").cast("long").alias("n_files"), F.expr("aggregate(t, 0L, (s, x) -> s + x.n)").alias("n_records"),
        F.expr("transform(t, x -> x.file_id)").alias("file_ids"), F.expr("array_join(transform(t, x -> x.text), '')").alias("content"),
    ).withColumn("n_bytes", F.octet_length("content"))


def record_count() -> Column:
    """Label lines in content: lines that are neither blank nor a comment."""
    return F.expr(r"size(filter(split(content, '\\r\\n|\\n|\\r'), x -> trim(x) <> '' and not startswith(ltrim(x), '#')))")


def write_consolidated(files: DataFrame, path: str, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Write the new files under path, one parquet file per part, and return the reconciliation per data set and split."""
    parts = consolidated(files, target_bytes).repartitionByRange("dataset", "split", "part_no")
    parts.write.mode("overwrite").option("maxRecordsPerFile", 1).parquet(path)
    return reconcile(files, files.sparkSession.read.parquet(path))


def reconcile(files: DataFrame, written: DataFrame) -> DataFrame:
    """Files and records wanted (from the kept deliveries) against written (from the parts' lists and texts), per data set and split.

    Both sides are added up file by file and then by group, so null data sets and splits meet, and no join is needed.
    """
    where = ["dataset", F.col("delivery_split").alias("split")]
    keys = kept_files(files).select("file_id", "digest", *where)
    n = files.where(complete()).groupBy("file_id", F.xxhash64("content").alias("digest")).agg(F.max(record_count()).alias("records"))
    want = keys.join(n, ["file_id", "digest"]).select("dataset", "split", "file_id", F.lit(1).alias("want"), F.lit(0).alias("got"), F.col("records").cast("long").alias("records"))
    got = written.select("dataset", "split", F.explode("file_ids").alias("file_id"), F.lit(0).alias("want"), F.lit(1).alias("got"), F.lit(0).cast("long").alias("records"))
    per = want.unionByName(got).groupBy("dataset", "split", "file_id").agg(F.sum("want").alias("want"), F.sum("got").alias("got"), F.sum("records").alias("records"))
    zero = F.lit(0).cast("long")
    f = per.groupBy("dataset", "split").agg(F.sum("want").alias("files_wanted"), F.sum("got").alias("files_written"), F.count_if(F.col("want") > F.col("got")).alias("files_lost"), F.count_if(F.col("got") > F.col("want")).alias("files_repeated"), F.sum("records").alias("records_wanted"))
    w = written.groupBy("dataset", "split").agg(F.sum(record_count()).cast("long").alias("records_written"), F.count(F.lit(1)).alias("parts_count"))
    both = f.withColumns({"records_written": zero, "parts_count": zero}).unionByName(w.withColumns(dict.fromkeys(["files_wanted", "files_written", "files_lost", "files_repeated", "records_wanted"], zero)))
    out = both.groupBy("dataset", "split").agg(*[F.sum(c).alias(c) for c in both.columns[2:]])
    return out.withColumn("whole", (F.col("files_lost") == 0) & (F.col("files_repeated") == 0) & (F.col("records_wanted") == F.col("records_written")))


def export_parts(files: DataFrame, exports: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """Per export: parts_count as stated, what it should have been by export_files_per_dir, and the new parts_count."""
    placed = plan(files, target_bytes)
    per = placed.groupBy("export_id").agg(F.count(F.lit(1)).alias("kept_files"), F.count_distinct("dataset", "delivery_split", "part_no").alias("new_parts_count"))
    return exports.join(per, "export_id", "left").select("export_id", "dataset", F.col("parts_count").alias("stated_parts_count"), F.when(F.col("export_files_per_dir") > 0, F.ceil(F.col("images_exported") / F.col("export_files_per_dir"))).alias("expected_parts_count"), F.coalesce("kept_files", F.lit(0)).alias("kept_files"), F.coalesce("new_parts_count", F.lit(0)).alias("new_parts_count"))
