"""Readers of label and image trees. Listings come from the file source's metadata; contents are read as text, never on the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.scalars import split_from_path

# Image endings in order of preference.
IMAGE_ENDINGS = ("jpg", "jpeg", "png", "bmp", "webp", "tif", "tiff")
# Layouts in order of priority.
LAYOUTS = ("darknet", "cvsdcldet", "split", "nested_split", "flat", "subset_flat", "cvat11")


def listing(spark: SparkSession, root: str, glob: str | None = None) -> DataFrame:
    """path, length, modified of every file below root (contents are not read)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(root).select("path", "length", F.col("modificationTime").alias("modified"))


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def ending(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def read_labels(spark: SparkSession, root: str) -> DataFrame:
    """One row per label line below root: path, split, raw, and the parsed label; valid is false for lines that do not parse.

    A line is a box (5 tokens) or polygon (odd count from 7 on); blank lines and comments are skipped.
    """
    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(root).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace("value", r"^\s+|\s+$", "").alias("raw"))
    t = t.where("raw <> '' and not startswith(raw, '#')")
    tokens = F.split(F.regexp_replace("raw", r"\s+", " "), " ")
    # Decimals only: a cast alone would also take Java's own spellings (1d, 0.5f, NaN).
    nums = F.expr(r"transform(slice(tokens, 2, size(tokens)), x -> if(x rlike r'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$', try_cast(x as double), null))")
    n = F.size("tokens")
    t = t.withColumn("tokens", tokens).withColumn("nums", nums).withColumn("cls_id", F.expr("try_cast(tokens[0] as int)"))
    ok = F.col("cls_id").isNotNull() & ((n == 5) | ((n >= 7) & (n % 2 == 1))) & ~F.exists("nums", lambda x: x.isNull())
    box = n == 5
    return t.select(
        "path", split_from_path(F.col("path")).alias("split"), "raw", F.coalesce(ok, F.lit(False)).alias("valid"), "cls_id", F.when(ok, F.when(box, "bbox").otherwise("segment")).alias("kind"),
        *[F.when(ok & box, F.get("nums", i)).alias(c) for i, c in enumerate(("cx", "cy", "w", "h"))],
        F.when(ok & ~box, F.expr("transform(sequence(0, size(nums) div 2 - 1), i -> named_struct('x', nums[2 * i], 'y', nums[2 * i + 1]))")).alias("points"),
    )


def label_profile(labels: DataFrame) -> DataFrame:
    """Per file: valid and broken lines, boxes, polygons."""
    return labels.groupBy("path").agg(F.count_if("valid").alias("n_valid"), F.count_if(~F.col("valid")).alias("n_broken"), F.count_if(F.col("kind") == "bbox").alias("n_boxes"), F.count_if(F.col("kind") == "segment").alias("n_polygons"))


def pairs(images: DataFrame, labels: DataFrame, image_root: str, label_root: str) -> DataFrame:
    """Full pairing of image and label files on the path below their roots without ending; the preferred image ending wins."""
    key = lambda c, r: F.regexp_replace(F.regexp_extract(c, rf"{r}/(.*)$", 1), r"\.[^./]*$", "")
    rank = F.coalesce(F.array_position(F.array(*[F.lit(e) for e in IMAGE_ENDINGS]), ending(F.col("path"))), F.lit(0))
    i = images.where(ending(F.col("path")).isin(*IMAGE_ENDINGS)).groupBy(key(F.col("path"), image_root).alias("rel")).agg(F.min_by("path", F.struct(rank, "path")).alias("image_path"))
    lab = labels.where(F.lower("path").endswith(".txt")).groupBy(key(F.col("path"), label_root).alias("rel")).agg(F.min("path").alias("label_path"))
    status = F.when(F.col("image_path").isNull(), "orphan_label").when(F.col("label_path").isNull(), "orphan_image").otherwise("pair")
    return i.join(lab, "rel", "full_outer").withColumn("status", status)


def detect_layout(files: DataFrame, root: str) -> DataFrame:
    """One row: all layouts that a file listing matches, in order of priority, and the first (or unknown)."""
    rel = F.regexp_extract("path", rf"{root.rstrip('/')}/(.*)$", 1)
    f = files.select(rel.alias("r"))
    any_ = lambda p: F.coalesce(F.bool_or(F.col("r").rlike(p)), F.lit(False))
    split = r"(train|val|valid|validation|test)"
    has = f.agg(
        any_(r"(?i)(^|/)obj\.(names|data)$").alias("darknet"), any_(r"(?i)^[^/]+\.json$").alias("json"), any_(r"(?i)^[^/]+\.(jpg|jpeg|png)$").alias("img"), any_(rf"(?i)^{split}/(images|labels)/").alias("split"), any_(rf"(?i)^(images|labels)/{split}/").alias("nested_split"),
        any_(r"(?i)^images/[^/]+$").alias("fi"), any_(r"(?i)^labels/[^/]+$").alias("fl"), any_(r"(?i)^images/[^/]+/[^/]+$").alias("si"), any_(r"(?i)^labels/[^/]+/[^/]+$").alias("sl"), any_(r"(?i)^annotations\.xml$").alias("cvat11"),
    )
    tests = {"darknet": F.col("darknet"), "cvsdcldet": F.col("json") & F.col("img"), "split": F.col("split"), "nested_split": F.col("nested_split"), "flat": F.col("fi") & F.col("fl"), "subset_flat": F.col("si") & F.col("sl") & ~F.col("nested_split"), "cvat11": F.col("cvat11")}
    found = F.array_compact(F.array(*[F.when(tests[name], name) for name in LAYOUTS]))
    return has.select(found.alias("layouts")).withColumn("layout", F.coalesce(F.get("layouts", 0), F.lit("unknown")))


def buckets(layout: str, root: str) -> list[tuple[str, str]]:
    """(images, labels) globs of a layout."""
    s = "{train,val,valid,validation,test}"
    return {"split": [(f"{root}/{s}/images", f"{root}/{s}/labels")], "nested_split": [(f"{root}/images/{s}", f"{root}/labels/{s}")], "flat": [(f"{root}/images", f"{root}/labels")], "subset_flat": [(f"{root}/images/*", f"{root}/labels/*")], "darknet": [(f"{root}/obj_*_data", f"{root}/obj_*_data")], "cvsdcldet": [(root, root)], "cvat11": [(f"{root}/images", root)]}.get(layout, [])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """Lines of a list file (data set names, image paths, class names), without blanks and comments, each once."""
    return spark.read.text(path).select(F.trim("value").alias("value")).where("value <> '' and not startswith(value, '#')").distinct()


def read_names(spark: SparkSession, path: str) -> DataFrame:
    """cls_id, name of an obj.names file, in order of its lines."""
    text = spark.read.text(path, wholetext=True)
    lines = F.filter(F.transform(F.split("value", "\n"), lambda x: F.trim(x)), lambda x: x != "")
    return text.select(F.posexplode(lines).alias("cls_id", "name"))


def read_data_yaml(spark: SparkSession, path: str) -> DataFrame:
    """cls_id, name of data.yaml files (names as a list, inline list or id: name pairs), parsed in SQL from the whole text."""
    text = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_extract("value", r"(?s)(?:^|\n)names:[ \t]*(.*?)(?:\n(?=[A-Za-z_]+:)|\z)", 1).alias("body"))
    bare = lambda c: F.regexp_replace(F.trim(c), r"""^['"]|['"]$""", "")
    inline = F.col("body").rlike(r"^\s*\[")
    listed = F.when(inline, F.split(F.regexp_replace("body", r"[\[\]\n]", ""), ",")).otherwise(F.expr(r"regexp_extract_all(body, '(?m)^[ \\t]*-[ \\t]*(.+)$', 1)"))
    as_list = text.where(F.size(F.filter(listed, lambda x: F.trim(x) != "")) > 0).select("path", F.posexplode(listed).alias("cls_id", "name"))
    pairs_ = F.expr(r"regexp_extract_all(body, '(?m)^[ \\t]*(\\d+[ \\t]*:[ \\t]*.+)$', 1)")
    as_map = text.where(~inline).select("path", F.explode(pairs_).alias("p")).select("path", F.substring_index("p", ":", 1).cast("int").alias("cls_id"), F.regexp_extract("p", r":\s*(.*)$", 1).alias("name"))
    return as_list.unionByName(as_map).select("path", "cls_id", bare(F.col("name")).alias("name"))
