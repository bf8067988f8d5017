"""Base views of the domain tables that the queries share, in Spark and (as CTEs) in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from framewright.functions.geometry import envelope
from framewright.functions.splits import canonical_split
from framewright.session import table

SPLIT_SQL = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end"


COLUMNS = ("dataset", "split", "kind", "cls_id", "cx", "cy", "w", "h", "points")


def annotations(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each label line once, as last loaded, with its canonical split. Lines are aggregated before the shuffle, not windowed.

    Name the columns a query needs: the optimizer cannot prune fields of the aggregated struct, so only these are read and moved.
    """
    a = table(spark, d, "annotations")
    rest = ["dataset", "split", *(c for c in columns if c not in ("dataset", "split"))] if columns else list(COLUMNS)
    return a.groupBy("image_id", "line_no").agg(F.max_by(F.struct(*rest), "loaded_at").alias("r")).select("image_id", "line_no", "r.*").withColumn("split", canonical_split(F.col("split")))


def geometries(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Label lines with the frame's size and their envelope x1 y1 x2 y2 bw bh (0 to 1) and w_px h_px.

    With columns named, only these of dataset, kind and cls_id are read and moved, and lines move once, by frame: a grouping or join by
    image_id after it moves nothing.
    """
    # The envelope is taken before lines are aggregated and joined: eight numbers move instead of the polygons.
    a = envelope(table(spark, d, "annotations").withColumn("width", F.lit(1.0)).withColumn("height", F.lit(1.0)))
    rest = ["dataset", "split", "kind", "cls_id", "x1", "y1", "x2", "y2", "bw", "bh"]
    if columns:
        rest = list(dict.fromkeys(["split", *columns, "x1", "y1", "x2", "y2"]))
        a = a.select("image_id", "line_no", "loaded_at", *rest).repartition("image_id")
    once = a.groupBy("image_id", "line_no").agg(F.max_by(F.struct(*rest), "loaded_at").alias("r")).select("image_id", "line_no", "r.*").withColumn("split", canonical_split(F.col("split")))
    if columns:
        once = once.withColumns({"bw": F.col("x2") - F.col("x1"), "bh": F.col("y2") - F.col("y1")})
    g = once.join(frames(spark, d, "width", "height").select("image_id", "width", "height"), "image_id")
    return g.withColumns({"w_px": F.col("bw") * F.col("width"), "h_px": F.col("bh") * F.col("height")})


def frames(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Each image once, as last scanned; name the columns a query needs."""
    i = table(spark, d, "images").withColumn("content_hash", F.lower("content_hash"))
    rest = list(dict.fromkeys(["dataset", "split", *(columns or ("stem", "width", "height", "n_bytes", "content_hash", "ahash", "source_ref"))]))
    return i.groupBy("image_id").agg(F.max_by(F.struct(*rest), "scanned_at").alias("r")).select("image_id", "r.*").withColumn("split", canonical_split(F.col("split")))


ANN = f"ann as (select image_id, line_no, dataset, {SPLIT_SQL} as split, kind, cls_id, cx, cy, w, h, points from annotations qualify row_number() over (partition by image_id, line_no order by loaded_at desc) = 1)"
IMG = f"img as (select image_id, dataset, {SPLIT_SQL} as split, stem, width, height, n_bytes, lower(content_hash) as content_hash, ahash, source_ref from images qualify row_number() over (partition by image_id order by scanned_at desc) = 1)"
GEO = """geo as (select a.image_id, a.line_no, a.dataset, a.split, a.kind, a.cls_id, i.width, i.height, x1, y1, x2, y2, x2 - x1 as bw, y2 - y1 as bh, (x2 - x1) * i.width as w_px, (y2 - y1) * i.height as h_px
  from (select *, case when kind = 'bbox' then cx - w / 2 else list_min([p.x for p in points]) end as x1, case when kind = 'bbox' then cy - h / 2 else list_min([p.y for p in points]) end as y1,
        case when kind = 'bbox' then cx + w / 2 else list_max([p.x for p in points]) end as x2, case when kind = 'bbox' then cy + h / 2 else list_max([p.y for p in points]) end as y2 from ann) a join img i using (image_id))"""


def row_uniform(*columns: str):
    """A uniform in [0, 1) from 15 hex digits of an md5 over the columns: the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in columns])), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def uniform_sql(*columns: str) -> str:
    return f"(('0x' || substr(md5(concat_ws(':', {', '.join(f'cast({c} as varchar)' for c in columns)})), 1, 8))::bigint / 4294967296.0)"


def predictions(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in detections: label lines of the val and test frames, moved and scored by md5 uniforms; image_id, pred_idx, cls_id, conf, box."""
    g = geometries(spark, d).where("split in ('val', 'test') and cls_id is not null and bw > 0 and bh > 0")
    a, b, c = (row_uniform("image_id", "line_no", "salt") for _ in range(3))
    g = g.withColumn("salt", F.lit("a")).withColumn("a", a).withColumn("salt", F.lit("b")).withColumn("b", b).withColumn("salt", F.lit("c")).withColumn("c", c)
    dx, dy = (F.col("a") - 0.5) * 0.6 * F.col("bw"), (F.col("b") - 0.5) * 0.6 * F.col("bh")
    box = [((F.col(n) + s) * F.col(k)).alias(n) for n, s, k in (("x1", dx, "width"), ("y1", dy, "height"), ("x2", dx, "width"), ("y2", dy, "height"))]
    return g.where("c < 0.85").select("dataset", "image_id", F.col("line_no").alias("pred_idx"), "cls_id", F.round("c", 6).alias("conf"), *box)


def ground_truth(spark: SparkSession, d: str) -> DataFrame:
    g = geometries(spark, d).where("split in ('val', 'test') and cls_id is not null and bw > 0 and bh > 0")
    return g.select("dataset", "image_id", F.col("line_no").alias("gt_idx"), "cls_id", *[(F.col(n) * F.col(k)).alias(n) for n, k in (("x1", "width"), ("y1", "height"), ("x2", "width"), ("y2", "height"))])


EVAL = f"""ev as (select * from geo where split in ('val', 'test') and cls_id is not null and bw > 0 and bh > 0),
gt as (select dataset, image_id, line_no as gt_idx, cls_id, x1 * width as x1, y1 * height as y1, x2 * width as x2, y2 * height as y2 from ev),
pred as (select dataset, image_id, line_no as pred_idx, cls_id, round(c, 6) as conf, (x1 + (a - 0.5) * 0.6 * bw) * width as x1, (y1 + (b - 0.5) * 0.6 * bh) * height as y1, (x2 + (a - 0.5) * 0.6 * bw) * width as x2, (y2 + (b - 0.5) * 0.6 * bh) * height as y2
  from (select *, {uniform_sql('image_id', 'line_no', "'a'")} as a, {uniform_sql('image_id', 'line_no', "'b'")} as b, {uniform_sql('image_id', 'line_no', "'c'")} as c from ev) where c < 0.85)"""


def with_(*ctes: str) -> str:
    return "with " + ",\n".join(ctes) + "\n"


def first_by(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in an order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
