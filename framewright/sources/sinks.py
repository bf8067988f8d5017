"""Writers of label files, CVAT XML, manifests and tables. Rows are grouped per output file and written by the executors."""

from __future__ import annotations

import json
import os
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def label_line():
    """A label as a text line: boxes with 8 decimals, polygons with 6."""
    box = F.format_string("%d %.8f %.8f %.8f %.8f", "cls_id", "cx", "cy", "w", "h")
    points = F.array_join(F.transform("points", lambda p: F.format_string("%.6f %.6f", p["x"], p["y"])), " ")
    return F.when(F.col("kind") == "bbox", box).otherwise(F.concat_ws(" ", F.col("cls_id").cast("string"), points))


def label_texts(labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, content: the sorted label lines of each frame (a frame's labels are few)."""
    lines = labels.where("cls_id is not null").select(*keys, "cls_id", label_line().alias("line"))
    return lines.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("cls_id", "line"))).alias("l")).select(*keys, F.concat(F.array_join(F.transform("l", lambda x: x["line"]), "\n"), F.lit("\n")).alias("content"))


def write_texts(texts: DataFrame, root: str, path: str = "rel_path", content: str = "content") -> DataFrame:
    """Write one file per row below a shared root, each through a temporary name; returns the written paths and sizes.

    A task that runs twice writes the same bytes to the same name, so lost executors do no harm.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            sizes = []
            for p, c in zip(b[path], b[content], strict=True):
                target = os.path.join(root, p)
                os.makedirs(os.path.dirname(target), exist_ok=True)
                data = c.encode()
                partial = f"{target}.{os.getpid()}.part"
                with open(partial, "wb") as f:
                    f.write(data)
                os.replace(partial, target)
                sizes.append(len(data))
            yield pd.DataFrame({"rel_path": b[path], "n_bytes": sizes})

    from framewright.session import cut_lineage

    return cut_lineage(texts.select(path, content).mapInPandas(write, "rel_path string, n_bytes long"))


def write_cvat(labels: DataFrame, names: DataFrame, path: str, task: str) -> None:
    """CVAT 1.1 XML: one `image` element per frame with its boxes and polygons in pixels (Spark's XML writer)."""
    x = labels.join(names.select("cls_id", F.col("name").alias("label")), "cls_id", "left").withColumn("label", F.coalesce("label", F.concat(F.lit("id_"), F.col("cls_id"))))
    w, h = F.col("width"), F.col("height")
    px = lambda c, s: F.round(c * s, 2)
    box = F.when(F.col("kind") == "bbox", F.struct(F.col("label").alias("_label"), px(F.col("cx") - F.col("w") / 2, w).alias("_xtl"), px(F.col("cy") - F.col("h") / 2, h).alias("_ytl"), px(F.col("cx") + F.col("w") / 2, w).alias("_xbr"), px(F.col("cy") + F.col("h") / 2, h).alias("_ybr")))
    pts = F.array_join(F.transform("points", lambda p: F.format_string("%.2f,%.2f", p["x"] * w, p["y"] * h)), ";")
    poly = F.when(F.col("kind") == "segment", F.struct(F.col("label").alias("_label"), pts.alias("_points")))
    rows = x.select(F.col("image_id").alias("_name"), w.alias("_width"), h.alias("_height"), box.alias("box"), poly.alias("polygon"))
    images = rows.groupBy("_name", "_width", "_height").agg(F.collect_list("box").alias("box"), F.collect_list("polygon").alias("polygon"))
    images.write.mode("overwrite").format("xml").option("rowTag", "image").option("rootTag", f"annotations task='{task}'").save(path)


def data_yaml(names: list[str], train: str = "train/images", val: str = "val/images", test: str = "test/images") -> str:
    """The text of a data.yaml file."""
    quoted = "\n".join(f"  {i}: {json.dumps(n, ensure_ascii=False)}" for i, n in enumerate(names))
    return f"train: {train}\nval: {val}\ntest: {test}\nnc: {len(names)}\nnames:\n{quoted}\n"


def write_json_atomic(path: str, payload: object) -> None:
    """Replace a small JSON file in one step."""
    partial = f"{path}.part"
    with open(partial, "w", encoding="utf-8") as f:
        json.dump(payload, f, ensure_ascii=False, sort_keys=True, indent=1)
    os.replace(partial, path)


def zip_folder(folder: str, target: str) -> None:
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in sorted(os.walk(folder)):
            for name in sorted(files):
                z.write(os.path.join(root, name), os.path.relpath(os.path.join(root, name), folder))


def report_csv(rows: DataFrame, path: str) -> None:
    """A report's few rows as one CSV file with header."""
    rows.coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def confidence_tables(recommendations: DataFrame, path: str) -> None:
    recommendations.write.mode("overwrite").partitionBy("objective").parquet(path)


def snapshot(payload: DataFrame, path: str) -> DataFrame:
    """Write a table with a sha256 per row, and return the manifest: rows and one digest that no order changes."""
    hashed = payload.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(payload.columns)), {"ignoreNullFields": "false"}), 256))
    hashed.write.mode("overwrite").parquet(path)
    part = F.conv(F.substring("row_sha256", 1, 10), 16, 10).cast("decimal(38,0)")
    return payload.sparkSession.read.parquet(path).agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(F.coalesce(F.sum(part).cast("string"), F.lit("")), 256).alias("sha256"))


def dual_write(rows: DataFrame, legacy: str, unified: str) -> DataFrame:
    """The same rows as JSON lines (legacy) and parquet (unified), with a report that both hold them all."""
    rows.write.mode("overwrite").json(legacy)
    rows.write.mode("overwrite").parquet(unified)
    s = rows.sparkSession
    a = s.read.text(legacy).agg(F.count(F.lit(1)).alias("legacy_rows"))
    return a.crossJoin(s.read.parquet(unified).agg(F.count(F.lit(1)).alias("unified_rows"))).withColumn("equal", F.col("legacy_rows") == F.col("unified_rows"))  # one row each


def envelope_v2(report: DataFrame, schema_version: str = "2.0.0") -> DataFrame:
    """A report's rows under the versioned envelope."""
    return report.select(F.lit(schema_version).alias("schema_version"), F.struct(*report.columns).alias("payload"))
