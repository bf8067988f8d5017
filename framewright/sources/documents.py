"""Readers of CVAT XML, detection JSON, archives, run folders and reports."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions.geometry import to_box, to_segment
from framewright.sources.labels import listing, stem

CVAT = "_id long, _name string, _width int, _height int, box array<struct<_label:string,_xtl:double,_ytl:double,_xbr:double,_ybr:double>>, polygon array<struct<_label:string,_points:string>>, polyline array<struct<_label:string,_points:string>>"
DETECTION = "detections array<struct<class_name:string,classId:int,x:double,y:double,width:double,height:double,score:double>>"


def read_cvat(spark: SparkSession, path: str) -> DataFrame:
    """One row per shape of CVAT 1.1 XML files: image name and size, label, normalised box or polygon; degenerate shapes are dropped."""
    x = spark.read.format("xml").option("rowTag", "image").schema(CVAT).load(path)
    size = [F.col("_name").alias("name"), F.col("_width").alias("width"), F.col("_height").alias("height")]
    b = x.select(*size, F.explode("box").alias("b")).select("name", "width", "height", F.col("b._label").alias("label"), F.lit("bbox").alias("kind"), to_box(F.col("b._xtl"), F.col("b._ytl"), F.col("b._xbr"), F.col("b._ybr"), F.col("width"), F.col("height")).alias("box"), F.lit(None).cast("array<struct<x:double,y:double>>").alias("points"))
    shapes = F.concat(F.coalesce("polygon", F.array().cast("array<struct<_label:string,_points:string>>")), F.coalesce("polyline", F.array().cast("array<struct<_label:string,_points:string>>")))
    p = x.select(*size, F.explode(shapes).alias("s")).withColumn("pts", points_of(F.col("s._points")))
    p = p.select("name", "width", "height", F.col("s._label").alias("label"), F.lit("segment").alias("kind"), F.lit(None).cast("struct<cx:double,cy:double,w:double,h:double>").alias("box"), to_segment(F.col("pts"), F.col("width"), F.col("height")).alias("points"))
    return b.unionByName(p).where("box is not null or points is not null")


def points_of(text):
    """`x,y;x,y` as an array of points; pieces that do not parse are left out."""
    pieces = F.transform(F.split(text, ";"), lambda t: F.struct(F.try_element_at(F.split(t, ","), F.lit(1)).try_cast("double").alias("x"), F.try_element_at(F.split(t, ","), F.lit(2)).try_cast("double").alias("y")))
    return F.filter(pieces, lambda t: t["x"].isNotNull() & t["y"].isNotNull())


def cvat_label_names(spark: SparkSession, path: str) -> DataFrame:
    return read_cvat(spark, path).select("label").where("label is not null").distinct()


def read_detections(spark: SparkSession, path: str) -> DataFrame:
    """One row per detection of JSON files beside images: stem, class, pixel corners, score."""
    d = spark.read.schema(DETECTION).option("multiLine", "true").option("pathGlobFilter", "*.json").option("recursiveFileLookup", "true").json(path)
    e = d.select(F.col("_metadata.file_path").alias("path"), F.posexplode("detections").alias("position", "d"))
    return e.select("path", stem(F.col("path")).alias("stem"), "position", F.col("d.class_name").alias("class_name"), F.col("d.classId").alias("cls_id"), F.col("d.x").alias("x1"), F.col("d.y").alias("y1"), (F.col("d.x") + F.col("d.width")).alias("x2"), (F.col("d.y") + F.col("d.height")).alias("y2"), F.col("d.score").alias("score"))


def archive_members(spark: SparkSession, path: str) -> DataFrame:
    """Members of zip and tar archives without extraction: archive, member, size; an archive that cannot be read gives one row without member. One archive is one task's work."""

    def members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                rows: list[tuple[str | None, int | None]] = []
                try:
                    if zipfile.is_zipfile(io.BytesIO(content)):
                        with zipfile.ZipFile(io.BytesIO(content)) as z:
                            rows = [(i.filename, i.file_size) for i in z.infolist() if not i.is_dir()]
                    else:
                        with tarfile.open(fileobj=io.BytesIO(content)) as t:
                            rows = [(i.name, i.size) for i in t.getmembers() if i.isfile()]
                except (tarfile.TarError, zipfile.BadZipFile, OSError, EOFError):
                    rows = [(None, None)]
                if rows:
                    yield pd.DataFrame({"archive": p, "member": [r[0] for r in rows], "size": pd.array([r[1] for r in rows], "Int64")})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(members, "archive string, member string, size long")


def run_folders(spark: SparkSession, root: str) -> DataFrame:
    """Folders that are runs: metadata, weights, metrics or a training curve below them; and which of these they hold."""
    f = listing(spark, root)
    p = F.col("path")
    run = F.regexp_replace(p, r"/(?:training_metadata\.json|models/.*|train/results\.csv|results\.csv|test_metrics\.csv)$", "")
    have = lambda x: F.bool_or(p.rlike(x))
    g = f.where(p.rlike(r"/(training_metadata\.json|models/[^/]+\.(pt|onnx|engine)|train/results\.csv|results\.csv|test_metrics\.csv)$")).groupBy(run.alias("run_dir"))
    return g.agg(have(r"training_metadata\.json$").alias("metadata"), have(r"\.(pt|onnx|engine)$").alias("weights"), have(r"test_metrics\.csv$").alias("metrics"), F.max_by("path", F.when(p.endswith("results.csv"), F.col("modified"))).alias("curve_path"))


def read_metrics_csv(spark: SparkSession, path: str) -> DataFrame:
    """path, class, metric, value of metric CSV files whose headers may differ: each file is read once and unpivoted on its own header."""

    def long(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import csv

        for b in batches:
            rows = []
            for p, text in zip(b["path"], b["value"], strict=True):
                table = [r for r in csv.reader(io.StringIO(text.lstrip("﻿")), skipinitialspace=True) if any(c.strip() for c in r)]
                if not table:
                    continue
                head = [c.strip() for c in table[0]]
                at = next((i for i, c in enumerate(head) if c.lower() == "class"), None)
                for n, r in enumerate(table[1:]):
                    for i, c in enumerate(head):
                        if i != at and i < len(r):
                            try:
                                rows.append((p, r[at].strip() if at is not None and at < len(r) else None, n, c, float(r[i])))
                            except ValueError:
                                pass
            yield pd.DataFrame(rows, columns=["path", "class", "row_no", "metric", "value"])

    t = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return t.mapInPandas(long, "path string, class string, row_no int, metric string, value double")


def metrics_row(metrics: DataFrame) -> DataFrame:
    """Per file and metric: the `all` row, else the mean over classes, else the first row."""
    v = F.col("value")
    per = metrics.groupBy("path", "metric").agg(F.max(F.when(F.lower("class") == "all", v)).alias("a"), F.avg(F.when(F.col("class").isNotNull(), v)).alias("m"), F.min_by("value", "row_no").alias("f"))
    return per.select("path", "metric", F.coalesce("a", "m", "f").alias("value"))


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Training metadata JSON flattened to sys_ and run columns."""
    schema = "training_info struct<model:string,dataset:string,epochs:int,batch:int,imgsz:int>, status struct<training_ok:boolean,testing_ok:boolean>, timestamps struct<start:string,end:string>, system struct<hostname:string,cpu:string,devices:array<struct<name:string,memory_gb:double>>>"
    m = spark.read.schema(schema).option("multiLine", "true").json(path).select("*", F.col("_metadata.file_path").alias("path"))
    one = F.try_element_at("system.devices", F.lit(1))
    return m.select("path", "training_info.*", "status.*", F.to_timestamp("timestamps.start").alias("started_at"), F.col("system.hostname").alias("sys_hostname"), F.col("system.cpu").alias("sys_cpu"), one["name"].alias("sys_device"), one["memory_gb"].alias("sys_memory_gb"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction JSON lines: image, position, class, confidence, corners."""
    schema = "image string, predictions array<struct<cls:int,conf:double,box:array<double>>>"
    p = spark.read.schema(schema).json(path).select("image", F.posexplode("predictions").alias("pred_idx", "p"))
    return p.select(F.col("image").alias("image_id"), "pred_idx", F.col("p.cls").alias("cls_id"), F.col("p.conf").alias("conf"), *[F.get("p.box", i).alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


def line_counts(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are not blank, per file."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), "value").where("trim(value) <> ''").groupBy("path").agg(F.count(F.lit(1)).alias("n_lines"))


def latest_file(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """The newest file of a kind."""
    return listing(spark, root, glob).agg(F.max_by("path", F.struct("modified", "path")).alias("path"), F.max("modified").alias("modified")).where("path is not null")


def preferred_split(listed: DataFrame, preference: tuple[str, ...] = ("test", "val", "train")) -> DataFrame:
    """Rows of the first split in the order of preference that has any."""
    rank = F.array_position(F.array(*[F.lit(p) for p in preference]), F.col("split"))
    best = listed.where(rank > 0).agg(F.min(rank).alias("_b"))
    return listed.join(F.broadcast(best), rank == F.col("_b")).drop("_b")  # one row
