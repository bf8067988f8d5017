"""Rows that fail to parse: valid label lines as boxes and polygons, broken ones with their reason.

Each line is parsed where it is read (no shuffle): its record is assembled quote-aware (a quoted cell may hold line breaks), read by
the strict csv reader, and structural faults are caught before any value is built. The only join is
to the known class ids. Blank lines and comments are neither valid nor broken. Defined results: a null line counts as blank,
a line of another format than yolo or csv is read as yolo, a null data set has no classes (class_id), repeated rows of a line_id
with one text give one row, empty input gives empty output, extra columns are ignored.
"""

from __future__ import annotations

import csv
import math
import re
import sys
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.skew import lookup_join

CSV_CELLS = 7
INTEGER = re.compile(r"[+-]?[0-9]+")
DECIMAL = re.compile(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?")
QUOTED = re.compile(r'(^|,)"(?:[^"]|"")*"(?=,|$)')
SCHEMA = "line_id long, dataset string, split string, rel_label string, line_no int, fmt string, kind string, cls_id long, coords array<double>, stem string, note string, reason string"


BREAK = re.compile(r"\r\n|\n|\r")


class Broken(ValueError):
    pass


def assemble(lines: Iterable[str]) -> Iterator[str]:
    """Join physical lines into records: a line that leaves a quote open goes on in the next one."""
    held = ""
    for line in lines:
        held = f"{held}\n{line}" if held else line
        if QUOTED.sub(r"\1", held).count('"') % 2 == 0:
            yield held
            held = ""
    if held:
        yield held


def cells(line: str) -> list[str]:
    """The cells of one csv record by the strict reader; quotes inside an unquoted cell are refused as well."""
    csv.field_size_limit(sys.maxsize)
    physical = BREAK.split(line)
    if len(physical) > 1 and len(list(assemble(physical))) > 1:
        raise Broken("column_count")  # several records in one
    try:
        rows = list(csv.reader([f"{x}\n" for x in physical], strict=True))
    except csv.Error as e:
        raise Broken("quoting") from e
    if '"' in QUOTED.sub(r"\1", line):
        raise Broken("quoting")
    return rows[0] if rows else []


def number(text: str) -> float:
    if not DECIMAL.fullmatch(text) or not math.isfinite(x := float(text)):
        raise Broken("number")
    return x


def parse_line(raw: str, fmt: str) -> tuple[str, int, list[float], str | None, str | None]:
    """(kind, class, coordinates, stem, note); raises Broken with the first reason that applies."""
    line = raw.strip()
    stem = note = None
    if fmt == "csv":
        got = cells(line)
        if len(got) != CSV_CELLS:
            raise Broken("column_count")
        stem, note, got = got[0], got[6], [c.strip() for c in got[1:6]]
    else:
        got = line.split()
        if len(got) != 5 and (len(got) < 7 or len(got) % 2 == 0):
            raise Broken("column_count")
    if not INTEGER.fullmatch(got[0]):
        raise Broken("number")
    coords = [number(c) for c in got[1:]]
    box = len(coords) == 4
    if any(not 0 <= c <= 1 for c in coords) or box and min(coords[2:]) <= 0:
        raise Broken("range")
    cls = int(got[0])
    return "bbox" if box else "segment", cls if abs(cls) < 2**31 else -(2**31), coords, stem, note


def file_records(files: DataFrame, key: str, content: str) -> DataFrame:
    """key, record_no, raw of the records of whole csv label files: lines that leave a quote open go on in the next one; blank records are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(k, i, r) for k, t in zip(b["k"], b["t"], strict=True) for i, r in enumerate(x for x in assemble(BREAK.split(t)) if x.strip())]
            yield pd.DataFrame(rows, columns=["key", "record_no", "raw"])

    return files.select(F.col(key).cast("string").alias("k"), F.col(content).alias("t")).where("k is not null and t is not null").mapInPandas(run, "key string, record_no int, raw string")


def parsed_lines(lines: DataFrame) -> DataFrame:
    """One row per label line that is not blank or a comment; reason is null unless the text itself is broken."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["kind", "cls_id", "coords", "stem", "note", "reason"]
        for b in batches:
            rows, keep = [], []
            for raw, fmt in zip(b["raw"], b["fmt"], strict=True):
                text = raw.strip() if isinstance(raw, str) else ""
                keep.append(bool(text) and text[0] != "#")
                if keep[-1]:
                    try:
                        rows.append((*parse_line(text, fmt), None))
                    except Broken as e:
                        rows.append((None, None, None, None, None, str(e)))
            b = b.drop(columns="raw")[keep].reset_index(drop=True)
            parsed = pd.DataFrame(rows, columns=columns)
            parsed["cls_id"] = parsed["cls_id"].astype("Int64")
            yield pd.concat([b, parsed], axis=1)

    return lines.select("line_id", "dataset", "split", "rel_label", "line_no", "fmt", "raw").mapInPandas(parse, SCHEMA)


def checked_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """parsed_lines with class_id as the reason of lines whose class the data set does not have."""
    known = classes.where("dataset is not null and cls_id is not null").select("dataset", F.col("cls_id").cast("long").alias("cls_id")).distinct().withColumn("_known", F.lit(True))
    joined = lookup_join(parsed_lines(lines), known, ["dataset", "cls_id"], ["line_id"])
    return joined.withColumn("reason", F.when(F.col("reason").isNull() & F.col("_known").isNull(), "class_id").otherwise(F.col("reason"))).drop("_known")


def valid_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Boxes (cx, cy, w, h) and polygons (points) of the valid lines; a line_id gives one row (the greatest of rows that differ)."""
    c = F.col("coords")
    rest = ["dataset", "split", "rel_label", "line_no", "kind", "cls_id", "coords", "stem", "note"]
    ok = checked_lines(lines, classes).where("reason is null").groupBy("line_id").agg(F.max(F.struct(*rest)).alias("r")).select("line_id", "r.*")
    box = F.col("kind") == "bbox"
    return ok.select("line_id", "dataset", "split", "rel_label", "line_no", "kind", F.col("cls_id").cast("int").alias("cls_id"), *[F.when(box, F.get(c, i)).alias(n) for i, n in enumerate(("cx", "cy", "w", "h"))], F.when(~box, F.expr("transform(sequence(0, size(coords) div 2 - 1), i -> named_struct('x', coords[2 * i], 'y', coords[2 * i + 1]))")).alias("points"), "stem", "note")


def broken_lines(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """line_id and the first reason: quoting, column_count, number, range, class_id."""
    return checked_lines(lines, classes).where("reason is not null").select("line_id", "reason").distinct()


def line_report(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """Per data set and split: valid lines, broken_label_lines (all but class_id) and unknown_class_ids."""
    once = checked_lines(lines, classes).groupBy("line_id").agg(F.max(F.struct("dataset", "split", F.coalesce("reason", F.lit("")).alias("reason"))).alias("r")).select("r.*")
    bad = F.col("reason")
    return once.groupBy("dataset", "split").agg(F.count_if(bad == "").alias("valid_lines"), F.count_if((bad != "") & (bad != "class_id")).alias("broken_label_lines"), F.count_if(bad == "class_id").alias("unknown_class_ids"))
