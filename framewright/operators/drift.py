"""Schemas that drift between files: one consistent table of all files, and every change with its file.

Files of a series follow one another in time. Each file is parsed once; the files are numbered per series without a window
over the whole series (framewright.operators.ordered), cut into blocks of BLOCK files, and each block is walked on its own with the
file before it as context. What a block cannot know (the type a field had before the block) is settled from one summary row
per field and block, and summaries of BLOCK blocks are themselves walked into one, level by level. A hot series therefore spreads over
many tasks at every step. Which fields of neighbouring files correspond is decided by similarity flooding
(framewright.operators.schema_match); how many fields of one file share a word is counted over all files.

Defined results: rows with a null path, series key, time or body, and files that do not parse, are left out of the changes
and reported by unreadable_files; repeated rows of a path count once (the latest ingested); a field name given twice
in one file counts once with its last value; empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

import csv
import io
import json
import re
import sys
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from framewright.operators.dedup import leaders
from framewright.operators.ordered import numbered
from framewright.operators.schema_match import Field, match_fields, skeleton, spelled, words_of
from framewright.operators.skew import lookup_join, stated_tasks
from framewright.session import cut_lineage

BLOCK = 2000
SERIES = ["producer", "namespace"]
FIELD = "array<struct<name:string,type:string,value:string,shape:string,spelled:string>>"
SHARED = "array<struct<word:string,n:long>>"
NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?")


def clean(name: str) -> str:
    return name.replace("﻿", "").strip()


def json_type(v: object) -> str | None:
    if v is None or v == "":
        return None
    return {bool: "boolean", int: "number", float: "number", str: "text", dict: "object", list: "list"}[type(v)]


def shape_of(v: object) -> str | None:
    return json.dumps(skeleton(v), sort_keys=True) if isinstance(v, dict | list) else None


def parse_file(path: str, body: str) -> list[tuple[str, str | None, str | None, str | None]] | None:
    """(name, type, value, shape) of the top-level fields; None if the file cannot be read."""
    body = body.lstrip("\ufeff")
    try:
        if path.lower().rstrip().endswith(".json"):
            data = json.loads(body)
            if not isinstance(data, dict):
                return None
            found = {clean(k): (json_type(v), None if v is None else v if isinstance(v, str) else json.dumps(v), shape_of(v)) for k, v in data.items()}
        else:
            csv.field_size_limit(sys.maxsize)
            rows = [r for r in csv.reader(io.StringIO(body, newline=""), skipinitialspace=True) if any(c.strip() for c in r)]
            if not rows:
                return None
            found = {}
            for i, raw in enumerate(rows[0]):
                values = [v for r in rows[1:] if i < len(r) and (v := r[i].strip())]
                kind = None if not values else "number" if all(NUMBER.fullmatch(v) for v in values) else "text"
                found[clean(raw)] = (kind, values[-1] if values else None, None)
        return [(n, *rest) for n, rest in found.items() if n]
    except (ValueError, csv.Error, RecursionError):
        return None


def shared_words(names: Iterable[str]) -> list[dict]:
    """Words that several of the names bear, with the number of names."""
    n = Counter(w for name in names for w in words_of(name))
    return [{"word": w, "n": k} for w, k in n.items() if k > 1]


def parsed_files(files: DataFrame) -> DataFrame:
    """raw_path, producer, namespace, written_at, fields (null where the file cannot be read), shared words; one row per path."""
    once = files.where("raw_path is not null and body is not null and producer is not null and namespace is not null and written_at is not null")
    once = once.groupBy("raw_path").agg(F.max(F.struct("ingested_at", "written_at", *SERIES, "body")).alias("r")).select("raw_path", "r.producer", "r.namespace", "r.written_at", "r.body")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            found = [parse_file(p, x) for p, x in zip(b["raw_path"], b["body"], strict=True)]
            b = b.drop(columns="body")
            b["fields"] = [None if f is None else [{"name": n, "type": t, "value": v, "shape": x, "spelled": spelled(n)} for n, t, v, x in f] for f in found]
            b["shared"] = [[] if f is None else shared_words(x[0] for x in f) for f in found]
            yield b

    return once.mapInPandas(parse, f"raw_path string, producer string, namespace string, written_at timestamp_ntz, fields {FIELD}, shared {SHARED}")


def unreadable_files(files: DataFrame) -> DataFrame:
    return parsed_files(files).where("fields is null").select("raw_path", "producer", "namespace")


def walk_block(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """Changes inside one block, plus summary rows: 'pend' (first known type after an unknown one) and 'end' (state left)."""
    producer, namespace, block = key
    out: list[tuple] = []
    state: dict[str, tuple[str, str | None]] | None = None
    known: dict[str, Field] = {}
    for row in b.sort_values("pos").itertuples():
        fields = {f["name"]: Field(f["name"], f["type"], f["shape"], tuple((s["word"], s["n"]) for s in f["shared"])) for f in row.fields}
        if state is None:
            context = row.pos < block * BLOCK
            state = {n: ("origin", n) if context else ("type", f.type) for n, f in fields.items()}
            known = fields
            continue
        gone = [n for n in state if n not in fields]
        come = [n for n in fields if n not in state]
        left = tuple(sorted(known[n]._replace(type=state[n][1] if state[n][0] == "type" else None) for n in gone))
        renamed = {new: old for old, new in match_fields(left, tuple(sorted(fields[n] for n in come)))} if gone and come else {}
        out += [(row.raw_path, "removed", n, None, None) for n in gone if n not in renamed.values()]
        out += [(row.raw_path, "renamed" if n in renamed else "added", n, renamed.get(n), None) for n in come]
        new: dict[str, tuple[str, str | None]] = {}
        for n, f in fields.items():
            kept = state.get(renamed.get(n, n)) if n in state or n in renamed else ("type", None)
            if f.type is not None:
                if kept[0] == "origin":
                    out.append((row.raw_path, "pend", n, kept[1], f.type))
                elif kept[1] is not None and kept[1] != f.type:
                    out.append((row.raw_path, "retyped", n, None, None))
                kept = ("type", f.type)
            new[n] = kept
        state, known = new, fields
    for n, (how, what) in (state or {}).items():
        out.append((None, "end", n, what if how == "origin" else None, what if how == "type" else None))
    return pd.DataFrame([(producer, namespace, block, *r) for r in out], columns=["producer", "namespace", "block", "raw_path", "kind", "field", "origin", "type"])


def settle(key: tuple, b: pd.DataFrame) -> pd.DataFrame:
    """The summaries of neighbouring blocks walked into one summary, with the retypings found on the way."""
    producer, namespace, level = key
    state: dict[str, tuple[str, str | None]] | None = None
    out: list[tuple] = []
    for _, rows in b.groupby("block", sort=True):
        for r in rows[rows["kind"] == "pend"].itertuples():
            how, what = ("origin", r.origin) if state is None else state.get(r.origin, ("type", None))
            if how == "origin":
                out.append((r.raw_path, "pend", r.field, what, r.type))
            elif what is not None and what != r.type:
                out.append((r.raw_path, "retyped", r.field, None, None))
        new = {}
        for r in rows[rows["kind"] == "end"].itertuples():
            if isinstance(r.origin, str):
                new[r.field] = ("origin", r.origin) if state is None else state.get(r.origin, ("type", None))
            else:
                new[r.field] = ("type", r.type if isinstance(r.type, str) else None)
        state = new
    for n, (how, what) in (state or {}).items():
        out.append((None, "end", n, what if how == "origin" else None, what if how == "type" else None))
    return pd.DataFrame([(producer, namespace, level, *r) for r in out], columns=["producer", "namespace", "block", "raw_path", "kind", "field", "origin", "type"])


WALKED = "producer string, namespace string, block long, raw_path string, kind string, field string, origin string, type string"


def with_shared_words(parsed: DataFrame) -> DataFrame:
    """raw_path, series, written_at and fields, each field with its words that several fields of one file bear, and of how many at most."""
    fans = parsed.select(F.explode("shared").alias("s")).groupBy("s.word").agg(F.max("s.n").alias("n"))
    names = parsed.select(F.explode("fields").alias("f")).select("f.name", F.explode(F.split("f.spelled", "_")).alias("word")).distinct()
    per_name = names.join(fans, "word").groupBy("name").agg(F.array_sort(F.collect_list(F.struct("word", "n"))).alias("shared"))
    long = parsed.select("raw_path", *SERIES, "written_at", F.posexplode_outer("fields").alias("at", "f")).select("raw_path", *SERIES, "written_at", "at", F.col("f.name").alias("name"), F.col("f.type").alias("type"), F.col("f.shape").alias("shape"))
    long = lookup_join(long, per_name, ["name"], ["raw_path"])
    field = F.struct("at", "name", "type", "shape", F.coalesce("shared", F.expr(f"cast(array() as {SHARED})")).alias("shared"))
    again = long.groupBy("raw_path", *SERIES, "written_at").agg(F.array_sort(F.collect_list(F.when(F.col("name").isNotNull(), field))).alias("fields"))
    return again.withColumn("fields", F.expr("transform(fields, f -> named_struct('name', f.name, 'type', f.type, 'shape', f.shape, 'shared', f.shared))"))


def walked_blocks(parsed: DataFrame) -> DataFrame:
    """The rows of walk_block over all series of parsed files; a renamed row has the field's old name as its origin."""
    # Written once: the word counts and the ordering read it several times, and each time every file would be parsed.
    parsed = cut_lineage(parsed.where("fields is not null").withColumn("fields", F.expr("transform(fields, f -> named_struct('name', f.name, 'type', f.type, 'shape', f.shape, 'spelled', f.spelled))")))
    placed = numbered(with_shared_words(parsed), SERIES, ["written_at", "raw_path"])
    block = F.floor(F.col("pos") / BLOCK)
    # The last file of a block is also the context of the next one.
    placed = placed.withColumn("block", F.explode(F.when(F.col("pos") % BLOCK == BLOCK - 1, F.array(block, block + 1)).otherwise(F.array(block))))
    # A stated number of partitions: adaptive execution would put all of these small groups into one or two tasks.
    placed = placed.select(*SERIES, "block", "pos", "raw_path", "fields").repartition(stated_tasks(parsed.sparkSession), *SERIES, "block")
    return cut_lineage(placed.groupBy(*SERIES, "block").applyInPandas(walk_block, WALKED))


def changes(files: DataFrame) -> DataFrame:
    """raw_path, change (added, removed, renamed, retyped), field: every difference of a file to the one before it in its series."""
    walked = walked_blocks(parsed_files(files))
    found = walked.where("kind not in ('pend', 'end')")
    level = walked.where("kind in ('pend', 'end')")
    n_blocks = (level.agg(F.max("block")).first()[0] or 0) + 1
    while n_blocks > 1:
        # One level up: BLOCK blocks become one, so even a billion files of one series need two levels.
        up = F.floor(F.col("block") / BLOCK)
        level = cut_lineage(level.withColumn("up", up).groupBy(*SERIES, "up").applyInPandas(settle, WALKED))
        found = found.unionByName(level.where("kind = 'retyped'"))
        level = level.where("kind in ('pend', 'end')")
        n_blocks = -(-n_blocks // BLOCK)
    return found.select("raw_path", F.col("kind").alias("change"), "field").distinct()


def metric_names(fields: DataFrame, renames: DataFrame) -> DataFrame:
    """field, metric: one metric for all fields that renames (origin, field) or an equal spelling link, named by the shortest spelling among them.

    Spellings are equal if they have the same words and numbers in any order.
    """
    named = cut_lineage(fields.groupBy("field").agg(F.max("spelled").alias("spelled")).withColumn("set", F.array_join(F.array_sort(F.split("spelled", "_")), "_")))
    of = lambda c: named.select(F.col("field").alias(c), F.col("set").alias(f"{c}_set"))
    linked = renames.join(of("origin"), "origin").join(of("field"), "field").where("origin_set <> field_set").select(F.lit("").alias("dataset"), F.col("origin_set").alias("ahash"), F.col("field_set").alias("other")).distinct()
    led = leaders(linked).select(F.col("ahash").alias("set"), "leader")
    named = named.join(led, "set", "left").withColumn("leader", F.coalesce("leader", "set"))
    best = named.groupBy("leader").agg(F.min(F.struct(F.length("spelled"), "spelled")).alias("m")).select("leader", F.col("m.spelled").alias("metric"))
    return named.join(best, "leader").select("field", "metric")


def consistent_table(files: DataFrame) -> DataFrame:
    """All files in one table: raw_path, producer, namespace, written_at, metric (one name for all its spellings), field, type, number, text.

    The correspondences that the walk selects are carried through every series, so a metric keeps its name along a chain of spellings.
    A value is cast to number where it reads as one; any other value stays in text. Nulls stay as rows with neither.
    """
    parsed = cut_lineage(parsed_files(files))
    renames = walked_blocks(parsed).where("kind = 'renamed'").select("origin", "field").distinct()
    long = parsed.select("raw_path", *SERIES, "written_at", F.explode("fields").alias("f")).select("raw_path", *SERIES, "written_at", F.col("f.name").alias("field"), F.col("f.type").alias("type"), F.col("f.value").alias("value"), F.col("f.spelled").alias("spelled"))
    names = metric_names(long, renames)
    number = F.expr("try_cast(value as double)")
    return lookup_join(long, names, ["field"], ["raw_path"], "inner").select("raw_path", *SERIES, "written_at", "metric", "field", "type", F.when(F.col("type") == "number", number).alias("number"), F.when(F.coalesce(F.col("type"), F.lit("number")) != "number", F.col("value")).alias("text"))
