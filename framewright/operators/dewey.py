"""Deeply nested records as related flat tables, by Dewey labels.

Every node of a record gets an ordinal path from the root (0.2.1 ...). Both links of a row are derived by truncating its label until
a row above is met, and its table is its schema path (the path without positions). One pass over the text, no shuffle: the flat
tables are filters on it.
Every object is a row with its own scalars as fields (the record itself too, with schema path ''), and so is every scalar in a list
(field "value"), so each leaf value of a record stands in exactly one row. kind says what a row is: root, element (an object in a
named list), object (any other) or value. parent_dewey is the row above of any kind, parent_path the nearest element of a named list.

Defined results: text that is not valid JSON (or nested deeper than the JSON reader follows), or null, gives no rows; repeated rows of a record count once; null elements keep
their position and give no row, null fields give no entry; a named list given as JSON text is read and is no field of its parent;
empty input gives empty output; extra columns are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The lists whose elements become rows of their own tables.
LISTS = ("artifacts", "models", "runs", "metrics", "predictions", "test_metrics", "per_class", "thresholds", "history", "inputs", "regions")
SCHEMA = "record_key string, dewey string, parent_dewey string, schema_path string, list_name string, child_path string, parent_path string, fields map<string,string>, kind string"


def no_constant(name: str) -> float:
    raise ValueError(name)


def as_list(value: Any) -> Any:
    """A list of records given as a list, as one object, or as JSON text of either; anything else as it is."""
    if isinstance(value, str) and value.lstrip()[:1] in ("[", "{"):
        try:
            value = json.loads(value, parse_constant=no_constant)
        except (ValueError, RecursionError):
            return value
    return [value] if isinstance(value, dict) else value


def as_text(value: Any) -> str:
    return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def above(label: str, rows: dict[str, tuple[str, str]], kind: str | None = None) -> str:
    """The nearest row above a label, of a kind if one is given: the label truncated until one is there; '' if none."""
    while (cut := label.rfind(".")) >= 0:
        label = label[:cut]
        if label in rows and kind in (None, rows[label][0]):
            return label
    return ""


def nodes(key: str, text: str, lists: frozenset[str]) -> Iterator[tuple]:
    """One tuple per object and per scalar in a list, in document order, without recursion."""
    try:
        root = json.loads(text, parse_constant=no_constant)
    except (ValueError, RecursionError):
        return
    # path, dewey label, schema path, name of the list, kind, value
    stack: list[tuple[str, str, str, str, str, Any]] = [("", "0", "", "", "root", root)]
    rows: dict[str, tuple[str, str]] = {}  # label -> kind and path of the rows so far, by which links are derived
    while stack:
        path, label, schema, name, kind, value = stack.pop()
        below: list[tuple[str, str, str, str, str, Any]] = []
        fields: dict[str, str] | None = None
        if isinstance(value, dict):
            fields = {}
            for i, (k, v) in enumerate(value.items()):
                v = as_list(v) if k in lists else v
                if isinstance(v, dict | list):
                    below.append((f"{path}.{k}" if path else k, f"{label}.{i}", f"{schema}.{k}" if schema else k, k if k in lists else "", "object", v))
                elif v is not None:
                    fields[k] = as_text(v)
        elif isinstance(value, list):
            fields = {} if kind == "root" else None
            for j, x in enumerate(value):
                if x is not None:
                    what = "value" if not isinstance(x, dict | list) else "element" if name and isinstance(x, dict) else "object"
                    below.append((f"{path}[{j}]", f"{label}.{j}", schema, "" if isinstance(x, list) else name, what, x))
        elif value is not None:
            fields = {"value": as_text(value)}
        if fields is not None:
            element = above(label, rows, "element")
            yield key, label, above(label, rows), schema, name, path, rows[element][1] if element else "", fields, kind
            rows[label] = kind, path
        stack += reversed(below)


def flatten(records: DataFrame, key: str, text: str, lists: tuple[str, ...] = LISTS, kinds: tuple[str, ...] = ("root", "element", "object", "value")) -> DataFrame:
    """All rows of all records, or those of some kinds: record_key, Dewey label and that of the parent, schema path, paths, scalar fields as text, and kind."""
    wanted = frozenset(lists)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in SCHEMA.split(", ")]
        for b in batches:
            for start in range(0, len(b), 500):
                part = b.iloc[start : start + 500]
                yield pd.DataFrame([n for k, t in zip(part["k"], part["t"], strict=True) for n in nodes(k, t, wanted) if n[-1] in kinds], columns=columns)

    once = records.select(F.col(key).alias("k"), F.col(text).alias("t")).where("k is not null and t is not null").groupBy("k").agg(F.max("t").alias("t"))
    return once.mapInPandas(run, SCHEMA)


def links(records: DataFrame, key: str, text: str) -> DataFrame:
    """record_key, parent_path, child_path of every list element."""
    return flatten(records, key, text, kinds=("element",)).select("record_key", "parent_path", "child_path").distinct()


def flat_table(flat: DataFrame, schema_path: str, fields: dict[str, str]) -> DataFrame:
    """The table of one schema path with typed columns; dewey and parent_dewey keep the link to the parent's table."""
    return flat.where(F.col("schema_path") == schema_path).select("record_key", "dewey", "parent_dewey", "parent_path", "child_path", *[F.expr(f"try_cast(fields['{n}'] as {t})").alias(n) for n, t in fields.items()])


def table_profile(flat: DataFrame) -> DataFrame:
    """Each flat table with its rows, records, rows under no list element, and values held, by which the tables can be reckoned against the records."""
    return flat.groupBy("schema_path").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("record_key").alias("n_records"), F.count_if(F.col("parent_path") == "").alias("n_roots"), F.sum(F.size("fields")).alias("n_values"))
