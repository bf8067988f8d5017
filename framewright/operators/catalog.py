"""Catalog, class maps, lineage and synchronisation as set operations on small and long tables.

A catalog row is (dataset, classes MAP name -> id, structure, images, labels, dataset_hash, source_signature, modified, ...).
"""

from __future__ import annotations

import json
import re
from itertools import count

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.operators import dewey
from framewright.operators.ordered import numbered

# Fields that a refresh keeps from the former catalog.
PRESERVED = ("tags", "roi_auto", "data_path", "archive")


def class_rows(catalog: DataFrame) -> DataFrame:
    """dataset, name, cls_id of every class in the catalog's maps."""
    return catalog.select("dataset", F.explode("classes").alias("name", "cls_id"))


def normalized(rows: DataFrame, alias: DataFrame, column: str = "name") -> DataFrame:
    """Add canonical: the alias's target, else the name itself. The alias list is joined as the optimizer sees fit."""
    a = alias.where("alias is not null").groupBy(F.col("alias").alias(column)).agg(F.min("canonical").alias("_c"))
    return rows.join(a, column, "left").withColumn("canonical", F.coalesce("_c", column)).drop("_c")


def class_union(rows: DataFrame) -> DataFrame:
    return rows.select("canonical").where("canonical is not null").distinct()


def datasets_with(rows: DataFrame, wanted: list[str], every: bool) -> DataFrame:
    """Data sets that have all (or any) of the wanted canonical classes: relational division by counting."""
    got = rows.where(F.col("canonical").isin(*wanted)).groupBy("dataset").agg(F.count_distinct("canonical").alias("n_found"))
    return got.where(F.col("n_found") == len(set(wanted))) if every else got


def common_classes(rows: DataFrame) -> DataFrame:
    """Classes that all data sets share most: data sets per class, and whether all have it."""
    n = rows.agg(F.count_distinct("dataset").alias("_n"))
    per = rows.where("canonical is not null").groupBy("canonical").agg(F.count_distinct("dataset").alias("n_datasets"))
    return per.crossJoin(n).select("canonical", "n_datasets", (F.col("n_datasets") == F.col("_n")).alias("in_all"))  # one row


def relatedness(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Pairs of data sets whose common canonical classes are at least the share `least` of the larger set: common and share.

    Prefix filter: with classes in one order, rarest first, such a pair shares a class among the first n - ceil(least n) + 1 of each,
    so only those meet; a class that all data sets have stands last and brings no pairs together. Shares are exact for what met.
    """
    c = rows.where("canonical is not null").select("dataset", "canonical").distinct()
    size = c.groupBy("dataset").agg(F.count(F.lit(1)).alias("n"))
    often = c.groupBy("canonical").agg(F.count(F.lit(1)).alias("often"))
    placed = numbered(c.join(often, "canonical"), ["dataset"], ["often", "canonical"], total=True)
    head = placed.where(F.col("pos") <= F.col("total") - F.ceil(least * F.col("total") - 1e-9)).select("dataset", "canonical")
    met = head.join(head.select(F.col("dataset").alias("other"), "canonical"), "canonical").where("dataset < other").select("dataset", "other").distinct()
    common = met.join(c, "dataset").join(c.select(F.col("dataset").alias("other"), "canonical"), ["other", "canonical"]).groupBy("dataset", "other").agg(F.count(F.lit(1)).alias("common"))
    both = common.join(size, "dataset").join(size.select(F.col("dataset").alias("other"), F.col("n").alias("m")), "other")
    return both.select("dataset", "other", "common", F.round(F.col("common") / F.greatest("n", "m"), 6).alias("related")).where(F.col("related") >= least)


def compact_map(used: DataFrame) -> DataFrame:
    """Per data set: each used id and canonical name with its compact new id (canonical names in order, from 0)."""
    u = used.select("dataset", "cls_id", "canonical").distinct()
    names = u.select("dataset", "canonical").distinct().withColumn("new_id", F.row_number().over(Window.partitionBy("dataset").orderBy("canonical")) - 1)
    return u.join(names, ["dataset", "canonical"]).select("dataset", F.col("cls_id").alias("old_id"), "canonical", "new_id")


def remapped(labels: DataFrame, id_map: DataFrame, keep_unmapped: bool = False) -> DataFrame:
    """Labels with new class ids; unmapped labels are dropped, or kept under their old id."""
    m = id_map.select("dataset", F.col("old_id").alias("cls_id"), "new_id").distinct()
    out = labels.join(m, ["dataset", "cls_id"], "left" if keep_unmapped else "inner")
    return out.withColumn("new_id", F.coalesce("new_id", "cls_id"))


def diff(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Keys added and removed."""
    a, b = old.select(key).distinct(), new.select(key).distinct()
    return b.join(a, key, "left_anti").withColumn("change", F.lit("added")).unionByName(a.join(b, key, "left_anti").withColumn("change", F.lit("removed")))


def sync_plan(source: DataFrame, target: DataFrame) -> DataFrame:
    """Per data set: new, missing, same or conflict by hash."""
    s = source.select("dataset", F.col("dataset_hash").alias("sh"), F.lit(1).alias("_s"))
    t = target.select("dataset", F.col("dataset_hash").alias("th"), F.lit(1).alias("_t"))
    what = F.when(F.col("_t").isNull(), "new").when(F.col("_s").isNull(), "missing").when(F.col("sh").eqNullSafe(F.col("th")), "same").otherwise("conflict")
    return s.join(t, "dataset", "full_outer").select("dataset", what.alias("action"))


def refreshed(fresh: DataFrame, former: DataFrame) -> DataFrame:
    """A fresh scan with the preserved fields of the former catalog and the modified flag (hash changed and not yet flagged)."""
    kept = [c for c in PRESERVED if c in former.columns]
    f = former.select("dataset", F.col("dataset_hash").alias("_h"), F.col("modified").alias("_m"), *[F.col(c).alias(f"_{c}") for c in kept])
    out = fresh.drop("modified").join(f, "dataset", "left")
    out = out.withColumn("modified", F.coalesce("_m", F.lit(False)) | (F.col("_h").isNotNull() & ~F.col("_h").eqNullSafe(F.col("dataset_hash"))))
    for c in kept:
        out = out.withColumn(c, F.coalesce(F.col(f"_{c}"), F.col(c)) if c in fresh.columns else F.col(f"_{c}"))
    return out.drop("_h", "_m", *[f"_{c}" for c in kept])


def rename_plan(tables: dict[str, tuple[DataFrame, str]], old: str, new: str, documents: tuple[str, ...] = ()) -> DataFrame:
    """Every path or name that holds the old data set name as a whole segment, with its new form.

    The tables named in documents hold JSON texts, which are patched at any depth. A text that is no valid JSON but holds the name
    cannot be patched and stands with a null new_value.
    """
    pattern = rf"(^|[/\\]){old}(?=$|[/\\])"
    out = None
    for name, (df, column) in tables.items():
        value = F.col(column)
        if name in documents:
            named = df.where(value.contains(old)).select(value.alias("old_value")).distinct().withColumn("_p", patch_json(F.col("old_value"), old, new))
            broken = F.try_parse_json("old_value").isNull() & F.col("old_value").rlike(rf'(^|["/\\]){old}($|["/\\])')
            got = named.select(F.lit(name).alias("table_name"), "old_value", F.when(F.col("_p") != F.col("old_value"), F.col("_p")).alias("new_value"), broken.alias("_b")).where("new_value is not null or _b").drop("_b")
        else:
            got = df.where(value.rlike(pattern)).select(F.lit(name).alias("table_name"), value.alias("old_value"), F.regexp_replace(column, pattern, f"$1{new}").alias("new_value")).distinct()
        out = got if out is None else out.unionByName(got)
    return out


def patch_json(column, old: str, new: str):
    """Data set references renamed at any depth of a JSON text, in JSON texts inside it too: whole string values and whole path segments. Texts without one stay as they are."""
    segment = re.compile(rf"(^|[/\\]){re.escape(old)}(?=$|[/\\])")

    def walk(v):
        if isinstance(v, dict):
            return {k: walk(x) for k, x in v.items()}
        if isinstance(v, list):
            return [walk(x) for x in v]
        if isinstance(v, str) and old in v:
            return text(v) if v.lstrip()[:1] in ("[", "{") else segment.sub(lambda m: m[1] + new, v)
        return v

    def text(t):
        try:
            was = json.loads(t)
            now = walk(was)
        except (ValueError, RecursionError):
            return t
        return t if now == was else json.dumps(now, ensure_ascii=False)

    @F.pandas_udf("string")
    def patch(texts):
        return texts.map(lambda t: text(t) if t is not None and old in t else t)

    patch.__annotations__ = {}
    return patch(column)


def lineage(catalog: DataFrame) -> DataFrame:
    """output, step, command, input, input_hash of every history step in the catalog entries; a lone object or JSON text stands for its list."""
    key = F.concat(F.md5("catalog_entry"), "dataset")  # entries of one data set stay apart
    flat = dewey.flatten(catalog.withColumn("key", key), "key", "catalog_entry", kinds=("element",)).where("schema_path in ('history', 'history.inputs')")
    at = flat.withColumn("step", F.expr(r"try_cast(regexp_extract(child_path, r'^history\[(\d+)\]', 1) as int)")).where("step is not null")
    used = F.when(F.col("schema_path") == "history.inputs", F.struct(F.col("fields")["name"].alias("name"), F.col("fields")["hash"].alias("hash")))
    h = at.groupBy("record_key", "step").agg(F.max(F.when(F.col("schema_path") == "history", F.col("fields")["command"])).alias("command"), F.collect_list(used).alias("inputs"))
    return h.select(F.expr("substr(record_key, 33)").alias("output"), "step", "command", F.explode("inputs").alias("i")).select("output", "step", "command", F.col("i.name").alias("input"), F.col("i.hash").alias("input_hash"))


def ancestors(edges: DataFrame) -> DataFrame:
    """All ancestors of each output with their least distance: frontier joins, each round only over what it newly found, until nothing is new."""
    from framewright.session import cut_lineage

    step = cut_lineage(edges.where("input is not null and output <> input").select("output", "input").distinct())
    known = frontier = step.withColumn("depth", F.lit(1))
    for depth in count(2):
        reach = frontier.select("output", F.col("input").alias("mid")).join(step.select(F.col("output").alias("mid"), "input"), "mid").where("output <> input").select("output", "input").distinct()
        frontier = cut_lineage(reach.join(known, ["output", "input"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.limit(1).count() == 0:
            break
        known = cut_lineage(known.unionByName(frontier))
    return known.select("output", F.col("input").alias("ancestor"), "depth")


def scan_delta(listing: DataFrame, former: DataFrame) -> DataFrame:
    """Sources to scan: those whose signature is not in the former scan (incremental skip)."""
    return listing.join(former.select("dataset", "source_signature").where("source_signature is not null").distinct(), ["dataset", "source_signature"], "left_anti")


def merge_config_issues(rules: DataFrame, known: DataFrame) -> DataFrame:
    """Faults of merge rules (target, source): sources under two targets, and sources that no class has."""
    twice = rules.groupBy("source").agg(F.count_distinct("target").alias("n")).where("n > 1").select("source", F.lit("two_targets").alias("issue"))
    unknown = rules.select("source").distinct().join(known.select(F.col("canonical").alias("source")).distinct(), "source", "left_anti").select("source", F.lit("unknown").alias("issue"))
    return twice.unionByName(unknown)


def fingerprint(columns: list[str]):
    """Sixteen hex digits of a sha256 over a row's fields as JSON, names in order of the alphabet, nulls written out."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, 16)


def upsert(existing: DataFrame, changes: DataFrame, keys: list[str], at: str) -> DataFrame:
    """Latest row per key of two frames of one schema (append-only tables read as of now)."""
    both = existing.unionByName(changes, allowMissingColumns=True)
    rest = [c for c in both.columns if c not in keys]
    return both.groupBy(*keys).agg(F.max_by(F.struct(*rest), at).alias("_r")).select(*keys, "_r.*")
