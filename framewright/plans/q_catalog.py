"""Queries of duplicates, catalogs, class maps and lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import catalog as C
from framewright.operators import dedup as D
from framewright.operators.ordered import numbered
from framewright.plans import views as V
from framewright.plans.core_problems import TREE
from framewright.session import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


def rows(s, d):
    return C.normalized(C.class_rows(table(s, d, "dataset_catalog")), table(s, d, "class_alias"))


ROWS = "rows as (select r.dataset, r.name, r.cls_id, coalesce(a.c, r.name) as canonical from (select dataset, unnest(map_keys(classes)) as name, unnest(map_values(classes)) as cls_id from dataset_catalog) r left join (select alias, min(canonical) as c from class_alias group by 1) a on r.name = a.alias)"
DUP = "dup as (select dataset, n_bytes, content_hash, count(*) as n_files, count(distinct split) as n_splits, count(distinct split) > 1 as cross_split from img where content_hash is not null and n_bytes is not null group by 1, 2, 3 having count(*) > 1)"


@query("exact_duplicates", V.with_(V.IMG, DUP) + "select * from dup")
def _(s, d):
    return D.exact_groups(V.frames(s, d, "n_bytes", "content_hash"))


@query("duplicate_counts", V.with_(V.IMG, DUP) + "select dataset, count(*) as groups, sum(n_files)::bigint as files, count(*) filter (cross_split) as duplicate_cross_split_groups from dup group by 1")
def _(s, d):
    return D.duplicate_counts(V.frames(s, d, "n_bytes", "content_hash"))


@query("prune_dedup", V.with_(V.IMG) + "select image_id from img where content_hash is not null qualify row_number() over (partition by content_hash order by case split when 'train' then 0 when 'val' then 1 when 'test' then 2 else 3 end, image_id) > 1")
def _(s, d):
    return D.pruned_duplicates(V.frames(s, d, "content_hash")).select("image_id")


NEAR = "h as (select distinct dataset, ahash from img where ahash is not null), near as (select a.dataset, a.ahash, b.ahash as other from h a join h b on a.dataset = b.dataset and a.ahash < b.ahash and bit_count(xor(a.ahash, b.ahash)) <= 5)"


@query("near_duplicate_pairs", V.with_(V.IMG, NEAR) + "select * from near")
def _(s, d):
    return D.near_pairs(V.frames(s, d, "ahash"))


@query("near_duplicate_groups", "with recursive " + V.IMG + ", " + NEAR + ", e as (select dataset, ahash as a, other as b from near union all select dataset, other, ahash from near), r as (select dataset, a, a as l from e union select r.dataset, e.b, r.l from r join e on e.dataset = r.dataset and e.a = r.a) select dataset, a as ahash, min(l) as leader from r group by 1, 2")
def _(s, d):
    return D.leaders(D.near_pairs(V.frames(s, d, "ahash")))


GROUPS = "with recursive " + V.IMG + """,
o as (select dataset, ahash, coalesce(split, '-') as split, row_number() over (partition by dataset order by case split when 'train' then 0 when 'val' then 1 when 'test' then 2 else 3 end, image_id) as rn from img where ahash is not null and dataset is not null),
later as (select a.dataset, a.rn, list(b.rn) as ids, count(distinct b.split) > 1 or any_value(a.split) <> any_value(b.split) as crosses from o a join o b on a.dataset = b.dataset and a.rn < b.rn and bit_count(xor(a.ahash, b.ahash)) <= 5 group by 1, 2),
walk as (select dataset, 0::bigint as rn, []::bigint[] as used, 0 as n, 0 as x from (select distinct dataset from o)
 union all select w.dataset, w.rn + 1, case when l.ids is null or list_contains(w.used, w.rn + 1) then w.used else list_concat(w.used, l.ids) end, w.n + (l.ids is not null and not list_contains(w.used, w.rn + 1))::int, w.x + (l.ids is not null and l.crosses and not list_contains(w.used, w.rn + 1))::int
 from walk w left join later l on l.dataset = w.dataset and l.rn = w.rn + 1 where w.rn < (select max(rn) from o where o.dataset = w.dataset))
"""


@query("near_duplicate_counts", GROUPS + "select dataset, max(n)::bigint as near_groups, max(x)::bigint as near_cross_split_groups from walk group by 1 having max(n) > 0")
def _(s, d):
    return D.near_group_counts(V.frames(s, d, "ahash"))


@query("label_signatures", V.with_(V.ANN) + "select dataset, image_id, md5(string_agg(line, '|' order by line)) as signature, count(*) as n_labels from (select dataset, image_id, case when kind = 'bbox' then concat_ws(' ', coalesce(cls_id::varchar, '-'), printf('%.6f', cx), printf('%.6f', cy), printf('%.6f', w), printf('%.6f', h)) else concat_ws(' ', coalesce(cls_id::varchar, '-'), array_to_string(list_transform(points, lambda p: printf('%.6f %.6f', p.x, p.y)), ' ')) end as line from ann) group by 1, 2")
def _(s, d):
    return D.label_signatures(V.annotations(s, d, "kind", "cls_id", "cx", "cy", "w", "h", "points"))


UNION = """with recursive """ + V.ANN + ", " + V.IMG + """,
f as (select image_id, content_hash, case split when 'train' then 0 when 'val' then 1 when 'test' then 2 else 3 end as r, count(*) over (partition by content_hash) as copies from img where content_hash is not null),
b as (select a.*, f.content_hash, r, copies from ann a join f using (image_id) where kind = 'bbox'),
once as (select content_hash, cls_id, cx, cy, w, h, row_number() over (partition by content_hash order by o) as rn from (select content_hash, cls_id, round(cx, 8) as cx, round(cy, 8) as cy, round(w, 8) as w, round(h, 8) as h, min((r, image_id, line_no)) as o from b where copies > 1 group by 1, 2, 3, 4, 5, 6)),
pair as (select p.content_hash, p.rn, g.rn as other, least(p.cx + p.w / 2, g.cx + g.w / 2) - greatest(p.cx - p.w / 2, g.cx - g.w / 2) as wide, least(p.cy + p.h / 2, g.cy + g.h / 2) - greatest(p.cy - p.h / 2, g.cy - g.h / 2) as high, p.w * p.h + g.w * g.h as both_ from once p join once g on p.content_hash = g.content_hash and p.cls_id = g.cls_id and g.rn < p.rn),
block as (select content_hash, rn, list(other) as by_ from pair where wide > 0 and high > 0 and wide * high / (both_ - wide * high) >= 0.95 group by 1, 2),
walk as (select distinct content_hash, 0::bigint as rn, []::bigint[] as kept from once
 union all select w.content_hash, o.rn, case when coalesce(list_has_any(w.kept, k.by_), false) then w.kept else list_append(w.kept, o.rn) end from walk w join once o on o.content_hash = w.content_hash and o.rn = w.rn + 1 left join block k on k.content_hash = o.content_hash and k.rn = o.rn)
"""


@query("merge_label_union", UNION + "select content_hash, count(*) as n_boxes from b where copies = 1 group by 1 union all select content_hash, max(len(kept))::bigint from walk group by 1")
def _(s, d):
    return D.merged_labels(V.annotations(s, d, "kind", "cls_id", "cx", "cy", "w", "h"), V.frames(s, d, "content_hash")).groupBy("content_hash").agg(F.count(F.lit(1)).alias("n_boxes"))


@query("dataset_fingerprint", V.with_(V.IMG) + "select dataset, substr(md5(cast(sum(('0x' || substr(md5(concat_ws(':', stem, n_bytes::varchar)), 1, 10))::hugeint) as varchar)), 1, 8) as dataset_hash, count(*) as n from img group by 1")
def _(s, d):
    return D.dataset_hashes(V.frames(s, d, "stem", "n_bytes"))


REFS = "refs as (select label, vec_id as ref_id, embedding as ref from embeddings qualify row_number() over (partition by label order by vec_id) <= 3)"


@query("template_similarity", V.with_(REFS) + "select vec_id, ref_id, sim from (select vec_id, ref_id, round(list_cosine_similarity(embedding::double[], ref::double[]), 6) as sim from embeddings join refs using (label)) qualify row_number() over (partition by vec_id order by sim desc, ref_id) = 1")
def _(s, d):
    e = table(s, d, "embeddings")
    # The first three of each label by rank: no label's ids are collected.
    first = numbered(e.select("label", "vec_id"), ["label"], ["vec_id"]).where("pos < 3").select("vec_id")
    return D.template_similarity(e, e.join(first, "vec_id"))


@query("embedding_signatures", "select vec_id, list_sum([case when x::double >= m then 1 else 0 end for x in embedding])::bigint as ones from (select vec_id, embedding, list_avg(embedding::double[]) as m from embeddings)")
def _(s, d):
    e = table(s, d, "embeddings").select("vec_id", D.average_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("sig"))
    return e.select("vec_id", F.bit_count("sig").cast("long").alias("ones"))


SPREAD = """with recursive v as (select label, vec_id, array_to_string([case when x::double >= m then '1' else '0' end for x in embedding], '')::bit as sig from (select label, vec_id, embedding, list_sum(embedding::double[]) / 64 as m from embeddings)),
walk as (select label, 0 as turn, [min(vec_id)] as ids, [arg_min(sig, vec_id)] as sigs from v group by 1
 union all select label, turn + 1, list_append(ids, best.vec_id), list_append(sigs, best.sig) from (select w.label, w.turn, w.ids, w.sigs, arg_max({'vec_id': v.vec_id, 'sig': v.sig}, (list_min(list_transform(w.sigs, lambda x: bit_count(xor(x, v.sig)))), -v.vec_id)) as best from walk w join v on v.label = w.label where w.turn < 4 and not list_contains(w.ids, v.vec_id) group by all))
"""


@query("diverse_sample", SPREAD + "select label, turn, ids[turn + 1] as vec_id from walk")
def _(s, d):
    e = table(s, d, "embeddings").select("label", "vec_id", D.average_hash(F.transform("embedding", lambda x: x.cast("double"))).alias("sig"))
    return D.farthest_first(e, 5)


@query("class_union", V.with_(ROWS) + "select distinct canonical from rows")
def _(s, d):
    return C.class_union(rows(s, d))


@query("class_selection_all", V.with_(ROWS) + "select dataset, count(distinct canonical) as n_found from rows where canonical in ('hard_hat', 'site_toilet') group by 1 having count(distinct canonical) = 2")
def _(s, d):
    return C.datasets_with(rows(s, d), ["hard_hat", "site_toilet"], True)


@query("class_selection_any", V.with_(ROWS) + "select dataset, count(distinct canonical) as n_found from rows where canonical in ('hard_hat', 'site_toilet') group by 1")
def _(s, d):
    return C.datasets_with(rows(s, d), ["hard_hat", "site_toilet"], False)


@query("common_classes", V.with_(ROWS) + "select canonical, count(distinct dataset) as n_datasets, count(distinct dataset) = (select count(distinct dataset) from rows) as in_all from rows group by 1")
def _(s, d):
    return C.common_classes(rows(s, d))


@query("dataset_relatedness", V.with_(ROWS, "c as (select distinct dataset, canonical from rows)", "n as (select dataset, count(*) as n from c group by 1)") + "select a.dataset, b.dataset as other, count(*) as common, round(count(*) / greatest(any_value(x.n), any_value(y.n)), 6) as related from c a join c b on a.canonical = b.canonical and a.dataset < b.dataset join n x on x.dataset = a.dataset join n y on y.dataset = b.dataset group by 1, 2 having round(count(*) / greatest(any_value(x.n), any_value(y.n)), 6) >= 0.3")
def _(s, d):
    return C.relatedness(rows(s, d), 0.3)


CMAP = "used as (select distinct c.dataset, c.cls_id, coalesce(a.canonical, c.name) as canonical from classes c left join (select alias, min(canonical) as canonical from class_alias group by 1) a on a.alias = c.name where c.name is not null and c.cls_id is not null), cmap as (select u.dataset, cls_id as old_id, u.canonical, new_id from used u join (select dataset, canonical, (row_number() over (partition by dataset order by canonical) - 1)::int as new_id from (select distinct dataset, canonical from used)) n on n.dataset = u.dataset and n.canonical = u.canonical)"


def cmap(s, d):
    c = C.normalized(table(s, d, "classes").where("name is not null and cls_id is not null"), table(s, d, "class_alias"))
    return C.compact_map(c)


@query("class_remap_compact", V.with_(CMAP) + "select * from cmap")
def _(s, d):
    return cmap(s, d)


@query("labels_remapped", V.with_(V.ANN, CMAP) + "select a.dataset, m.new_id, count(*) as n from ann a join (select distinct dataset, old_id, new_id from cmap) m on m.dataset = a.dataset and m.old_id = a.cls_id group by 1, 2")
def _(s, d):
    return C.remapped(V.annotations(s, d, "cls_id"), cmap(s, d)).groupBy("dataset", "new_id").agg(F.count(F.lit(1)).alias("n"))


@query("catalog_diff", "select dataset_name as dataset, 'added' as change from (select distinct dataset_name from runs except select dataset from dataset_catalog) union all select dataset, 'removed' from (select dataset from dataset_catalog except select distinct dataset_name from runs)")
def _(s, d):
    return C.diff(table(s, d, "dataset_catalog"), table(s, d, "runs").withColumnRenamed("dataset_name", "dataset"), "dataset")


@query("catalog_sync", V.with_(V.IMG, "t as (select dataset, substr(md5(cast(sum(('0x' || substr(md5(concat_ws(':', stem, n_bytes::varchar)), 1, 10))::hugeint) as varchar)), 1, 8) as dataset_hash from img group by 1)") + "select coalesce(s.dataset, t.dataset) as dataset, case when t.dataset is null then 'new' when s.dataset is null then 'missing' when s.dataset_hash is not distinct from t.dataset_hash then 'same' else 'conflict' end as action from dataset_catalog s full join t using (dataset)")
def _(s, d):
    return C.sync_plan(table(s, d, "dataset_catalog"), D.dataset_hashes(V.frames(s, d, "stem", "n_bytes")))


@query("catalog_refresh", V.with_(V.IMG, "f as (select dataset, substr(md5(cast(sum(('0x' || substr(md5(concat_ws(':', stem, n_bytes::varchar)), 1, 10))::hugeint) as varchar)), 1, 8) as dataset_hash from img group by 1)") + "select f.dataset, f.dataset_hash, coalesce(c.modified, false) or (c.dataset_hash is not null and c.dataset_hash is distinct from f.dataset_hash) as modified from f left join dataset_catalog c using (dataset)")
def _(s, d):
    return C.refreshed(D.dataset_hashes(V.frames(s, d, "stem", "n_bytes")).drop("n"), table(s, d, "dataset_catalog"))


# Where data sets are named besides runs.run_dir: names, paths and JSON documents.
REFERENCES = {
    "annotations": "dataset", "classes": "dataset", "cvat_boxes": "dataset", "dataset_catalog": "dataset catalog_entry", "documents": "dataset", "exports": "dataset", "images": "dataset source_ref", "label_files": "dataset label_path",
    "label_lines": "dataset rel_label", "metric_files": "raw_path run_dir", "run_payloads": "run_dir payload", "runs": "dataset_name", "sample_targets": "dataset",
}
DOCUMENTS = ("dataset_catalog.catalog_entry", "run_payloads.payload")


PATHS = {f"{t}.{c}": (t, c) for t, columns in REFERENCES.items() for c in columns.split() if f"{t}.{c}" not in DOCUMENTS}
RENAMED = " union all ".join(rf"select distinct '{name}' as table_name, {c} as old_value, regexp_replace(regexp_replace({c}, '(^|[/\\])yard_north($|[/\\])', '\1yard_south\2', 'g'), '(^|[/\\])yard_north($|[/\\])', '\1yard_south\2', 'g') as new_value from {t} where regexp_matches({c}, '(^|[/\\])yard_north($|[/\\])')" for name, (t, c) in ({"runs": ("runs", "run_dir")} | PATHS).items())


@query("rename_plan", RENAMED)
def _(s, d):
    at = {name: (table(s, d, t), c) for name, (t, c) in PATHS.items()}
    return C.rename_plan({"runs": (table(s, d, "runs"), "run_dir")} | at, "yard_north", "yard_south")


@query("rename_documents")
def _(s, d):
    at = {name: (table(s, d, name.split(".")[0]), name.split(".")[1]) for name in DOCUMENTS}
    return C.rename_plan(at, "yard_north", "yard_south", DOCUMENTS)


STEPS = "with recursive src as (select distinct md5(catalog_entry) || dataset as k, catalog_entry as t from dataset_catalog where catalog_entry is not null and dataset is not null),\n" + TREE + """,
edges as (select substr(i.k, 33) as output, regexp_extract(i.path, '^history\\[(\\d+)\\]', 1)::int as step, h.j ->> '$.command' as command, i.j ->> '$.name' as input, i.j ->> '$.hash' as input_hash
  from flat i left join flat h on h.k = i.k and h.schema = 'history' and h.kind = 'element' and h.path = regexp_extract(i.path, '^history\\[\\d+\\]') where i.schema = 'history.inputs' and i.kind = 'element')"""


@query("lineage_edges", STEPS + " select * from edges")
def _(s, d):
    return C.lineage(table(s, d, "dataset_catalog"))


@query("lineage_ancestors", STEPS + ", e as (select distinct output, input from edges where input is not null and input <> output), r as (select output, input as ancestor, 1 as depth from e union select r.output, e.input, depth + 1 from r join e on e.output = r.ancestor where e.input <> r.output and depth < (select count(*) from (select output from e union select input from e))) select output, ancestor, min(depth)::int as depth from r group by 1, 2")
def _(s, d):
    return C.ancestors(C.lineage(table(s, d, "dataset_catalog")))


# A source is scanned unless its row is up to date: its signature is in the catalog and it was not modified since.
@query("scan_delta", "select dataset, source_signature from dataset_catalog c where not exists (select 1 from dataset_catalog f where f.dataset = c.dataset and f.source_signature = c.source_signature and not f.modified)")
def _(s, d):
    c = table(s, d, "dataset_catalog")
    return C.scan_delta(c.select("dataset", "source_signature"), c.where("not modified"))


@query("unknown_labels", "select label, count(*) as n from cvat_boxes where label is not null and label not in (select name from classes where name is not null) group by 1")
def _(s, d):
    known = table(s, d, "classes").select(F.col("name").alias("label")).distinct()
    return table(s, d, "cvat_boxes").where("label is not null").groupBy("label").agg(F.count(F.lit(1)).alias("n")).join(known, "label", "left_anti")


@query("catalog_elements", "select dataset, images, labels, images is distinct from labels as mismatch, len(map_keys(classes))::int as n_classes from dataset_catalog")
def _(s, d):
    return table(s, d, "dataset_catalog").select("dataset", "images", "labels", (~F.col("images").eqNullSafe(F.col("labels"))).alias("mismatch"), F.size(F.map_keys("classes")).alias("n_classes"))
