"""Queries of the general data problems: drifting schemas, broken rows, small files, nested records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import compaction, dewey, drift, quarantine
from framewright.session import cut_lineage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return drift.changes(table(spark, d, "metric_files"))


def p1_table(spark: SparkSession, d: str) -> DataFrame:
    return drift.consistent_table(table(spark, d, "metric_files"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.broken_lines(table(spark, d, "label_lines"), table(spark, d, "classes"))


def p3_valid(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.valid_lines(table(spark, d, "label_lines"), table(spark, d, "classes")).drop("points")


def p3_points(spark: SparkSession, d: str) -> DataFrame:
    valid = quarantine.valid_lines(table(spark, d, "label_lines"), table(spark, d, "classes"))
    return valid.select("line_id", F.posexplode("points").alias("at", "p")).select("line_id", "at", "p.x", "p.y")


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return quarantine.line_report(table(spark, d, "label_lines"), table(spark, d, "classes"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return compaction.superseded_files(table(spark, d, "label_files"))


def p4_consolidated(spark: SparkSession, d: str) -> DataFrame:
    return compaction.consolidated(table(spark, d, "label_files")).select("dataset", "split", "part_no", "n_files", "n_records", "n_bytes", F.md5("content").alias("content_md5"))


def p4_reconcile(spark: SparkSession, d: str) -> DataFrame:
    files = table(spark, d, "label_files")
    return compaction.reconcile(files, cut_lineage(compaction.consolidated(files)))


def p4_parts(spark: SparkSession, d: str) -> DataFrame:
    return compaction.export_parts(table(spark, d, "label_files"), table(spark, d, "exports"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    payloads = dewey.links(table(spark, d, "run_payloads"), "payload_id", "payload")
    return payloads.unionByName(dewey.links(table(spark, d, "dataset_catalog"), "dataset", "catalog_entry"))


def p6_per_class(spark: SparkSession, d: str) -> DataFrame:
    flat = dewey.flatten(table(spark, d, "run_payloads"), "payload_id", "payload")
    return dewey.flat_table(flat, "runs.test_metrics.per_class", {"class": "string", "ap50": "double", "support": "long"})


def p6_tables(spark: SparkSession, d: str) -> DataFrame:
    flat = dewey.flatten(table(spark, d, "run_payloads"), "payload_id", "payload").unionByName(dewey.flatten(table(spark, d, "dataset_catalog"), "dataset", "catalog_entry"))
    return dewey.table_profile(flat)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p1_found, p1_table, p3_found, p3_valid, p3_points, p3_report, p4_found, p4_consolidated, p4_reconcile, p4_parts, p6_found, p6_per_class, p6_tables)}
FILES = r"""(select *, lower(regexp_extract(p, '(?i)(?:^|/)(cam\d+)/', 1)) as cam, lower(trim(regexp_replace(regexp_replace(regexp_extract(p, '([^/]*)$', 1), '(?i)\.txt\s*$', ''), '(?i)(\s*\(\d+\)|[-_ ]+copy\d*)+$', ''))) as stem
  from (select *, replace(replace(url_decode(replace(label_path, '+', '%2B')), chr(92), '/'), '//', '/') as p from label_files))"""
SPLIT = "case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' else split end"
KEPT = rf"""kept as (select arg_max(file_id, (delivered_at, file_id)) as file_id from {FILES} where strlen(content) = n_bytes group by dataset, {SPLIT}, cam, stem),
one as (select distinct f.file_id, f.dataset, {SPLIT} as split, cam, stem, content, '# ' || cam || '/' || stem || chr(10) || case when content = '' or right(content, 1) = chr(10) then content else content || chr(10) end as txt, len(list_filter(string_split_regex(content, '\r\n|\n|\r'), lambda x: trim(x) <> '' and left(ltrim(x), 1) <> '#')) as n from kept join {FILES} f using (file_id)),
placed as (select *, floor((sum(strlen(content) + 1) over (partition by dataset, split order by cam, stem, file_id) - strlen(content) - 1) / 8388608) as part from one)"""
NUM = r"'^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$'"
LINES = rf"""lines as (select line_id, dataset, split, fmt, regexp_replace(raw, '^\s+|\s+$', '', 'g') as t from label_lines where raw is not null),
cells as (select line_id, dataset, split, fmt, fmt = 'csv' and not regexp_full_match(t, '([^",]*|"([^"]|"")*")(,([^",]*|"([^"]|"")*"))*') as bad_quotes, case when fmt = 'csv' then string_split(regexp_replace(t, '"([^"]|"")*"', 'q', 'g'), ',') else string_split_regex(t, '\s+') end as c from lines where t <> '' and t[1] <> '#'),
parts as (select *, case when fmt = 'csv' then c[2:6] else c end as g, case when fmt = 'csv' then len(c) <> 7 else len(c) <> 5 and (len(c) < 7 or len(c) % 2 = 0) end as bad_count from cells),
judged as (select *, case when bad_quotes then 'quoting' when bad_count then 'column_count'
  when not regexp_full_match(trim(g[1]), '[+-]?[0-9]+') or len(list_filter(g[2:], lambda x: not regexp_matches(trim(x), {NUM}) or coalesce(isinf(try_cast(trim(x) as double)), true))) > 0 then 'number'
  when len(list_filter(g[2:], lambda x: try_cast(trim(x) as double) < 0 or try_cast(trim(x) as double) > 1)) > 0 or (len(g) = 5 and (try_cast(trim(g[4]) as double) <= 0 or try_cast(trim(g[5]) as double) <= 0)) then 'range'
  when not exists (select 1 from classes k where k.dataset = parts.dataset and k.cls_id = try_cast(replace(trim(g[1]), '+', '') as bigint)) then 'class_id' end as reason from parts)"""
JSON_LISTS = "('artifacts', 'models', 'runs', 'metrics', 'predictions', 'test_metrics', 'per_class', 'thresholds', 'history', 'inputs', 'regions')"
AS_TEXT = "json_type(c0) = 'VARCHAR' and left(ltrim(c0 ->> '$'), 1) in ('[', '{') and json_valid(c0 ->> '$')"
# All nodes of all records: kind is root, element, object, value (a row each, but for lists) or field (a scalar of the object at above).
SOURCE = "src as (select k, max(t) as t from (select payload_id as k, payload as t from run_payloads union all select dataset, catalog_entry from dataset_catalog) where k is not null and t is not null group by 1)"
TREE = f"""node as (select k, '' as path, '0' as label, '' as above, '' as up, '' as schema, '' as name, 'root' as kind, t::json as j from src where json_valid(t) and json_type(t) <> 'NULL'
 union all
 select k, case when jk is null then path || '[' || i || ']' when path = '' then jk else path || '.' || jk end, label || '.' || i, case when json_type(j) = 'OBJECT' or kind = 'root' then label else above end, case when kind = 'element' then path else up end,
  case when jk is null then schema when schema = '' then jk else schema || '.' || jk end,
  case when jk is not null then case when jk in {JSON_LISTS} then jk else '' end when json_type(c) = 'ARRAY' then '' else name end,
  case when jk is not null then case when json_type(c) in ('OBJECT', 'ARRAY') then 'object' else 'field' end when json_type(c) not in ('OBJECT', 'ARRAY') then 'value' when name <> '' and json_type(c) = 'OBJECT' then 'element' else 'object' end, c
 from (select *, case when jk not in {JSON_LISTS} or jk is null then c0 when {AS_TEXT} then case when json_type((c0 ->> '$')::json) = 'OBJECT' then json_array((c0 ->> '$')::json) else (c0 ->> '$')::json end when json_type(c0) = 'OBJECT' then json_array(c0) else c0 end as c
  from (select k, path, label, above, up, schema, name, kind, j, jk, i, json_extract(j, '/' || replace(replace(jk, '~', '~0'), '/', '~1')) as c0 from (select *, unnest(json_keys(j)) as jk, unnest(range(len(json_keys(j)))) as i from node where json_type(j) = 'OBJECT')
   union all select k, path, label, above, up, schema, name, kind, j, null, i, json_extract(j, '$[' || i || ']') from (select *, unnest(range(json_array_length(j)::bigint)) as i from node where json_type(j) = 'ARRAY')))
 where json_type(c) <> 'NULL'),
held as (select k, above, count(*) as n from node where kind = 'field' group by 1, 2),
flat as (select n.*, case when json_type(j) not in ('OBJECT', 'ARRAY') then 1 else coalesce(h.n, 0) end as n_fields from node n left join held h on h.k = n.k and h.above = n.label and json_type(j) = 'OBJECT' where kind <> 'field' and (json_type(j) <> 'ARRAY' or kind = 'root'))"""
NODES = f"with recursive {SOURCE},\n{TREE}"
CELLS = r"""list_transform(regexp_extract_all(t || ',', '("(?:[^"]|"")*"|[^",]*),', 1), lambda x: case when left(x, 1) = '"' then replace(x[2:-2], '""', '"') else x end)"""
VALID = rf"""{LINES}, valid as (select line_id, l.dataset, l.split, l.rel_label, l.line_no, case when len(g) = 5 then 'bbox' else 'segment' end as kind, try_cast(replace(trim(g[1]), '+', '') as int) as cls_id, list_transform(g[2:], lambda x: trim(x)::double) as n, case when p.fmt = 'csv' then {CELLS}[1] end as stem, case when p.fmt = 'csv' then {CELLS}[7] end as note
  from (select distinct on (line_id) * from judged where reason is null order by line_id) p join (select line_id, any_value(dataset) as dataset, any_value(split) as split, any_value(rel_label) as rel_label, any_value(line_no) as line_no, any_value(regexp_replace(raw, '^\s+|\s+$', '', 'g')) as t from label_lines group by 1) l using (line_id))"""
ORACLES: dict[str, str] = {
    "p6_found": f"{NODES} select distinct k as record_key, up as parent_path, path as child_path from flat where kind = 'element'",
    "p6_tables": f"{NODES} select schema as schema_path, count(*) as n_rows, count(distinct k) as n_records, count(*) filter (up = '') as n_roots, sum(n_fields)::bigint as n_values from flat group by 1",
    "p6_per_class": f"{NODES} select k as record_key, label as dewey, above as parent_dewey, up as parent_path, path as child_path, j ->> '$.class' as class, try_cast(j ->> '$.ap50' as double) as ap50, try_cast(j ->> '$.support' as bigint) as support from flat where schema = 'runs.test_metrics.per_class' and k in (select payload_id from run_payloads)",
    "p3_found": f"with {LINES} select distinct line_id, reason from judged where reason is not null",
    "p3_valid": f"with {VALID} select line_id, dataset, split, rel_label, line_no, kind, cls_id, case when kind = 'bbox' then n[1] end as cx, case when kind = 'bbox' then n[2] end as cy, case when kind = 'bbox' then n[3] end as w, case when kind = 'bbox' then n[4] end as h, stem, note from valid",
    "p3_points": f"with {VALID} select line_id, i::int as \"at\", n[2 * i + 1] as x, n[2 * i + 2] as y from (select line_id, n, unnest(range(len(n) // 2)) as i from valid where kind = 'segment')",
    "p3_report": f"with {LINES}, once as (select line_id, max((dataset, split, coalesce(reason, ''))) as r, any_value(dataset) as dataset, any_value(split) as split, any_value(coalesce(reason, '')) as reason from judged group by 1) select dataset, split, count(*) filter (reason = '') as valid_lines, count(*) filter (reason not in ('', 'class_id')) as broken_label_lines, count(*) filter (reason = 'class_id') as unknown_class_ids from once group by 1, 2",
    "p4_parts": f"with kept as (select arg_max(file_id, (delivered_at, file_id)) as file_id from {FILES} where strlen(content) = n_bytes group by dataset, split, cam, stem), placed as (select k.file_id, f.export_id, f.dataset, f.split, floor((sum(strlen(content) + 1) over (partition by f.dataset, f.split order by cam, stem, f.file_id) - strlen(content) - 1) / 8388608) as part from kept k join {FILES} f using (file_id)), per as (select export_id, count(*) as n, count(distinct (dataset, split, part)) as p from placed group by 1) select e.export_id, e.dataset, parts_count as stated_parts_count, case when export_files_per_dir > 0 then ceil(images_exported / export_files_per_dir)::bigint end as expected_parts_count, coalesce(n, 0) as kept_files, coalesce(p, 0) as new_parts_count from exports e left join per using (export_id)",
    "p4_consolidated": f"with {KEPT} select dataset, split, part::bigint as part_no, count(*) as n_files, sum(n)::bigint as n_records, sum(strlen(txt))::bigint as n_bytes, md5(string_agg(txt, '' order by cam, stem, file_id)) as content_md5 from placed group by 1, 2, 3",
    "p4_reconcile": f"with {KEPT} select dataset, split, count(*) as files_wanted, count(*) as files_written, 0::bigint as files_lost, 0::bigint as files_repeated, sum(n)::bigint as records_wanted, sum(n)::bigint as records_written, count(distinct part) as parts_count, true as whole from placed group by 1, 2",
    "p4_found": f"select distinct file_id from label_files where file_id not in (select arg_max(file_id, (delivered_at, file_id)) from {FILES} where strlen(content) = n_bytes group by dataset, split, cam, stem)",
}
