"""Queries of the language-model data problems."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.llm import canon, leaks, offence, overlap, packing, proportions
from framewright.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.found_pairs(table(spark, d, "images"))


def p2_report(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_report(table(spark, d, "images"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    ref, alias = table(spark, d, "ref_classes"), table(spark, d, "class_alias")
    boxes = canon.meant(table(spark, d, "cvat_boxes"), F.col("box_id"), F.col("label"), "cvat_boxes", ref, alias)
    return boxes.unionByName(canon.meant(table(spark, d, "classes"), F.col("class_row_id"), F.col("name"), "classes", ref, alias))


def p5_class_map(spark: SparkSession, d: str) -> DataFrame:
    return canon.new_class_map(table(spark, d, "classes"), table(spark, d, "ref_classes"), table(spark, d, "class_alias"))


def p5_unmatched(spark: SparkSession, d: str) -> DataFrame:
    boxes = table(spark, d, "cvat_boxes").select(F.lit("cvat_boxes").alias("origin"), "label")
    names = table(spark, d, "classes").select(F.lit("classes").alias("origin"), F.col("name").alias("label"))
    return canon.unmatched(boxes.unionByName(names), table(spark, d, "ref_classes"), table(spark, d, "class_alias"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = proportions.draw(table(spark, d, "annotations"), table(spark, d, "sample_targets"))
    return report.where("short").select("plan_id", "cls_id").distinct()


def p7_sample(spark: SparkSession, d: str) -> DataFrame:
    return proportions.draw(table(spark, d, "annotations"), table(spark, d, "sample_targets"))[0]


def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return proportions.draw(table(spark, d, "annotations"), table(spark, d, "sample_targets"))[1]


def p8_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.packed(table(spark, d, "documents"), table(spark, d, "pack_specs"))


def p8_fill(spark: SparkSession, d: str) -> DataFrame:
    specs = table(spark, d, "pack_specs")
    return packing.fill_report(packing.packed(table(spark, d, "documents"), specs), specs)


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.found_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p9_report(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leak_report(table(spark, d, "documents"), table(spark, d, "eval_items"))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return offence.scored(table(spark, d, "documents"), table(spark, d, "review_labels")).where("offensive").select("doc_id").distinct()


def p10_scores(spark: SparkSession, d: str) -> DataFrame:
    return offence.scored(table(spark, d, "documents"), table(spark, d, "review_labels"))


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    return offence.source_rates(offence.scored(table(spark, d, "documents"), table(spark, d, "review_labels")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (p2_found, p2_report, p5_found, p5_class_map, p5_unmatched, p7_found, p7_sample, p7_report, p8_packed, p8_fill, p9_found, p9_report, p10_found, p10_scores, p10_rates)}
FRAMES = """(select distinct dataset, image_id, lower(content_hash) h, ahash, case when lower(trim(split)) in ('train', 'training') then 't' when lower(trim(split)) in ('val', 'valid', 'validation', 'test', 'testing') then 'e' end side from images where dataset is not null and image_id is not null)"""
LINES = """(select image_id, line_no, arg_max(dataset, loaded_at) dataset, arg_max(case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end, loaded_at) split, arg_max(cls_id, loaded_at) cls_id from annotations group by 1, 2)"""
HEX = "('0x' || substr(md5(concat_ws(':', {})), 1, 15))::bigint"
DRAW = f"""with lines as (select *, {HEX.format("image_id, line_no::varchar, '17'")} as r from {LINES} where dataset is not null and split is not null and cls_id is not null and image_id is not null and line_no is not null),
rk as (select *, row_number() over (partition by dataset, split, cls_id order by r, image_id, line_no) - 1 as pos from lines),
st as (select dataset, split, cls_id, count(*) as available from rk group by all),
tg as (select plan_id, dataset, case when lower(trim(split)) in ('train', 'training') then 'train' when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end as split, cls_id, max(coalesce(target_pct, 0)::bigint * coalesce(sample_size, 0)) as quota, max(coalesce(min_items, 0)::bigint) as low, max(coalesce(sample_size, 0)::bigint) as size from sample_targets where plan_id is not null group by 1, 2, 3, 4),
q1 as (select t.*, greatest(low, (quota + 99) // 100) as need, coalesce(available, 0) as available, least(quota, 100 * coalesce(available, 0)) as n, {HEX.format("plan_id::varchar, '17'")} % 100 as u from tg t left join st using (dataset, split, cls_id)),
q2 as (select *, coalesce(sum(n) over (partition by plan_id order by dataset nulls first, split nulls first, cls_id nulls first rows between unbounded preceding and 1 preceding), 0)::bigint as start from q1),
q3 as (select *, floor((start - u) / 100.0)::bigint + 1 as m0, floor((start + n - u) / 100.0)::bigint - floor((start - u) / 100.0)::bigint as k, least(low, available) as fl from q2),
q4 as (select *, greatest(fl - k, 0) as up, case when available < need then 0 else greatest(k - low, 0) end as room, greatest(least(need, available) - k - greatest(fl - k, 0), 0) as lack from q3),
q5 as (select *, (sum(k) over p + sum(up) over p - max(size) over p) as over_, sum(room) over p as rooms, sum(lack) over p as lacks from q4 window p as (partition by plan_id)),
q6 as (select *, case when over_ > 0 then room else lack end as part, case when over_ > 0 then least(over_, rooms) else least(-over_, lacks) end::hugeint as move, greatest(case when over_ > 0 then rooms else lacks end, 1) as whole from q5),
q7 as (select *, sum(part) over (partition by plan_id order by dataset nulls first, split nulls first, cls_id nulls first) as upto from q6),
q8 as (select *, (k + up + (move * upto // whole - move * (upto - part) // whole) * case when over_ > 0 then -1 else 1 end)::bigint as draw from q7)"""
ORACLES: dict[str, str] = {
    "p2_report": f"""with fr as {FRAMES}, p as (select a.dataset, a.image_id as t, b.image_id as e, coalesce(bool_or(a.h = b.h), false) as exact from fr a join fr b on a.dataset = b.dataset and a.side = 't' and b.side = 'e' and a.image_id <> b.image_id and (a.h = b.h or bit_count(xor(a.ahash, b.ahash)) <= 5) group by 1, 2, 3),
src as (select dataset, image_id as e, max(s) as split, max(source_ref) as source_ref from (select *, case when lower(trim(split)) in ('val', 'valid', 'validation') then 'val' when lower(trim(split)) in ('test', 'testing') then 'test' end as s from images) where s is not null and dataset is not null and image_id is not null group by 1, 2),
per as (select dataset, e, count(*) as n, count(*) filter (exact) as x from p group by 1, 2)
select dataset, split, source_ref, sum(n)::bigint as near_or_same_pairs, sum(x)::bigint as same_pairs, count(*) as eval_frames from per join src using (dataset, e) group by 1, 2, 3""",
    "p7_report": f"{DRAW} select plan_id, dataset, split, cls_id, need, available, draw as drawn, available < need as short from q8",
    "p7_sample": f"""{DRAW}, each as (select *, unnest(range(draw)) as j from q8 where draw > 0), picks as (select *, case when draw = k then (((m0 + j) * 100 + u - start)::hugeint * available - 1) // n else (j * 100 + u)::hugeint * available // (draw * 100) end as pos from each)
select a.plan_id, a.dataset, a.split, a.cls_id, r.image_id, r.line_no from picks a join rk r on r.dataset = a.dataset and r.split = a.split and r.cls_id = a.cls_id and r.pos = a.pos""",
    "p2_found": f"""select distinct least(a.image_id, b.image_id) image_a, greatest(a.image_id, b.image_id) image_b from {FRAMES} a join {FRAMES} b on a.dataset = b.dataset and a.side = 't' and b.side = 'e' and a.image_id <> b.image_id and (a.h = b.h or bit_count(xor(a.ahash, b.ahash)) <= 5)""",
    "p7_found": f"""select distinct plan_id, cls_id from (select t.plan_id, t.cls_id, greatest(t.min_items, ceil(t.target_pct * t.sample_size / 100.0)) need, count(l.image_id) have from sample_targets t left join {LINES} l on l.dataset = t.dataset and l.cls_id = t.cls_id and l.split = t.split group by all) where have < need""",
}
