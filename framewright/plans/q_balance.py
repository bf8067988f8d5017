"""Queries of balancing, sampling and splitting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.operators import balance as B
from framewright.plans import views as V
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


CNT = "cnt as (select dataset, cls_id, count(*) as n from ann where split = 'train' and cls_id is not null group by 1, 2)"
WGT = "wgt as (select dataset, cls_id, n, r / avg(r) over (partition by dataset) as weight from (select *, 1 / greatest((1 - pow(0.999, greatest(n, 1))) / (1 - 0.999), 1e-12) as r from cnt))"
U = lambda c, s: f"(('0x' || substr(md5(concat_ws(':', {c}, '{s}')), 1, 8))::bigint / 4294967296.0)"


def counts(s, d):
    return V.annotations(s, d, "cls_id").where("split = 'train' and cls_id is not null").groupBy("dataset", "cls_id").agg(F.count(F.lit(1)).alias("n"))


@query("class_weights", V.with_(V.ANN, CNT, WGT) + "select w.dataset, w.cls_id, w.n, round(w.weight, 6) as effective, round(i.r / avg(i.r) over (partition by w.dataset), 6) as inverse, round(i.q / avg(i.q) over (partition by w.dataset), 6) as sqrt from wgt w join (select dataset, cls_id, 1 / greatest(n, 1) as r, 1 / sqrt(greatest(n, 1)) as q from cnt) i on w.dataset = i.dataset and w.cls_id = i.cls_id")
def _(s, d):
    c = counts(s, d)
    e = B.class_weights(c, "effective").withColumnRenamed("weight", "effective")
    return B.class_weights(B.class_weights(e, "inverse").withColumnRenamed("weight", "inverse"), "sqrt").select("dataset", "cls_id", "n", F.round("effective", 6).alias("effective"), F.round("inverse", 6).alias("inverse"), F.round("weight", 6).alias("sqrt"))


@query("head_damping", V.with_(V.ANN, CNT, "q as (select dataset, count(*) as k, quantile_cont(n, 0.85) as q, quantile_cont(n, 0.5) as m from cnt group by 1)") + "select c.dataset, cls_id, n, round(case when k >= 3 and n > q then greatest(0.35, least(1.0, sqrt(m / n))) else 1.0 end, 6) as multiplier from cnt c join q using (dataset)")
def _(s, d):
    return B.head_damping(counts(s, d)).withColumn("multiplier", F.round("multiplier", 6))


@query("image_weights", V.with_(V.ANN, CNT, WGT) + "select a.dataset, image_id, round(coalesce(greatest(0.2, least(5.0, max(weight))), 1.0), 6) as w_max, round(coalesce(greatest(0.2, least(5.0, avg(weight))), 1.0), 6) as w_mean, round(coalesce(greatest(0.2, least(5.0, sum(weight))), 1.0), 6) as w_sum from ann a left join wgt w on a.dataset = w.dataset and a.cls_id = w.cls_id where split = 'train' group by 1, 2")
def _(s, d):
    w = B.image_weights(V.annotations(s, d, "cls_id").where("split = 'train'"), B.class_weights(counts(s, d), "effective"), 0.2, 5.0)
    return w.select("dataset", "image_id", *[F.round(c, 6).alias(c) for c in ("w_max", "w_mean", "w_sum")])


PER = "per as (select dataset, image_id, cls_id, count(*) as k from ann where split = 'train' and cls_id is not null group by 1, 2, 3), tot as (select dataset, count(distinct image_id) as i, sum(k) as l from per group by 1)"


@query("rfs_repeat", V.with_(V.ANN, PER, "f as (select p.dataset, cls_id, greatest(1.0, pow(0.3 / (count(*) / any_value(i)), 0.5)) as r from per p join tot using (dataset) group by 1, 2)", "x as (select p.dataset, image_id, max(r) as factor from per p join f on p.dataset = f.dataset and p.cls_id = f.cls_id group by 1, 2)") + f"select dataset, image_id, round(factor, 6) as factor, least(4, greatest(1, floor(factor) + ({U('image_id', 0)} < factor - floor(factor))::int))::int as repeats from x")
def _(s, d):
    return B.repeat_factors(V.annotations(s, d, "cls_id"), 0.3, 0.5, 4).withColumn("factor", F.round("factor", 6))


@query("irfs_repeat", V.with_(V.ANN, PER, "f as (select p.dataset, cls_id, greatest(1.0, pow(0.3 / (sum(k) / any_value(l)), 0.5)) as r from per p join tot using (dataset) group by 1, 2)", "x as (select p.dataset, image_id, round(sum(r * k) / sum(k), 6) as factor from per p join f on p.dataset = f.dataset and p.cls_id = f.cls_id group by 1, 2)") + "select * from x")
def _(s, d):
    return B.repeat_factors(V.annotations(s, d, "cls_id"), 0.3, 0.5, 4, instance_aware=True).select("dataset", "image_id", F.round("factor", 6).alias("factor"))


@query("rfs_expanded_size", V.with_(V.ANN, PER, "f as (select p.dataset, cls_id, greatest(1.0, pow(0.3 / (count(*) / any_value(i)), 0.5)) as r from per p join tot using (dataset) group by 1, 2)", "x as (select p.dataset, image_id, max(r) as factor from per p join f on p.dataset = f.dataset and p.cls_id = f.cls_id group by 1, 2)") + f"select dataset, count(*) as n_images, sum(least(4, greatest(1, floor(factor) + ({U('image_id', 0)} < factor - floor(factor))::int)))::bigint as n_rows from x group by 1")
def _(s, d):
    return B.expand(B.repeat_factors(V.annotations(s, d, "cls_id"), 0.3, 0.5, 4)).groupBy("dataset").agg(F.count_distinct("image_id").alias("n_images"), F.count(F.lit(1)).alias("n_rows"))


@query("weighted_sample", V.with_(V.ANN, CNT, WGT, "w as (select image_id, round(avg(weight), 6) as weight from ann a join wgt w on a.dataset = w.dataset and a.cls_id = w.cls_id where split = 'train' group by 1)") + f"select image_id, weight from w order by round(ln(greatest({U('image_id', 7)}, 1e-12)) / greatest(weight, 1e-12), 9) desc, image_id limit 500")
def _(s, d):
    a = V.annotations(s, d, "cls_id").where("split = 'train'").join(B.class_weights(counts(s, d), "effective"), ["dataset", "cls_id"])
    w = a.groupBy("image_id").agg(F.round(F.avg("weight"), 6).alias("weight"))
    return B.sample_without_replacement(w, "weight", 500, "image_id", seed=7)


@query("weighted_draws", V.with_(V.IMG, "x as (select image_id, n_bytes as w, sum(n_bytes) over (order by image_id) - n_bytes as cum, sum(n_bytes) over () as t from img where n_bytes is not null)") + "select image_id, draws from (select image_id, (ceil((cum + w) / t * 1000 - (('0x' || substr(md5('start:3'), 1, 8))::bigint / 4294967296.0)) - ceil(cum / t * 1000 - (('0x' || substr(md5('start:3'), 1, 8))::bigint / 4294967296.0)))::int as draws from x) where draws > 0")
def _(s, d):
    return B.sample_with_replacement(V.frames(s, d, "n_bytes").where("n_bytes is not null").select("image_id", "n_bytes"), "n_bytes", 1000, "image_id", seed=3).select("image_id", "draws")


@query("sampler_probabilities", V.with_(V.ANN, CNT, "t as (select dataset, sum(n) as t from cnt group by 1)", "w as (select a.dataset, image_id, avg(t / n) as w from ann a join cnt c on a.dataset = c.dataset and a.cls_id = c.cls_id join t on a.dataset = t.dataset where split = 'train' group by 1, 2)") + "select dataset, image_id, round(w / sum(w) over (partition by dataset), 8) as p from w")
def _(s, d):
    return B.sampler_probabilities(V.annotations(s, d, "cls_id")).withColumn("p", F.round("p", 8))


@query("head_trim", V.with_(V.ANN, CNT, "med as (select dataset, floor(1.5 * floor(quantile_cont(n, 0.5))) as cap from cnt group by 1)", "over_ as (select c.dataset, cls_id, n, n - cap as excess from cnt c join med using (dataset) where n > cap)", "l as (select a.dataset, a.cls_id, image_id, line_no, excess, ('0x' || substr(md5('s:' || image_id), 1, 15))::bigint % least(32, n) as g from ann a join over_ o on a.dataset = o.dataset and a.cls_id = o.cls_id where split = 'train')", "v as (select *, count(*) over (partition by dataset, cls_id, g) - row_number() over (partition by dataset, cls_id, g order by image_id, line_no) + 1 as level from l)") + "select dataset, cls_id, image_id, line_no from v qualify row_number() over (partition by dataset, cls_id order by level desc, g) <= excess")
def _(s, d):
    return B.head_trim(V.annotations(s, d, "cls_id"), 1.5, "s")


@query("tail_priority", V.with_(V.ANN, CNT, "t as (select dataset, max(n) as top, sum(n) as total from cnt group by 1)") + "select a.dataset, image_id, round(max(pow(top / greatest(1, n), 0.7)), 6) as priority, round(avg(pow(total / n, 0.5)), 6) as soft_weight from ann a join cnt c on a.dataset = c.dataset and a.cls_id = c.cls_id join t on a.dataset = t.dataset where split = 'train' group by 1, 2")
def _(s, d):
    return B.tail_priority(V.annotations(s, d, "cls_id"), 0.7, 0.5).select("dataset", "image_id", F.round("priority", 6).alias("priority"), F.round("soft_weight", 6).alias("soft_weight"))


@query("split_by_ratio", V.with_(V.IMG) + "select dataset, image_id, case when i < floor(n * 0.8) then 'train' when i < floor(n * (0.8 + 0.1)) then 'val' else 'test' end as new_split from (select dataset, image_id, row_number() over (partition by dataset order by md5(image_id || ':0'), image_id) - 1 as i, count(*) over (partition by dataset) as n from img)")
def _(s, d):
    return B.split_by_ratio(V.frames(s, d, "split").select("dataset", "image_id"), ["dataset"], "image_id", 0.8, 0.1)


@query("no_cross_split", V.with_(V.IMG, "b as (select content_hash, min(case split when 'train' then 0 when 'val' then 1 when 'test' then 2 end) as b from img where content_hash is not null group by 1)") + "select image_id, split, case b when 0 then 'train' when 1 then 'val' when 2 then 'test' end as kept_split, case b when 0 then 'train' when 1 then 'val' when 2 then 'test' end is distinct from split as moved from img left join b using (content_hash)")
def _(s, d):
    return B.one_split_per_source(V.frames(s, d, "content_hash"), "content_hash").select("image_id", "split", "kept_split", "moved")


@query("eval_targets", V.with_(V.ANN) + "select *, greatest(0, needed - eval_images) as missing from (select dataset, cls_id, count(distinct image_id) as images, count(distinct image_id) filter (split <> 'train') as eval_images, case when count(distinct image_id) < 3 then 0 else greatest(1, round_even(0.1::double * count(distinct image_id), 0))::bigint end as needed from ann where cls_id is not null and split is not null group by 1, 2)")
def _(s, d):
    return B.eval_targets(V.annotations(s, d, "cls_id"))


@query("eval_cover", V.with_(V.ANN, "t as (select dataset, cls_id, case when count(distinct image_id) < 3 then 0 else greatest(1, round_even(0.1::double * count(distinct image_id), 0))::bigint end - count(distinct image_id) filter (split <> 'train') as missing from ann where cls_id is not null and split is not null group by 1, 2)", "i as (select distinct a.dataset, a.cls_id, image_id, missing from ann a join t on a.dataset = t.dataset and a.cls_id = t.cls_id where split = 'train' and missing > 0)", "r as (select * from i qualify row_number() over (partition by dataset, cls_id order by md5(image_id || ':0'), image_id) <= missing)") + "select dataset, image_id, array_to_string(list_sort(list(distinct cls_id)), ',') as for_classes from r group by 1, 2")
def _(s, d):
    return B.eval_cover(V.annotations(s, d, "cls_id")).withColumn("for_classes", F.array_join(F.transform("for_classes", lambda x: x.cast("string")), ","))


@query("budget_prefix", V.with_(V.IMG) + "select image_id, n_bytes from (select image_id, n_bytes, sum(n_bytes) over (order by n_bytes desc, image_id) as s from img where n_bytes is not null) where s <= 20000000")
def _(s, d):
    f = V.frames(s, d, "n_bytes").where("n_bytes is not null").select("image_id", "n_bytes", (-F.col("n_bytes")).alias("o"))
    return B.budget_prefix(f, ["o", "image_id"], "n_bytes", 20_000_000).select("image_id", "n_bytes")


ADMIT = "with recursive " + V.IMG + ", o as (select image_id, n_bytes, row_number() over (order by n_bytes desc, image_id) as rn from img where n_bytes is not null), walk as (select 0::bigint as rn, 0::hugeint as used, null as image_id, false as taken union all select o.rn, case when used + n_bytes <= 20000000 then used + n_bytes else used end, o.image_id, used + n_bytes <= 20000000 from walk join o on o.rn = walk.rn + 1) "


@query("budget_admission", ADMIT + "select o.image_id, n_bytes from walk join o using (rn) where taken")
def _(s, d):
    f = V.frames(s, d, "n_bytes").where("n_bytes is not null").select("image_id", "n_bytes", (-F.col("n_bytes")).alias("o"))
    return B.budget_admission(f, ["o", "image_id"], "n_bytes", 20_000_000).select("image_id", "n_bytes")


@query("unique_names", V.with_(V.IMG) + "select image_id, case when i = 1 then stem else stem || '__' || i end as unique_name from (select image_id, stem, row_number() over (partition by stem order by image_id) as i from img where stem is not null)")
def _(s, d):
    return B.unique_names(V.frames(s, d, "stem").where("stem is not null").select("image_id", "stem"), [], "stem", ["image_id"]).select("image_id", "unique_name")


@query("export_parts_assignment", V.with_(V.IMG) + "select dataset, part_no, count(*) as n from (select dataset, floor((row_number() over (partition by dataset order by image_id) - 1) / 100)::bigint as part_no from img) group by 1, 2")
def _(s, d):
    return B.parts(V.frames(s, d, "split").select("dataset", "image_id"), ["dataset"], ["image_id"], 100).groupBy("dataset", "part_no").agg(F.count(F.lit(1)).alias("n"))
