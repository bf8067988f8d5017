"""Queries of run analytics, and of scalar functions over the run and export tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from framewright.functions import scalars as S
from framewright.operators import artifacts, dewey, drift
from framewright.operators import runs as R
from framewright.plans import registry
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


PERF = "with perf as (select event_type as run, event_id as seq, value as ms from events where value is not null) "


def perf(s, d):
    return table(s, d, "events").where("value is not null").select(F.col("event_type").alias("run"), F.col("event_id").alias("seq"), F.col("value").alias("ms"))


STATS = "count(ms) as n, round(avg(ms), 6) as mean, round(min(ms), 6) as min, round(max(ms), 6) as max, round(stddev_pop(ms), 6) as std, " + ", ".join(f"round(quantile_cont(ms, {q}), 6) as p{p}" for q, p in ((0.5, 50), (0.9, 90), (0.95, 95), (0.99, 99)))


@query("latency_stats", PERF + f"select run, {STATS} from perf group by 1")
def _(s, d):
    return R.latency_stats(perf(s, d), ["run"])


@query("latency_steady", PERF + f"select run, {STATS} from (select * from perf qualify row_number() over (partition by run order by seq) > 5) group by 1")
def _(s, d):
    return R.latency_stats(R.steady(perf(s, d), "run", "seq"), ["run"])


@query("throughput", PERF + "select p.run, n as n_steady, round(n / t, 6) as throughput, round(case when m > 0 then 1000 / m end, 6) as fps from (select run, count(*) as n, avg(ms) as m from (select * from perf qualify row_number() over (partition by run order by seq) > 5) group by 1) p join (select run, sum(ms) / 1000 as t from perf group by 1) q on p.run = q.run")
def _(s, d):
    return R.throughput(perf(s, d), "run", "seq")


CURVE = "with curve as (select l_suppkey as run, year(l_shipdate) * 12 + month(l_shipdate) as epoch, round(avg(l_discount), 9) as value from lineitem group by 1, 2) "


def curve(s, d):
    li = table(s, d, "lineitem")
    return li.groupBy(F.col("l_suppkey").alias("run"), (F.year("l_shipdate") * 12 + F.month("l_shipdate")).alias("epoch")).agg(F.round(F.avg("l_discount"), 9).alias("value"))


@query("run_summary_best_last", CURVE + "select run, max(epoch)::int as last_epoch, round(arg_max(value, epoch), 6) as last_value, min(epoch) filter (value = b)::int as best_epoch, round(max(value), 6) as best_value from (select *, max(value) over (partition by run) as b from curve) group by 1")
def _(s, d):
    return R.best_and_last(curve(s, d))


WIDE = "with wide as (select s_suppkey as run, round(avg(l_discount) * 10, 9) as quality, round(avg(l_quantity) / 50, 9) as speed, case when s_suppkey % 3 = 0 then null else round((any_value(s_acctbal) + 1000) / 11000, 9) end as stability from supplier join lineitem on l_suppkey = s_suppkey group by s_suppkey) "


def wide(s, d):
    x = table(s, d, "supplier").join(table(s, d, "lineitem"), F.col("l_suppkey") == F.col("s_suppkey")).groupBy(F.col("s_suppkey").alias("run"), "s_acctbal").agg(F.round(F.avg("l_discount") * 10, 9).alias("quality"), F.round(F.avg("l_quantity") / 50, 9).alias("speed"))
    return x.select("run", "quality", "speed", F.when(F.col("run") % 3 != 0, F.round((F.col("s_acctbal") + 1000) / 11000, 9)).alias("stability"))


LONG = "metrics as (unpivot wide on quality, speed, stability into name metric value value) "


def metrics(s, d):
    return wide(s, d).unpivot("run", ["quality", "speed", "stability"], "metric", "value").where("value is not null")


@query("leaderboard", WIDE + "select run, quality, speed, stability, round((0.6 * quality + 0.25 * speed + coalesce(0.15 * stability, 0)) / (0.85 + case when stability is null then 0 else 0.15 end), 6) as score from wide")
def _(s, d):
    return R.leaderboard(wide(s, d), "quality", "speed", "stability")


@query("compare_delta", WIDE.rstrip() + ", " + LONG + "select m.run, m.metric, round(m.value - b.value, 6) as delta from metrics m join metrics b on b.run = 1 and b.metric = m.metric where m.run <> 1")
def _(s, d):
    return R.deltas(metrics(s, d), 1).select("run", "metric", F.round("delta", 6).alias("delta"))


@query("compare_top3", WIDE.rstrip() + ", " + LONG + ", x as (select m.run, m.metric, m.value - b.value as delta from metrics m join metrics b on b.run = 1 and b.metric = m.metric where m.run <> 1) select run, 'gain' as side, row_number() over (partition by run order by delta desc, metric)::int as rank, metric, round(delta, 6) as delta from x where delta > 0 qualify rank <= 3 union all select run, 'loss', row_number() over (partition by run order by delta, metric)::int, metric, round(delta, 6) from x where delta < 0 qualify row_number() over (partition by run order by delta, metric) <= 3")
def _(s, d):
    return R.top_changes(R.deltas(metrics(s, d), 1))


@query("recompute_plan", WIDE.rstrip() + ", " + LONG + "select run, 'stability' as metric, 'no_metrics' as reason from wide where stability is null union all select run, 'energy', 'no_metrics' from wide")
def _(s, d):
    return R.recompute_plan(metrics(s, d), wide(s, d), ["quality", "stability", "energy"])


AP = "with ap as (select (p_size % 20) as cls, l_returnflag || l_linestatus as model, l_discount * 10 as ap from lineitem join part on l_partkey = p_partkey), m as (select cls, model, avg(ap) as ap from ap group by 1, 2) "


def ap(s, d):
    return table(s, d, "lineitem").join(table(s, d, "part"), F.col("l_partkey") == F.col("p_partkey")).select((F.col("p_size") % 20).alias("cls"), F.concat("l_returnflag", "l_linestatus").alias("model"), (F.col("l_discount") * 10).alias("ap"))


@query("pr_class_summary", AP + "select cls, count(*) as n_models, arg_max(model, (round(ap, 9), model)) as best, round(max(ap), 6) as best_ap, arg_min(model, (round(ap, 9), model)) as worst, round(min(ap), 6) as worst_ap, round(max(ap) - min(ap), 6) as gap from m group by 1")
def _(s, d):
    return R.class_summary(ap(s, d))


@query("largest_degradation", AP + "select model, cls, round(loss, 6) as loss from (select m.model, m.cls, round(top - ap, 9) as loss from m join (select cls, max(ap) as top from m group by 1) t using (cls)) qualify row_number() over (partition by model order by loss desc, cls) = 1")
def _(s, d):
    return R.degradations(ap(s, d))


@query("macro_metric_mean", "select event_type as grp, round(coalesce(max(case when user_id % 50 = 0 then value end), avg(case when user_id % 50 <> 0 then value end)), 6) as value from events group by 1")
def _(s, d):
    e = table(s, d, "events").select(F.col("event_type").alias("grp"), F.when(F.col("user_id") % 50 == 0, "all").otherwise("c").alias("class"), "value")
    return R.macro_mean(e, ["grp"]).withColumn("value", F.round("value", 6))


RUNS = "with r as (select distinct * from runs) "


@query("run_filter", RUNS + "select run_dir, run_name, model, dataset_name, duration_s from r where model = 'polar-l' and testing_ok is not distinct from true")
def _(s, d):
    return table(s, d, "runs").distinct().where((F.col("model") == "polar-l") & F.col("testing_ok").eqNullSafe(True)).select("run_dir", "run_name", "model", "dataset_name", "duration_s")


@query("run_models", RUNS + "select regexp_replace(run_name, '_[0-9]{4,}$', '') as model_name, count(*) as n_runs, count(*) filter (training_ok) as n_trained, round(avg(duration_s), 3) as mean_s, round(quantile_cont(duration_s, 0.5), 3) as p50_s from r group by 1")
def _(s, d):
    r = table(s, d, "runs").distinct()
    return r.groupBy(S.short_model_name(F.col("run_name")).alias("model_name")).agg(F.count(F.lit(1)).alias("n_runs"), F.count_if("training_ok").alias("n_trained"), F.round(F.avg("duration_s"), 3).alias("mean_s"), F.round(F.expr("percentile(duration_s, 0.5)"), 3).alias("p50_s"))


@query("runs_without_files", RUNS + "select run_dir, case when exists (select 1 from metric_files m where m.run_dir = r.run_dir) then 'ok' else 'missing' end as status from (select distinct run_dir from r where run_dir is not null) r")
def _(s, d):
    selected = table(s, d, "runs").where("run_dir is not null").select("run_dir").distinct()
    return R.fill_missing(selected, table(s, d, "metric_files").select("run_dir").distinct(), "run_dir").select("run_dir", "status")


@query("run_metric_rows")
def _(s, d):
    t = drift.consistent_table(table(s, d, "metric_files")).where("number is not null")
    run = F.regexp_extract("raw_path", r"^(runs/[^/]+/[^/]+)/", 1)
    return t.groupBy(run.alias("run_dir"), "namespace", "metric").agg(F.round(F.max_by("number", "written_at"), 6).alias("value"))


@query("run_metric_leaderboard")
def _(s, d):
    t = drift.consistent_table(table(s, d, "metric_files")).where("number is not null")
    run = F.regexp_extract("raw_path", r"^(runs/[^/]+/[^/]+)/", 1)
    w = t.groupBy(run.alias("run")).agg(F.max_by(F.when(F.col("metric") == "map_50_95", F.col("number")), F.when(F.col("metric") == "map_50_95", F.col("written_at"))).alias("quality"), (F.max(F.when(F.col("metric") == "fps", F.col("number"))) / 1000).alias("speed"))
    return R.leaderboard(w.withColumn("stability", F.lit(None).cast("double")), "quality", "speed", "stability").select("run", "score")


ISS = "with i as (select event_id as id, event_type as run, user_id % 7 as fmt, case user_id % 4 when 0 then 'CUDA out of memory' when 1 then 'file not found' when 2 then 'Timeout after 5 s' else 'odd' end as text, value > 90 as failed from events) "


def issues(s, d):
    return table(s, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("run"), (F.col("user_id") % 7).alias("fmt"), F.when(F.col("user_id") % 4 == 0, "CUDA out of memory").when(F.col("user_id") % 4 == 1, "file not found").when(F.col("user_id") % 4 == 2, "Timeout after 5 s").otherwise("odd").alias("text"), (F.col("value") > 90).alias("failed"))


@query("issue_dedup", ISS + "select run, fmt, case when lower(text) like '%out of memory%' then 'oom' when lower(text) like '%not found%' then 'missing_file' when lower(text) like '%timeout%' then 'timeout' else 'other' end as reason, arg_min(id, (not failed, id)) as id, count(*) as n_rows from i group by 1, 2, 3")
def _(s, d):
    i = issues(s, d).select("id", "run", "fmt", S.reason_code(F.col("text")).alias("reason"), "failed")
    return R.issues_once(i, ["run", "fmt", "reason"], "failed").select("run", "fmt", "reason", "id", "n_rows")


@query("numeric_spread", "select * from (select 'l_quantity' as \"column\", round(max(l_quantity) - min(l_quantity), 6) as spread from lineitem union all select 'l_discount', round(max(l_discount) - min(l_discount), 6) from lineitem union all select 'l_tax', round(max(l_tax) - min(l_tax), 6) from lineitem union all select 'l_extendedprice', round(max(l_extendedprice) - min(l_extendedprice), 6) from lineitem) order by spread desc limit 2")
def _(s, d):
    return R.spreads(table(s, d, "lineitem"), ["l_quantity", "l_discount", "l_tax", "l_extendedprice"], 2)


@query("sparse_table", "select round(((select count(*) from runs where run_dir is null) + (select count(*) from runs where duration_s is null) + (select count(*) from runs where training_ok is null)) / (count(*) * 3), 6) as empty_share, ((select count(*) from runs where run_dir is null) + (select count(*) from runs where duration_s is null) + (select count(*) from runs where training_ok is null)) / (count(*) * 3) > 0.7 as hide from runs")
def _(s, d):
    return R.sparse(table(s, d, "runs").select("run_dir", "duration_s", "training_ok"))


@query("detection_filter_nested", "select job_id, count(*)::int as n from cvat_boxes where label in ('hard_hat', 'ladder', 'forklift') and (annotator is null or (xtl / 2000 between 0.2 and 0.8)) group by 1")
def _(s, d):
    b = table(s, d, "cvat_boxes").withColumn("conf", F.when(F.col("annotator").isNotNull(), F.col("xtl") / 2000))
    # One row per job, as a report holds it; the boxes of a job are one report's detections.
    rows = b.groupBy("job_id").agg(F.collect_list(F.struct(F.col("label").alias("class"), "conf", "box_id")).alias("detections"))
    return R.filtered_detections(rows, 0.2, 0.8, ["hard_hat", "ladder", "forklift"]).select("job_id", "n")


@query("export_checks", "select export_id, dataset, case when export_files_per_dir > 0 then ceil(images_exported / export_files_per_dir)::bigint end as expected_parts, parts_count is distinct from case when export_files_per_dir > 0 then ceil(images_exported / export_files_per_dir)::int end as wrong from exports")
def _(s, d):
    e = F.when(F.col("export_files_per_dir") > 0, F.ceil(F.col("images_exported") / F.col("export_files_per_dir")))
    return table(s, d, "exports").select("export_id", "dataset", e.alias("expected_parts"), (~F.col("parts_count").cast("long").eqNullSafe(e)).alias("wrong"))


@query("path_functions", "select file_id, case lower(split) when 'train' then 'train' when 'val' then 'val' when 'test' then 'test' end as split, '#' || substr(md5(label_path), 1, 6) as color from label_files")
def _(s, d):
    return table(s, d, "label_files").select("file_id", S.split_from_path(F.col("label_path")).alias("split"), S.label_color(F.col("label_path")).alias("color"))


@query("name_functions", "select box_id, lower(to_base(box_id, 36)) as b36, left(regexp_replace(regexp_replace(label, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._]+|[._]+$', '', 'g'), 180) as stem from cvat_boxes where label is not null")
def _(s, d):
    return table(s, d, "cvat_boxes").where("label is not null").select("box_id", S.base36(F.col("box_id")).alias("b36"), S.sanitized_stem(F.col("label")).alias("stem"))


MODELS = "with recursive src as (select payload_id as k, max(payload) as t from run_payloads where payload_id is not null and payload is not null group by 1),\n" + TREE


def model_refs(s, d):
    flat = dewey.flatten(table(s, d, "run_payloads"), "payload_id", "payload", kinds=("element",)).where("schema_path = 'models'")
    return flat.select(F.col("record_key").alias("payload_id"), F.col("fields")["model_id"].alias("model_id"), F.lit("detection").alias("task_type"), F.col("fields")["format"].alias("model_format"))


@query("model_backends", MODELS + " select k as payload_id, j ->> '$.model_id' as model_id, case lower(trim(j ->> '$.format')) when 'pt' then 'ultralytics' when 'onnx' then 'onnxruntime' when 'engine' then 'tensorrt' when 'trt' then 'tensorrt' end as backend from flat where schema = 'models' and kind = 'element'")
def _(s, d):
    return artifacts.backends_for(model_refs(s, d), registry.capabilities(s), "test").select("payload_id", "model_id", "backend")


@query("incompatible_models", MODELS + " select k as payload_id, j ->> '$.model_id' as model_id, 'backend_format_incompatible' as error_code from flat where schema = 'models' and kind = 'element' and coalesce(lower(trim(j ->> '$.format')), '') not in ('pt', 'onnx', 'engine', 'trt')")
def _(s, d):
    return artifacts.incompatible_models(model_refs(s, d), registry.capabilities(s)).select("payload_id", "model_id", "error_code")


# What a run must have on file, here for all formats: the metrics of its test and of its last epoch.
NEEDS = ("last_epoch", "test_metrics")


@query("artifact_gaps", "with there as (select distinct run_dir, case namespace when 'train_last_metrics' then 'last_epoch' else namespace end as artifact from metric_files), wanted as (select run_dir, unnest(['last_epoch', 'test_metrics']) as artifact from (select distinct run_dir from runs where run_dir is not null)) select run_dir, 'pt' as model_format, coalesce(string_agg(w.artifact, ',' order by w.artifact) filter (t.run_dir is null), '') as missing, count(*) filter (t.run_dir is null) = 0 as complete from wanted w left join there t using (run_dir, artifact) group by 1")
def _(s, d):
    r = table(s, d, "runs").where("run_dir is not null").select("run_dir", F.lit("pt").alias("model_format")).distinct()
    present = table(s, d, "metric_files").select("run_dir", F.when(F.col("namespace") == "train_last_metrics", "last_epoch").otherwise(F.col("namespace")).alias("artifact"))
    required = s.createDataFrame([("pt", x) for x in NEEDS], "model_format string, artifact string")
    return artifacts.artifact_gaps(r, present, required).withColumn("missing", F.array_join("missing", ","))


@query("class_first_names", "select dataset, cls_id, coalesce(arg_min(name, class_row_id) filter (trim(name) <> ''), cls_id::varchar) as class_name from classes where cls_id >= 0 group by 1, 2")
def _(s, d):
    return artifacts.first_names(table(s, d, "classes").withColumnRenamed("name", "class_name"), ["dataset"], "class_row_id")


@query("display_labels", "select run_dir, run_name, model, coalesce(l.label, nullif(trim(run_name), ''), nullif(regexp_extract(rtrim(nullif(trim(run_dir), ''), '/'), '([^/]+)$', 1), ''), nullif(trim(model), ''), '?') as display_label from (select distinct run_dir, run_name, model from runs) r left join (select rtrim(trim(run_dir), '/') as key, min('run ' || model) as label from runs where trim(run_dir) <> '' group by 1) l on l.key = rtrim(trim(r.run_dir), '/')")
def _(s, d):
    r = table(s, d, "runs")
    labels = r.select(F.regexp_replace(F.trim("run_dir"), r"/+$", "").alias("key"), F.concat(F.lit("run "), "model").alias("label")).where("key <> ''")
    return artifacts.display_labels(r.select("run_dir", "run_name", "model").distinct(), labels)
