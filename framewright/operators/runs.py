"""Run analytics: latency, leaderboards, comparisons, best and last rows, nested reports.

Metrics are long rows (run, metric, value) or curves (run, epoch, value); wide tables appear only at a report's edge. Best and last rows are
max_by aggregates, so no run's curve is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from framewright.functions.scalars import composite_score
from framewright.operators.ordered import numbered, quantiles


def latency_stats(perf: DataFrame, keys: list[str], ms: str = "ms") -> DataFrame:
    """count, mean, p50, p90, p95, p99, min, max and population std."""
    names = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    some = perf.groupBy(*keys).agg(F.count(ms).alias("n"), F.avg(ms).alias("mean"), F.min(ms).alias("min"), F.max(ms).alias("max"), F.stddev_pop(ms).alias("std"))
    both = some.unionByName(quantiles(perf, keys, ms, names).drop("n"), allowMissingColumns=True)
    return both.groupBy(*keys).agg(F.max("n").alias("n"), *[F.round(F.max(c), 6).alias(c) for c in ("mean", "min", "max", "std", *names)])


def steady(perf: DataFrame, run: str, seq: str, warmup: int = 5) -> DataFrame:
    """Samples after each run's first `warmup` by arrival, numbered over many tasks, however long the run."""
    return numbered(perf, [run], [seq]).where(F.col("pos") >= warmup).drop("pos")


def throughput(perf: DataFrame, run: str, seq: str, ms: str = "ms", warmup: int = 5) -> DataFrame:
    """Steady images by the total duration, warm-up included, and fps of the mean."""
    every = perf.groupBy(run).agg((F.sum(ms) / 1000).alias("total_s"))
    some = steady(perf, run, seq, warmup).groupBy(run).agg(F.count(F.lit(1)).alias("n_steady"), F.avg(ms).alias("mean_ms"))
    return every.join(some, run).select(run, "n_steady", F.round(F.col("n_steady") / F.col("total_s"), 6).alias("throughput"), F.round(F.when(F.col("mean_ms") > 0, 1000 / F.col("mean_ms")), 6).alias("fps"))


def best_and_last(curve: DataFrame, run: str = "run", epoch: str = "epoch", value: str = "value") -> DataFrame:
    """Per run: value at the last epoch, best value and the first epoch that has it."""
    best = F.max(F.when(F.col(value).isNotNull(), F.struct(F.col(value).alias("v"), (-F.col(epoch)).alias("e"))))
    return curve.groupBy(run).agg(F.max(epoch).alias("last_epoch"), F.max_by(value, epoch).alias("last_value"), best.alias("_b")).select(run, "last_epoch", F.round("last_value", 6).alias("last_value"), (-F.col("_b.e")).alias("best_epoch"), F.round("_b.v", 6).alias("best_value"))


def leaderboard(wide: DataFrame, quality: str, speed: str, stability: str, weights=(0.6, 0.25, 0.15)) -> DataFrame:
    """Runs with their composite score, best first; runs without any part are left out."""
    s = composite_score(F.col(quality), F.col(speed), F.col(stability), weights)
    return wide.withColumn("score", F.round(s, 6)).where("score is not null").orderBy(F.desc("score"), *[c for c in wide.columns[:1]])


def deltas(metrics: DataFrame, baseline) -> DataFrame:
    """metric, run, value, base, delta against one baseline run: an equi-join on the metric with the baseline's few rows."""
    base = metrics.where(F.col("run") == baseline).groupBy("metric").agg(F.max("value").alias("base"))
    return metrics.where(F.col("run") != baseline).join(base, "metric").withColumn("delta", F.col("value") - F.col("base"))


def top_changes(delta: DataFrame, k: int = 3) -> DataFrame:
    """The k largest gains and losses of each run."""
    up, down = (Window.partitionBy("run").orderBy(o, "metric") for o in (F.desc("delta"), F.asc("delta")))
    gains = delta.where("delta > 0").withColumn("rank", F.row_number().over(up)).where(F.col("rank") <= k).withColumn("side", F.lit("gain"))
    losses = delta.where("delta < 0").withColumn("rank", F.row_number().over(down)).where(F.col("rank") <= k).withColumn("side", F.lit("loss"))
    return gains.unionByName(losses).select("run", "side", "rank", "metric", F.round("delta", 6).alias("delta"))


def class_summary(ap: DataFrame) -> DataFrame:
    """Per class: best and worst model by mean AP, the gap, and each side's value."""
    m = ap.groupBy("cls", "model").agg(F.avg("ap").alias("ap"))
    high, low = F.max(F.struct(F.round("ap", 9).alias("a"), F.col("model").alias("m"))), F.min(F.struct(F.round("ap", 9).alias("a"), F.col("model").alias("m")))
    return m.groupBy("cls").agg(high.alias("h"), low.alias("l"), F.count(F.lit(1)).alias("n_models")).select("cls", "n_models", F.col("h.m").alias("best"), F.round("h.a", 6).alias("best_ap"), F.col("l.m").alias("worst"), F.round("l.a", 6).alias("worst_ap"), F.round(F.col("h.a") - F.col("l.a"), 6).alias("gap"))


def degradations(ap: DataFrame) -> DataFrame:
    """Per model: the class in which it falls farthest behind the best model."""
    m = ap.groupBy("cls", "model").agg(F.avg("ap").alias("ap"))
    x = m.join(m.groupBy("cls").agg(F.max("ap").alias("top")), "cls").withColumn("loss", F.round(F.col("top") - F.col("ap"), 9))
    return x.groupBy("model").agg(F.max(F.struct("loss", (-F.col("cls")).alias("c"))).alias("b")).select("model", (-F.col("b.c")).alias("cls"), F.round("b.loss", 6).alias("loss"))


def macro_mean(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """The `all` row's value where there is one, else the mean over classes (NaN counts as none)."""
    v = F.nanvl("value", F.lit(None).cast("double"))
    return metrics.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.lower("class") == "all", v)), F.avg(F.when(F.lower("class") != "all", v))).alias("value"))


def one_row_per_run(rows: DataFrame, run: str, order: list[str]) -> DataFrame:
    """The preferred row of each run (least order columns)."""
    rest = [c for c in rows.columns if c != run]
    return rows.groupBy(run).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(run, "_r.*")


def fill_missing(selected: DataFrame, rows: DataFrame, run: str) -> DataFrame:
    """Rows of the selected runs, and a row with status missing for each run that has none."""
    have = rows.join(selected.select(run).distinct(), run, "left_semi").withColumn("status", F.lit("ok"))
    lack = selected.select(run).distinct().join(rows, run, "left_anti").withColumn("status", F.lit("missing"))
    return have.unionByName(lack, allowMissingColumns=True)


def with_fallback(runs: DataFrame, direct: DataFrame, by_name: DataFrame, value: str) -> DataFrame:
    """A value by run_dir, else by run_name."""
    a = direct.groupBy("run_dir").agg(F.max(value).alias("_a"))
    b = by_name.groupBy("run_name").agg(F.max(value).alias("_b"))
    return runs.join(a, "run_dir", "left").join(b, "run_name", "left").withColumn(value, F.coalesce("_a", "_b")).drop("_a", "_b")


def recompute_plan(metrics: DataFrame, runs: DataFrame, wanted: list[str]) -> DataFrame:
    """Runs that lack wanted metrics: which, and why (no_metrics or null_value)."""
    need = runs.select("run").distinct().withColumn("metric", F.explode(F.array(*[F.lit(m) for m in wanted])))
    have = metrics.groupBy("run", "metric").agg(F.max("value").alias("v"), F.lit(True).alias("_h"))
    got = need.join(have, ["run", "metric"], "left").where("v is null")
    return got.select("run", "metric", F.when(F.col("_h").isNull(), "no_metrics").otherwise("null_value").alias("reason"))


def issues_once(issues: DataFrame, keys: list[str], failed: str) -> DataFrame:
    """One row per issue key; failed rows win, then the earliest id."""
    rest = [c for c in issues.columns if c not in keys]
    return issues.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct((~F.expr(failed)).alias("a"), F.col(rest[0]))).alias("_r"), F.count(F.lit(1)).alias("n_rows")).select(*keys, "_r.*", "n_rows")


def spreads(wide: DataFrame, columns: list[str], k: int) -> DataFrame:
    """The k numeric columns with the largest spread."""
    stacked = wide.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])).alias("s")).select("s.*")
    return stacked.groupBy("column").agg(F.round(F.max("v") - F.min("v"), 6).alias("spread")).orderBy(F.desc("spread"), "column").limit(k)


def sparse(wide: DataFrame, most: float = 0.7) -> DataFrame:
    """Share of empty cells of a table, and whether it is to be hidden."""
    cells = sum((F.count_if(F.col(c).isNull()) for c in wide.columns), F.lit(0))
    return wide.agg(F.round(cells / F.greatest(F.lit(1), F.count(F.lit(1)) * len(wide.columns)), 6).alias("empty_share")).withColumn("hide", F.col("empty_share") > most)


def without_empty_columns(wide: DataFrame) -> DataFrame:
    """The table without columns that are all null (one aggregate row decides)."""
    n = wide.agg(*[F.count(c).alias(c) for c in wide.columns]).first().asDict()
    return wide.select(*[c for c in wide.columns if n[c]])


def without_repeated_columns(wide: DataFrame) -> DataFrame:
    """The table without columns equal, as text, to an earlier one."""
    pairs = [(a, b) for i, b in enumerate(wide.columns) for a in wide.columns[:i]]
    if not pairs:
        return wide
    same = wide.agg(*[F.coalesce(F.bool_and(F.col(a).cast("string").eqNullSafe(F.col(b).cast("string"))), F.lit(False)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return wide.select(*[c for c in wide.columns if not any(same[f"p{i}"] for i, (_, b) in enumerate(pairs) if b == c)])


def filtered_detections(rows: DataFrame, low: float, high: float, classes: list[str]) -> DataFrame:
    """Nested detections within a confidence range (none passes) and of given classes; rows left empty go; n counts the rest."""
    keep = lambda x: (x["conf"].isNull() | ((x["conf"] >= low) & (x["conf"] <= high))) & x["class"].isin(*classes)
    return rows.withColumn("detections", F.filter("detections", keep)).where(F.size("detections") > 0).withColumn("n", F.size("detections"))
