"""Scalar functions of the engine as column expressions; the few that shape a schema work on column lists."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metric columns by task, in order of preference.
TASK_METRICS = {"detect": ("mAP50-95", "mAP50", "Box-F1", "Box-P", "Box-R"), "segment": ("Mask-mAP50-95", "Mask-mAP50", "Mask-F1"), "classify": ("top1", "top5"), "pose": ("Pose-mAP50-95", "Pose-mAP50")}
# Other spellings of metric names.
METRIC_ALIASES = {"metrics/mAP50(B)": "mAP50", "metrics/mAP50-95(B)": "mAP50-95", "metrics/precision(B)": "Box-P", "metrics/recall(B)": "Box-R", "metrics/mAP50(M)": "Mask-mAP50", "metrics/mAP50-95(M)": "Mask-mAP50-95", "metrics/accuracy_top1": "top1", "metrics/accuracy_top5": "top5"}
# Words of an error text and the reason they stand for, first match first.
REASONS = (("out of memory", "oom"), ("not found", "missing_file"), ("no such file", "missing_file"), ("timeout", "timeout"), ("timed out", "timeout"), ("unsupported", "unsupported"), ("permission", "permission"), ("zero", "zero_metrics"))


def safe_double(name: str) -> Column:
    return F.expr(f"try_cast(trim(`{name}`) as double)")


def safe_int(name: str) -> Column:
    return F.expr(f"try_cast(trim(`{name}`) as bigint)")


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def base36(n: Column) -> Column:
    return F.lower(F.conv(n.cast("string"), 10, 36))


def sanitized_stem(name: Column, most: int = 180) -> Column:
    """Letters, digits, dot, underscore and hyphen; other runs become one underscore; at most `most` letters."""
    return F.substring(F.regexp_replace(F.regexp_replace(name, r"[^A-Za-z0-9._-]+", "_"), r"^[._]+|[._]+$", ""), 1, most)


def split_from_path(path: Column) -> Column:
    """The split named by the last path segment that is one, in its canonical form."""
    word = F.lower(F.regexp_extract(path, r"(?i)^(?:.*[/\\])?(train|training|val|valid|validation|test|testing)(?=[/\\]|$)", 1))
    return F.when(word.startswith("train"), "train").when(word.startswith("val"), "val").when(word.startswith("test"), "test")


def min_size(text: Column) -> Column:
    """NxM (or N) as struct(w, h); null where it does not parse."""
    w, h = (F.regexp_extract(F.lower(F.trim(text)), r"^(\d+)(?:\s*[x,]\s*(\d+))?$", i) for i in (1, 2))
    return F.when(w != "", F.struct(w.cast("int").alias("w"), F.when(h != "", h).otherwise(w).cast("int").alias("h")))


def weight_list(text: Column) -> Column:
    """`class:mult, class:mult` as a map of doubles; pieces that do not parse are left out."""
    pieces = F.transform(F.split(text, ","), lambda p: F.struct(F.trim(F.substring_index(p, ":", 1)).alias("k"), F.regexp_extract(p, r":\s*([0-9]*\.?[0-9]+)\s*$", 1).alias("v")))
    good = F.filter(pieces, lambda p: (p["k"] != "") & (p["v"] != ""))
    return F.map_from_entries(F.transform(good, lambda p: F.struct(p["k"].alias("key"), p["v"].cast("double").alias("value"))))


def reason_code(text: Column) -> Column:
    return F.coalesce(*[F.when(F.lower(text).contains(word), code) for word, code in REASONS], F.when(text.isNotNull(), "other"))


def label_color(label: Column) -> Column:
    """A fixed colour of a label, #rrggbb from its md5."""
    return F.concat(F.lit("#"), F.substring(F.md5(label), 1, 6))


def relative_path(path: Column, root: str) -> Column:
    """A path under the root as relative POSIX path; others as they are."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(p.startswith(root.rstrip("/") + "/"), F.substring(p, len(root.rstrip("/")) + 2, 1 << 30)).otherwise(p)


def short_model_name(run_name: Column) -> Column:
    """The model part of a run name, without its trailing run number."""
    return F.regexp_replace(run_name, r"_\d{4,}$", "")


def image_size_of(path: Column) -> Column:
    s = F.regexp_extract(path, r"(?i)(?:imgsz|img|sz)[_-]?(\d{2,5})", 1)
    return F.when(s != "", s.cast("int"))


def backoff(attempt: Column, base: float = 30.0, most: float = 600.0) -> Column:
    return F.least(F.lit(most), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def composite_score(quality: Column, speed: Column, stability: Column, weights: tuple[float, float, float] = (0.6, 0.25, 0.15), latency: bool = False) -> Column:
    """Weighted mean of the parts that are there; a latency counts as its inverse."""
    s = F.when(speed > 0, 1 / speed) if latency else speed
    parts = list(zip((quality, s, stability), weights, strict=True))
    zero = F.lit(0.0)
    top = sum((F.when(x.isNotNull(), x * w).otherwise(zero) for x, w in parts), zero)
    below = sum((F.when(x.isNotNull(), F.lit(w)).otherwise(zero) for x, w in parts), zero)
    return F.when(below > 0, top / below)


def friendly_name(at: Column, model: Column, dataset: Column, digest: Column) -> Column:
    return F.concat_ws("_", F.date_format(at, "yyyyMMdd-HHmmss"), model, dataset, F.substring(digest, 1, 8))


def parse_ratio(text: str) -> tuple[float, float, float]:
    """train:val:test ratios (also comma or slash) that sum to 1."""
    parts = tuple(float(x) for x in re.split(r"[:,/]", text.strip()))
    if len(parts) != 3 or min(parts) < 0 or abs(sum(parts) - 1) > 1e-5:
        raise ValueError(f"not three ratios that sum to 1: {text}")
    return parts


def next_name(taken: Iterable[str], wanted: str) -> str:
    taken = set(taken)
    return wanted if wanted not in taken else next(n for i in range(2, len(taken) + 3) if (n := f"{wanted}_{i}") not in taken)


def task_of(columns: Iterable[str]) -> str:
    """detect, segment, classify or pose by the metric columns present."""
    names = {METRIC_ALIASES.get(c.strip(), c.strip()) for c in columns}
    return next((t for t in ("segment", "pose", "classify") if names & set(TASK_METRICS[t])), "detect")


def metric_columns(task: str, available: Iterable[str]) -> list[str]:
    """The task's metric columns that are there; any column named like a metric where none is."""
    have = list(available)
    known = {METRIC_ALIASES.get(c.strip(), c.strip()): c for c in have}
    return [known[m] for m in TASK_METRICS.get(task, ()) if m in known] or [c for c in have if re.search(r"(?i)map|f1|precision|recall|top\d", c)]


def map_column(available: Iterable[str]) -> str | None:
    have = list(available)
    known = {METRIC_ALIASES.get(c.strip(), c.strip()): c for c in have}
    return known.get("mAP50-95") or known.get("mAP50") or next((c for c in have if "map" in c.lower()), None)
