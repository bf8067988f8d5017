"""Extension points: named builders, adapters by task and format, and back ends by what they can do.

A registry maps a key of a kind and, where it matters, a task and a format to a function; None stands for any. The most special entry wins,
of equally special ones the first registered. Entries of a user's own are added with the same call as the built-in ones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from framewright.functions import scalars
from framewright.operators import runs
from framewright.operators.artifacts import CAPABILITY
from framewright.sources import documents

Key = tuple[str, str | None, str | None]


class Registry:
    """Functions by (name, task, format)."""

    def __init__(self) -> None:
        self.entries: dict[Key, Callable[..., Any]] = {}

    def register(self, name: str, function: Callable[..., Any], task: str | None = None, fmt: str | None = None) -> None:
        key = tuple(x if x is None else x.strip().lower() for x in (name, task, fmt))
        if key in self.entries:
            raise ValueError(f"{key} is registered already")
        self.entries[key] = function

    def resolve(self, name: str, task: str | None = None, fmt: str | None = None) -> Callable[..., Any]:
        asked = tuple(x if x is None else x.strip().lower() for x in (name, task, fmt))
        fits = [k for k in self.entries if k[0] == asked[0] and all(b is None or a == b for a, b in zip(asked[1:], k[1:], strict=True))]
        if not fits:
            raise LookupError(f"nothing is registered for {asked}")
        return self.entries[max(fits, key=lambda k: (k[1] is not None) + (k[2] is not None))]

    def __iter__(self) -> Iterator[Key]:
        return iter(self.entries)


def default_registry() -> Registry:
    """Readers of runs and models, metric adapters by task, and test statistics by format."""
    r = Registry()
    r.register("read", documents.read_metadata, fmt="json")
    r.register("read", documents.read_metrics_csv, fmt="csv")
    r.register("read", documents.read_predictions, fmt="jsonl")
    for task in scalars.TASK_METRICS:
        r.register("metrics", lambda columns, task=task: scalars.metric_columns(task, columns), task=task)
    r.register("metrics", lambda columns: scalars.metric_columns(scalars.task_of(columns), columns))
    r.register("test", runs.latency_stats)
    return r


def analyses() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every named query of the core as a builder of a DataFrame, for callers that run analyses by name."""
    from framewright.plans import core_problems, q_augment, q_balance, q_catalog, q_evaluation, q_runs, q_sources, q_statistics, q_streams

    modules = (core_problems, q_statistics, q_balance, q_evaluation, q_catalog, q_runs, q_sources, q_streams, q_augment)
    return {name: f for m in modules for name, f in m.QUERIES.items()}


# The tasks, and the back ends in their order, with the formats they take and what they can do.
TASKS = ("detection", "segmentation", "classification")
BACKENDS = (("ultralytics", ("pt",), True, True, True), ("onnxruntime", ("onnx",), False, True, True), ("tensorrt", ("engine", "trt"), False, True, True))


def capabilities(spark: SparkSession) -> DataFrame:
    """One row per back end, task and format: what it can do, and its place in the order."""
    rows = [(name, i, task, fmt, train, test, infer) for i, (name, formats, train, test, infer) in enumerate(BACKENDS) for task in TASKS for fmt in formats]
    return spark.createDataFrame(rows, CAPABILITY)
