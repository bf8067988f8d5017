"""A choice of queries side by side with their DuckDB SQL on the smallest tables (all of them run in the driver's check)."""

import glob
import math

import duckdb
import pytest

import __spark_entry__

CHOICE = ["class_imbalance", "dataset_profile", "balance_ready", "edge_filter_forecast", "tile_annotations", "rfs_repeat", "head_trim", "split_by_ratio", "eval_cover", "match_two_window", "pr_curve_ap", "optimal_lrp", "confidence_recommendations", "near_duplicate_groups", "catalog_sync", "leaderboard", "latency_steady", "issue_dedup", "queue_status", "p4_found", "p4_consolidated", "p4_reconcile", "p3_valid", "p3_points", "p6_found", "p6_tables", "empirical_bounds", "cvat_to_yolo", "stable_size_baseline", "map_by_threshold", "match_greedy", "nms", "merge_label_union", "diverse_sample", "lineage_ancestors", "rename_plan", "near_duplicate_counts", "read_labels", "cvat_round_trip", "artifact_gaps", "overlay", "paste_positions", "donor_turns"]


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in glob.glob(f"{sf}/*.parquet"):
        c.execute(f"create view {f.split('/')[-1][:-8]} as select * from '{f}'")
    return c


def plain(v):
    return ("nan" if math.isnan(v) else round(v, 5) + 0.0) if isinstance(v, float) else str(v) if isinstance(v, list | dict) else v


@pytest.mark.parametrize("name", CHOICE)
def test_same_rows(spark, sf, duck, name):
    df = __spark_entry__.queries()[name](spark, sf)
    names = sorted(df.columns)
    got = sorted(str(tuple(plain(r[c]) for c in names)) for r in df.collect())
    r = duck.execute(__spark_entry__.oracle_sql()[name])
    at = [x[0] for x in r.description]
    assert sorted(at) == names
    assert got == sorted(str(tuple(plain(x[at.index(c)]) for c in names)) for x in r.fetchall())
