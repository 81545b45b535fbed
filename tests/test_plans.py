"""Shape of physical plans over stored tables: pushdown, pruning, row expansion."""

import re

import pytest
from pyspark.sql import functions as F

from tallyrow.catalog import REGISTRY
from tallyrow.operators import history, profile, splits
from tallyrow.plans.features import IntFeature


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def stored(spark, sf_dir, tmp_path):
    path = str(tmp_path / "stored")
    REGISTRY["scan_impressions"].run(spark, sf_dir).write.parquet(path)
    return spark.read.parquet(path)


def test_time_filter_reaches_the_scan(spark, sf_dir, tmp_path):
    df = splits.filter_time(stored(spark, sf_dir, tmp_path), 1_704_900_000, 1_705_000_000).select("event_id")
    plan = plan_of(df)
    assert "GreaterThanOrEqual(timestamp,1704900000)" in plan and "LessThan(timestamp,1705000000)" in plan
    assert "ReadSchema: struct<event_id:bigint,timestamp:bigint>" in plan


@pytest.mark.parametrize("name", ["filter_time_range", "split_fixed_window", "aux_windows"])
def test_registered_splits_push_their_bounds(spark, sf_dir, name):
    scans = [line for line in plan_of(REGISTRY[name].run(spark, sf_dir)).splitlines() if "PushedFilters" in line]
    assert scans and all("GreaterThanOrEqual(ts," in line and "LessThan(ts," in line for line in scans)


def test_one_kind_of_local_rate_expands_no_rows(spark, sf_dir, tmp_path):
    table = stored(spark, sf_dir, tmp_path)
    assert "Expand" not in plan_of(profile.local_cvr(table, kinds=["hour"]))
    assert "Expand" in plan_of(profile.local_cvr(table))


def test_split_reads_one_column_and_pushes_the_cut(spark, sf_dir, tmp_path):
    table = stored(spark, sf_dir, tmp_path)
    cut = splits.row_cutoff(table, 0.1)
    plan = plan_of(table.where(F.col("timestamp") < cut).select("timestamp"))
    assert f"LessThan(timestamp,{cut})" in plan


def test_missing_gap_is_one_aggregate_without_row_expansion(spark, sf_dir, tmp_path):
    table = stored(spark, sf_dir, tmp_path)
    features = [IntFeature("user_int", 1), IntFeature("item_int", 11)]
    plan = plan_of(profile.missing_gap(table, features))
    scan = plan.index("FileScan")
    assert "Generate" not in plan[plan.rindex("HashAggregate", 0, scan) : scan]
    assert "ReadSchema: struct<label_type:int,user_int_feats_1:bigint,item_int_feats_11:bigint>" in plan


def test_lookup_shuffles_no_rows_by_value_alone(spark, sf_dir, tmp_path):
    """Windows run over bins and probes; rows meet them by equi-join on (ids, bin)."""
    table = stored(spark, sf_dir, tmp_path).select("event_id", "timestamp", "label_type", "item_int_feats_11")
    store = history.history_build(table, {11: "item_int_feats_11"})
    plan = plan_of(history.history_lookup(table, store, {11: "item_int_feats_11"}, prior=0.1))
    windows = re.findall(r"Window \[.*", plan)
    assert windows and all("event_id" not in w for w in windows)
