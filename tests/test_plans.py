"""What reaches the scans, and how often data is moved."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from checks.queries import QUERIES
from tierspark.operators.changes import latest_per_key
from tierspark.plans.tiers import time_range

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_bounds_and_columns_reach_the_scan(spark):
    df = time_range(fx.events(spark, SF), "ts", datetime(2024, 1, 10), datetime(2024, 1, 24)).select("event_id")
    text = plan(df)
    assert "PushedFilters: [IsNotNull(ts), GreaterThan(ts,2024-01-10T00:00), LessThanOrEqual(ts,2024-01-24T00:00)]" in text
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz>" in text


def test_bounds_on_instants_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    fx.events(spark, SF).withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(path)
    text = plan(time_range(spark.read.parquet(path), "ts", after=datetime(2024, 1, 10)))
    assert "GreaterThan(ts,2024-01-10 00:00:00.0)" in text


@pytest.mark.parametrize("name", ["tiered_page", "table_page", "lake_page"])
def test_pages_keep_a_head_per_task(spark, name):
    text = plan(QUERIES[name](spark, SF))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text


@pytest.mark.parametrize("name", ["tiered_read", "tiered_read_three", "time_range", "age_window", "retention_prune"])
def test_reads_move_nothing(spark, name):
    assert "Exchange" not in plan(QUERIES[name](spark, SF))


def test_tier_counts_read_only_the_time(spark):
    text = plan(QUERIES["tier_counts"](spark, SF))
    assert text.count("ReadSchema: struct<ts:timestamp_ntz>") == 3


def test_deep_pages_skip_by_time(spark):
    text = plan(QUERIES["tiered_page_deep"](spark, "/root/testdata/sf0.1"))
    assert "GreaterThanOrEqual(ts," in text and "TakeOrderedAndProject" in text


def test_latest_is_reduced_before_the_shuffle(spark):
    text = plan(latest_per_key(fx.events(spark, SF), "user_id", ["ts"]))
    assert "partial_max_by" in text and text.count("Exchange") == 1


@pytest.mark.parametrize("name", ["upsert_merge", "change_apply"])
def test_one_shuffle_per_side(spark, name):
    assert plan(QUERIES[name](spark, SF)).count("Exchange") <= 2


def test_no_query_runs_python_per_row(spark):
    for name in ("map_messages", "coerce_text", "job_status", "lineage_edges"):
        text = plan(QUERIES[name](spark, SF))
        assert "Python" not in text and "Pandas" not in text and "CartesianProduct" not in text
