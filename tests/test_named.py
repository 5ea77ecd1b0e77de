"""A view by name gives the rows of the tiered read, and its bounds reach the scans."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from tierspark.plans.named import create_view_function, read_view
from tierspark.plans.tiers import Tier, tiered_read

SF = "/root/testdata/sf0.001"


def bag(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", ["timestamp_ntz", "timestamp"])
def test_rows_and_plan(spark, zone, kind):
    tiers = [replace(t, rows=t.rows.withColumn("ts", F.col("ts").cast(kind))) for t in fx.three_tiers(spark, SF)]
    create_view_function(spark, "by name", tiers)
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        for now in (fx.NOW, datetime(2024, 1, 20, 5, 30)):
            assert bag(read_view(spark, "by name", now)) == bag(tiered_read(tiers, now))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    if kind == "timestamp_ntz":
        create_view_function(spark, "by name", fx.three_tiers(spark, SF))
        plan = read_view(spark, "by name", fx.NOW, "id")._jdf.queryExecution().executedPlan().toString()
        for pushed in ("GreaterThan(ts,2024-01-24T00:00)", "LessThanOrEqual(ts,2024-01-24T00:00)", "LessThanOrEqual(ts,2024-01-17T00:00)"):
            assert pushed in plan
        assert "props" not in plan and "Join" not in plan


def test_days_of_a_lake_and_a_single_source(spark):
    tiers = fx.tiers_of_a_lake(spark, SF)
    create_view_function(spark, "lake_view", tiers)
    found = read_view(spark, "lake_view", fx.NOW)
    assert bag(found) == bag(tiered_read(tiers, fx.NOW))
    assert "day#" in found._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    create_view_function(spark, "alone", [Tier("only", spark.range(3), [("id", "n")])])
    assert [r.n for r in spark.sql("SELECT n + 1 AS n FROM alone(now()) WHERE n > 0 ORDER BY n").collect()] == [2, 3]


def test_faulty_views_are_refused(spark):
    with pytest.raises(ValueError, match="named twice"):
        create_view_function(spark, "bad", [fx.two_tiers(spark, SF)[0]] * 2)
