"""Totals from file footers, upserts that touch few ranges, bases in buckets: results and plans."""

from dataclasses import replace
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from checks import fixtures as fx
from tests.test_streams import MAPPING
from tierspark.operators import ranges
from tierspark.operators.changes import upsert
from tierspark.plans.paging import page_summary
from tierspark.plans.tiers import Tier, tier_counts
from tierspark.session import shared_folder
from tierspark.streaming.keyed_log import append_batch, buckets_of, compact, read_keyed

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("untimed", [False, True])
def test_totals_of_a_lake(spark, untimed):
    """Counts by footers equal counts of rows; only the days at the windows' ends are scanned, in no other column."""
    tiers = fx.tiers_of_a_lake(spark, SF, untimed)
    plain = [replace(t, lake=None) for t in tiers]
    counts = tier_counts(tiers, fx.NOW)
    assert sorted(map(tuple, counts.collect())) == sorted(map(tuple, tier_counts(plain, fx.NOW).collect()))
    assert page_summary(tiers, fx.NOW).collect() == page_summary(plain, fx.NOW).collect()
    plan = plan_of(tier_counts(tiers, fx.NOW))
    assert plan.count("PushedAggregation: [COUNT(*)]") == 3 and "event_id" not in plan
    for hour in (0, 5):
        now = datetime(2024, 1, 31, hour, 30)
        assert sorted(map(tuple, tier_counts(tiers, now).collect())) == sorted(map(tuple, tier_counts(plain, now).collect()))
    whole = [Tier("all", tiers[0].rows, fx.VIEW, day="day", lake=tiers[0].lake)]
    assert tier_counts(whole, fx.NOW).first()["rows"] == tiers[0].rows.count()
    with pytest.raises(ValueError, match="day column"):
        tier_counts([replace(t, day=None) for t in tiers], fx.NOW)


def table_of(spark, rows, n=5, kind="bigint"):
    table = f"{shared_folder(spark, 'table')}/t"
    df = spark.createDataFrame(rows, f"k {kind}, v string, s string")
    ranges.write_ranges(df, table, "k", n)
    return df, table


def files_by_range(spark, table):
    rows = spark.read.parquet(table).select("range", F.col("_metadata.file_path").alias("path")).distinct().collect()
    return {r.range: r.path for r in rows}


@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_upsert_rewrites_only_touched_ranges(spark, kind):
    name = (lambda k: k) if kind == "bigint" else (lambda k: f"k{k:04d}")
    df, table = table_of(spark, [(name(k), "a", "x") for k in range(100)] + [(None, "n", "x")], kind=kind)
    changes = [(name(k), "b", False) for k in (45, 47, 1000)] + [(name(46), None, True), (None, "lost", False)]
    sent = spark.createDataFrame(changes, f"k {kind}, v string, gone boolean")
    before = files_by_range(spark, table)
    assert len(before) == 5
    assert ranges.upsert_touched(spark, table, sent, "k", {"s": F.lit("new")}, deleted="gone") == 2
    after = files_by_range(spark, table)
    assert len({n for n in before if before[n] == after.get(n)}) == 3
    want = upsert(df, sent, "k", {"s": F.lit("new")}, deleted="gone")
    assert sorted(map(str, ranges.read_ranges(spark, table).collect())) == sorted(map(str, want.collect()))
    own = spark.read.parquet(table).where(F.col("range").isin([2]))
    assert "PartitionFilters: [isnotnull(range" in plan_of(own) or "PartitionFilters: [(range" in plan_of(own)
    assert "ReadSchema: struct<k:" in (plan := plan_of(ranges.zone_map(spark, table, "k"))) and "v:string" not in plan


def test_upsert_of_empty_tables_and_ranges_left_empty(spark):
    _, table = table_of(spark, [(k, "a", "x") for k in range(20)], 2)
    gone = spark.createDataFrame([(k, None, True) for k in range(9)] + [(9, None, True)], "k bigint, v string, gone boolean")
    assert ranges.upsert_touched(spark, table, gone, "k", deleted="gone") == 1
    assert sorted(r.k for r in ranges.read_ranges(spark, table).collect()) == list(range(10, 20))
    assert ranges.upsert_touched(spark, table, gone.limit(0), "k", deleted="gone") == 0
    _, lost = table_of(spark, [(None, "a", "x")], 2)
    ranges.upsert_touched(spark, lost, spark.createDataFrame([(7, "b")], "k bigint, v string"), "k")
    assert sorted(map(str, ((r.k, r.v) for r in ranges.read_ranges(spark, lost).collect()))) == ["(7, 'b')", "(None, 'a')"]


def test_upsert_with_more_ranges_than_tasks_can_hold(spark, monkeypatch):
    df, table = table_of(spark, [(k, "a", "x") for k in range(40)], 4)
    monkeypatch.setattr(ranges, "is_small", lambda _: False)
    sent = spark.createDataFrame([(3, "b"), (99, "c")], "k bigint, v string")
    assert ranges.upsert_touched(spark, table, sent, "k") == 4
    assert sorted(map(str, ranges.read_ranges(spark, table).collect())) == sorted(map(str, upsert(df, sent, "k").collect()))


def log_of(spark, path, batch, rows):
    day = datetime(2024, 1, 1)
    data = [(k, v, day, 0, at, 0, gone) for k, v, at, gone in rows]
    kinds = "k int, v string, at timestamp, _time bigint, _major bigint, _minor bigint, _deleted boolean"
    append_batch(spark.createDataFrame(data, kinds), MAPPING, path, "s", batch)


def test_a_base_in_buckets_is_not_moved(spark):
    """The log meets each bucket where it lies, and compaction keeps the layout; the order of changes decides."""
    folder = shared_folder(spark, "keyed")
    log_of(spark, f"{folder}/one", 0, [(k, f"a{k}", 5, k % 7 == 0) for k in range(50)])
    compact(spark, f"{folder}/one", MAPPING, f"{folder}/base", buckets=4)
    assert buckets_of(spark, f"{folder}/base") == 4
    log_of(spark, f"{folder}/two", 0, [(1, "late", 4, False), (2, "new", 6, False), (3, None, 7, True), (7, "back", 8, False), (90, "more", 1, False)])
    want = {k: f"a{k}" for k in range(50) if k % 7} | {2: "new", 7: "back", 90: "more"}
    del want[3]
    found = read_keyed(spark, f"{folder}/two", MAPPING, f"{folder}/base")
    assert {r.k: r.v for r in found.collect()} == want
    plan = plan_of(found)
    assert "Bucketed: true" in plan
    lines = plan.splitlines()
    scan = next(i for i, line in enumerate(lines) if "keyed_base_" in line and "FileScan" in line)
    join = max(i for i in range(scan) if "Join" in lines[i])
    assert not any("Exchange" in line for line in lines[join:scan])
    compact(spark, f"{folder}/two", MAPPING, f"{folder}/base2", f"{folder}/base", buckets=4)
    assert {r.k: r.v for r in read_keyed(spark, f"{folder}/one", MAPPING, f"{folder}/base2").collect()} == want
    spark.sql("DROP TABLE " + next(t.name for t in spark.catalog.listTables() if t.name.startswith("keyed_base_")))
    assert {r.k: r.v for r in read_keyed(spark, f"{folder}/two", MAPPING, f"{folder}/base").collect()} == want
