from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tierspark.plans.tiers import Tier, age_window, ordered_tiers, tier_counts, tier_coverage, tiered_read, time_range

NOW = datetime(2024, 1, 31)


@pytest.fixture(scope="module")
def rows(spark):
    """Rows aged 0 to 20 days, one per day at the exact boundary, one in the future and one without a time."""
    data = [(i, NOW - timedelta(days=i)) for i in range(21)] + [(100, NOW + timedelta(days=1)), (200, None)]
    return spark.createDataFrame(data, "id int, ts timestamp_ntz")


def ids(df):
    return sorted(r.id for r in df.collect())


def two(rows, **recent):
    return [
        Tier("recent", rows, ["id"], "ts", **{"max_age": "7d", **recent}),
        Tier("history", rows, ["id"], "ts", min_age="7d"),
    ]


def test_bounds_are_half_open(rows):
    assert ids(time_range(rows, "ts", NOW - timedelta(days=3), NOW - timedelta(days=1))) == [1, 2]
    assert ids(time_range(rows, "ts", after=NOW)) == [100]
    assert ids(time_range(rows, "ts", before=NOW - timedelta(days=19))) == [19, 20]
    assert 200 in ids(time_range(rows, "ts"))


def test_aware_and_naive_now_agree(rows):
    aware = NOW.replace(tzinfo=timezone.utc).astimezone(timezone(timedelta(hours=5)))
    assert ids(age_window(rows, "ts", aware, "1d", "3d")) == ids(age_window(rows, "ts", NOW, "1d", "3d")) == [1, 2]


def test_instants_and_naive_times_agree(rows):
    instants = rows.withColumn("ts", F.col("ts").cast("timestamp"))
    assert ids(age_window(instants, "ts", NOW, "1d", "3d")) == [1, 2]


def test_other_types_are_refused(rows):
    with pytest.raises(ValueError, match="want a timestamp"):
        time_range(rows.withColumn("ts", F.col("ts").cast("string")), "ts", NOW)


def test_each_row_comes_from_one_tier(rows):
    tiers = two(rows)
    assert ids(tiered_read(tiers, NOW)) == list(range(21)) + [100]
    assert {r.tier: r["rows"] for r in tier_counts(tiers, NOW).collect()} == {"recent": 8, "history": 14}


def test_empty_tiers_are_counted(rows):
    tiers = [
        Tier("a", rows, ["id"], "ts", max_age="1s"),
        Tier("b", rows.limit(0), ["id"], "ts", min_age="1s", max_age="2s"),
        Tier("c", rows, ["id"], "ts", min_age="2s"),
    ]
    assert {r.tier: r["rows"] for r in tier_counts(tiers, NOW).collect()} == {"a": 2, "b": 0, "c": 20}


def test_coverage(rows):
    found = {r.tier: tuple(r)[1:] for r in tier_coverage(two(rows), NOW).collect()}
    assert found == {"recent": (8, 14, 1), "history": (14, 8, 1)}


def test_renamed_sources(rows):
    old = rows.select(F.col("id").alias("key"), F.col("ts").alias("at"))
    tiers = [
        Tier("history", old, [("key", "id")], "at", min_age="7d"),
        Tier("recent", rows, ["id"], "ts", max_age="168h"),
    ]
    assert [t.name for t in ordered_tiers(tiers)] == ["recent", "history"]
    assert ids(tiered_read(tiers, NOW)) == list(range(21)) + [100]


def test_day_partitions_do_not_change_the_result(spark, rows, tmp_path):
    rows.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(str(tmp_path / "lake"))
    lake = spark.read.parquet(str(tmp_path / "lake"))
    tiers = [
        Tier("recent", rows, ["id"], "ts", max_age="7d"),
        Tier("history", lake, ["id"], "ts", min_age="7d", day="day"),
    ]
    df = tiered_read(tiers, NOW)
    assert ids(df) == list(range(21)) + [100]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan and "(day#" in plan


def test_single_source_is_read_whole(rows):
    assert 200 in ids(tiered_read([Tier("only", rows, ["id"])], NOW))


@pytest.mark.parametrize(
    ("build", "message"),
    [
        (lambda r: [], "at least one source"),
        (lambda r: [Tier("a", r, ["id"], "ts", max_age="1d")], "no routing"),
        (lambda r: [Tier("a", r, [])], "at least one column"),
        (lambda r: [Tier("a", r, ["id", "id"])], "duplicate"),
        (lambda r: two(r, max_age="6d"), "gap or overlap"),
        (lambda r: two(r, max_age=None), "gap or overlap"),
        (lambda r: two(r, max_age="-7d"), "invalid"),
        (lambda r: two(r, max_age="0s"), "less than"),
        (lambda r: two(r, min_age="1d"), "takes no minimum"),
        (lambda r: two(r, routing="partition"), "unsupported routing"),
        (lambda r: [two(r)[0], two(r)[0]], "named twice"),
        (lambda r: [two(r)[0], Tier("h", r, ["id"], "ts", min_age="7d", max_age="9d")], "takes no maximum"),
        (lambda r: [two(r)[0], Tier("h", r, ["id"], None, min_age="7d")], "time column is required"),
        (lambda r: [two(r)[0], Tier("h", r, ["ts"], "ts", min_age="7d")], "want \\['id'\\]"),
        (lambda r: [two(r)[0], Tier("h", r, [("ts", "id")], "ts", min_age="7d")], "want \\[\\('id', 'int'\\)\\]"),
        (lambda r: [Tier("a", r, ["x"])], "not found"),
    ],
)
def test_checks(rows, build, message):
    with pytest.raises(ValueError, match=message):
        tiered_read(build(rows), NOW)
