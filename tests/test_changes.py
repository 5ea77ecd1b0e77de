import random

import pytest
from pyspark.sql import functions as F

from tierspark.operators.changes import apply_changes, apply_next, change_cursor, delete_by_key, final_changes, latest_per_key, upsert, upsert_batch
from tierspark.sources.change_feed import change_feed_range

FEED = "k int, v string, _change_type string, _commit_version bigint"


def test_last_row_wins_even_for_a_hot_key(spark):
    rows = spark.range(20_000).selectExpr("if(id % 3 = 0, -1, id % 50) k", "id n", "concat('v', id) v", "id % 7 other")
    got = {r.k: r for r in latest_per_key(rows, "k", ["n"]).collect()}
    want = {}
    for n in range(20_000):
        want[-1 if n % 3 == 0 else n % 50] = n
    assert {k: r.n for k, r in got.items()} == want
    assert got[-1].v == f"v{want[-1]}" and got[-1].asDict().keys() == {"k", "n", "v", "other"}


def test_last_row_may_hold_nulls(spark):
    rows = spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "k int, n int, v string")
    assert latest_per_key(rows, "k", ["n"]).collect() == [(1, 2, None)]


def test_upsert(spark):
    target = spark.createDataFrame([(1, "a", 10), (2, "b", 20)], "k int, v string, kept int")
    changes = spark.createDataFrame([("B", 2), ("C", 3), (None, 4)], "v string, k int")
    got = upsert(target, changes, "k", defaults={"kept": F.lit(0)})
    assert sorted(map(tuple, got.collect())) == [(1, "a", 10), (2, "B", 20), (3, "C", 0), (4, None, 0)]
    assert got.schema.simpleString() == target.schema.simpleString()
    assert sorted(r.kept or -1 for r in upsert(target, changes, "k").collect()) == [-1, -1, 10, 20]


def test_upsert_is_idempotent(spark):
    target = spark.createDataFrame([(1, "a", 10)], "k int, v string, kept int")
    changes = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    once = upsert(target, changes, "k")
    assert sorted(map(tuple, upsert(once, changes, "k").collect())) == sorted(map(tuple, once.collect()))


def test_key_only_upsert_leaves_rows_alone(spark):
    target = spark.createDataFrame([(1, "a")], "k int, v string")
    got = upsert(target, spark.createDataFrame([(1,), (2,)], "k int"), "k")
    assert sorted(map(tuple, got.collect())) == [(1, "a"), (2, None)]


def test_upsert_of_an_unknown_column(spark):
    with pytest.raises(ValueError, match="not found in the target"):
        upsert(spark.range(1), spark.range(1).selectExpr("id", "1 x"), "id")


def test_a_large_batch_is_not_broadcast(spark):
    target = spark.range(100).selectExpr("id k", "id v", "id kept")
    changes = spark.range(50, 150).selectExpr("id k", "-id v")
    want = sorted(map(tuple, upsert(target, changes, "k").collect()), key=str)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        for threshold in ("10", limit):
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
            got = upsert_batch(target, changes, "k")
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("Broadcast" in plan) == (threshold == limit)
            assert sorted(map(tuple, got.collect()), key=str) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_delete(spark):
    got = delete_by_key(spark.range(5).selectExpr("id k", "id v"), spark.createDataFrame([(1,), (1,), (9,)], "k int"), "k")
    assert sorted(r.k for r in got.collect()) == [0, 2, 3, 4]


def replay(target, feed):
    """Row by row, as a database would be changed."""
    table = {k: [v, s] for k, v, s in target}
    for k, v, change, _ in sorted(feed, key=lambda r: (r[3], r[2] != "delete")):
        if change == "delete":
            table.pop(k, None)
        elif change in ("insert", "update_postimage"):
            table[k] = [v, table[k][1] if k in table else "new"]
    return sorted((k, v, s) for k, (v, s) in table.items())


@pytest.mark.parametrize("seed", range(4))
def test_change_feed_matches_a_replay(spark, seed):
    r = random.Random(seed)
    feed = []
    for version in range(12):
        for k in r.sample(range(40), 12):
            change = r.choice(["insert", "update", "delete", "replace", "odd"])
            if change == "update":
                feed += [(k, "old", "update_preimage", version), (k, f"u{version}", "update_postimage", version)]
            elif change == "replace":
                feed += [(k, f"r{version}", "insert", version), (k, None, "delete", version)]
            else:
                feed.append((k, None if change == "delete" else f"i{version}", change, version))
    r.shuffle(feed)
    target = [(k, "start", f"s{k}") for k in range(0, 40, 2)]
    df = spark.createDataFrame(feed, FEED).repartition(4)
    start = spark.createDataFrame(target, "k int, v string, s string")
    new = {"s": F.lit("new")}
    whole = apply_changes(start, df, ["k", "v"], "k", defaults=new)
    assert sorted(map(tuple, whole.collect())) == replay(target, feed)
    small = apply_changes(start, df, ["k", "v"], "k", defaults=new, batch=True)
    assert sorted(map(tuple, small.collect())) == replay(target, feed)
    plan = small._jdf.queryExecution().executedPlan().toString()
    # Only the keys that were met may be shuffled, to make them distinct; the target's rows stay where they are.
    shuffled = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert "BroadcastHashJoin" in plan and all("hashpartitioning(_tk" in line for line in shuffled)
    steps = start
    for last, current in ((-1, 3), (3, 3), (3, 8), (8, 11)):
        steps = apply_changes(steps, change_feed_range(df, last, current), ["k", "v"], "k", defaults=new)
    assert sorted(map(tuple, steps.collect())) == replay(target, feed)


def test_one_row_per_key(spark):
    feed = spark.createDataFrame(
        [(1, "a", "insert", 0), (1, None, "delete", 1), (1, "b", "insert", 2), (2, "x", "update_preimage", 0)], FEED
    )
    assert [tuple(r) for r in final_changes(feed, ["k", "v"], "k").collect()] == [(1, "b", False, True)]


def test_range_and_cursor(spark):
    feed = spark.range(10).selectExpr("id _commit_version", "id _applied_version")
    assert sorted(r[0] for r in change_feed_range(feed, 3, 6).collect()) == [4, 5, 6]
    assert change_feed_range(feed, 6, 6).count() == change_feed_range(feed, 6, 5).count() == 0
    assert change_cursor(feed).first()[0] == 9
    assert change_cursor(feed.limit(0)).first()[0] == -1


def test_changes_resume_after_the_versions_in_the_target(spark):
    target = spark.createDataFrame([(1, "a", 3), (2, "b", None)], "k int, v string, _applied_version bigint")
    rows = [(1, "old", "insert", 3), (2, "B", "update_postimage", 4), (3, "c", "insert", 5), (1, None, "delete", 6)]
    once = apply_next(target, spark.createDataFrame(rows, FEED), ["k", "v"], "k")
    want = [(2, "B", 4), (3, "c", 5)]
    assert sorted(map(tuple, once.collect())) == want
    again = apply_next(once, spark.createDataFrame(rows, FEED), ["k", "v"], "k")  # only the delete is beyond version 5
    assert sorted(map(tuple, again.collect())) == want


def test_an_empty_target_takes_the_whole_feed(spark):
    target = spark.createDataFrame([], "k int, v string, _applied_version bigint")
    feed = spark.createDataFrame([(1, "a", "insert", 0), (2, "b", "insert", 1), (2, None, "delete", 2)], FEED)
    assert apply_next(target, feed, ["k", "v"], "k").collect() == [(1, "a", 0)]
