import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.operators.changes import final_changes
from tierspark.operators.mapping import Mapping
from tierspark.operators.status import job_status
from tierspark.session import shared_folder
from tierspark.sources.stores import read_lake
from tierspark.sources.topics import MESSAGE_SCHEMA, read_message_files
from tierspark.streaming.ingest import changes_to_table, drain, topic_to_lake, topic_to_table
from tierspark.streaming.keyed_log import compact, feed_changes, read_base, read_keyed, read_log
from tierspark.streaming.progress import REPORT_SCHEMA, ProgressReports

MAPPING = Mapping("k", [("k", "k", "int"), ("v", "v", "text"), ("at", "at", "timestamp")])


def send(spark, topic, rows):
    """Add one file of ``(payload, partition, offset)`` to the topic."""
    data = [(bytearray(p.encode()), part, offset) for p, part, offset in rows]
    spark.createDataFrame(data, MESSAGE_SCHEMA).coalesce(1).write.mode("append").parquet(topic)
    time.sleep(0.01)


def message(k, v, day=1):
    return f'{{"k":{k},"v":"{v}","at":"2024-01-{day:02d}T00:00:00Z"}}'


def test_lake_keeps_every_accepted_message_once(spark, tmp_path):
    topic, lake, rejects = (str(tmp_path / x) for x in ("topic", "lake", "rejects"))

    def run(checkpoint):
        return drain(
            lambda: topic_to_lake(
                read_message_files(spark, topic, max_files=1), MAPPING, lake, str(tmp_path / checkpoint),
                rejects=rejects, day_of="at", rebalance=True, drain=True,
            )
        )

    send(spark, topic, [(message(1, "a"), 0, 0), (message(1, "b", 2), 0, 1), ("junk", 0, 2)])
    run("c")
    send(spark, topic, [(message(2, "c", 2), 0, 3), ("", 1, 0)])
    run("c")
    want = [(1, "a", 1), (1, "b", 2), (2, "c", 2)]

    def found():
        rows = read_lake(spark, lake)
        assert sorted(str(r.day) for r in rows.select("day").distinct().collect()) == ["2024-01-01", "2024-01-02"]
        return sorted((r.k, r.v, r.at.day) for r in rows.collect())

    assert found() == want
    bad = spark.read.parquet(rejects)
    assert sorted((r._partition, r._offset, bytes(r._value)) for r in bad.collect()) == [(0, 2, b"junk"), (1, 0, b"")]
    run("c")
    assert found() == want
    # Batches that run again, as after a crash, replace what they wrote.
    run("other")
    assert found() == want and spark.read.parquet(rejects).count() == 2


def test_lake_without_rejects(spark, tmp_path):
    topic, lake = str(tmp_path / "topic"), str(tmp_path / "lake")
    send(spark, topic, [("junk", 0, 0), (message(1, "a"), 0, 1)])
    drain(lambda: topic_to_lake(read_message_files(spark, topic), MAPPING, lake, str(tmp_path / "c"), drain=True))
    assert [r.v for r in read_lake(spark, lake).collect()] == ["a"]


def test_table_follows_offsets_not_batches(spark, tmp_path):
    topic, table = str(tmp_path / "topic"), str(tmp_path / "table")
    r = random.Random(5)
    # A third of all messages has the same key.
    sent = [(r.choice([0, r.randrange(30), r.randrange(30)]), i) for i in range(300)]
    late, early = sent[150:], sent[:150]
    want = {k: f"v{i}" for k, i in sent}

    def run():
        drain(
            lambda: topic_to_table(
                read_message_files(spark, topic, max_files=1), MAPPING, table, str(tmp_path / "c"), drain=True
            )
        )
        return {x.k: x.v for x in read_keyed(spark, table, MAPPING).collect()}

    send(spark, topic, [(message(k, f"v{i}"), k % 3, i) for k, i in late])
    assert run() == {k: f"v{i}" for k, i in late}
    send(spark, topic, [(message(k, f"v{i}"), k % 3, i) for k, i in early])
    assert run() == want
    assert run() == want
    log = read_log(spark, table, MAPPING)
    assert log.groupBy("batch_id", "k").count().where("count > 1").isEmpty()


def test_change_feed_into_a_table_and_compaction(spark, tmp_path):
    feed, table = str(tmp_path / "feed"), str(tmp_path / "table")
    schema = T.StructType(
        [*MAPPING.schema.fields, T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType())]
    )
    day = datetime(2024, 1, 1)

    def commit(version, *changes):
        rows = [(k, v, day, change, version) for k, v, change in changes]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(feed)
        drain(
            lambda: changes_to_table(
                spark.readStream.schema(schema).parquet(feed), MAPPING, table, str(tmp_path / "c"), drain=True
            )
        )
        return {r.k: r.v for r in read_keyed(spark, table, MAPPING).collect()}

    assert commit(0, (1, "a", "insert"), (2, "b", "insert"), (3, "c", "insert")) == {1: "a", 2: "b", 3: "c"}
    assert commit(1, (1, "a", "update_preimage"), (1, "A", "update_postimage"), (2, None, "delete")) == {1: "A", 3: "c"}
    base = str(tmp_path / "base")
    compact(spark, table, MAPPING, base)
    held = {r.k: (r.v, r._deleted) for r in read_base(spark, base, MAPPING).collect()}
    assert held == {1: ("A", False), 2: (None, True), 3: ("c", False)}
    # The base stands in for log folders that were removed.
    commit(2, (2, "again", "insert"), (2, None, "delete"), (3, None, "delete"), (4, "d", "insert"), (5, "e", "odd"))
    log = read_log(spark, table, MAPPING)
    latest = str(tmp_path / "later")
    log.where("batch_id = 2").drop("batch_id").write.parquet(f"{latest}/batch_id=2")
    assert {r.k: r.v for r in read_keyed(spark, latest, MAPPING, base).collect()} == {1: "A", 2: "again", 4: "d"}
    plan = read_keyed(spark, latest, MAPPING, base)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 2 and plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    covered = compact(spark, latest, MAPPING, str(tmp_path / "base2"), base)
    assert [folder.rpartition("/")[2] for folder in covered] == ["batch_id=2"]
    live = read_base(spark, str(tmp_path / "base2"), MAPPING).where("NOT _deleted")
    assert {r.k: r.v for r in live.collect()} == {1: "A", 2: "again", 4: "d"}
    with pytest.raises(Exception, match="(?i)exists"):
        compact(spark, latest, MAPPING, base)
    compact(spark, latest, MAPPING, str(tmp_path / "pruned"), base, ("at", 1, datetime(2024, 1, 3)))
    pruned = read_base(spark, str(tmp_path / "pruned"), MAPPING)
    assert {(r.k, r.v, r._deleted) for r in pruned.collect()} == {(k, None, True) for k in (1, 2, 3, 4)}
    # What was pruned does not come back from log folders that stay, nor what was deleted.
    assert read_keyed(spark, table, MAPPING, str(tmp_path / "pruned")).isEmpty()
    compact(spark, latest, MAPPING, str(tmp_path / "forgotten"), base, forget=F.col("_major") < 3)
    assert {r.k for r in spark.read.parquet(str(tmp_path / "forgotten")).collect()} == {1, 2, 4}


def test_a_replay_after_compaction_changes_nothing(spark, tmp_path):
    topic, late = str(tmp_path / "topic"), str(tmp_path / "late")
    first, second, base = (str(tmp_path / x) for x in ("first", "second", "base"))
    start = lambda source, table, c: topic_to_table(read_message_files(spark, source), MAPPING, table, str(tmp_path / c), drain=True)
    send(spark, topic, [(message(1, "new"), 0, 1_000_000)])
    drain(lambda: start(topic, first, "c1"))
    compact(spark, first, MAPPING, base)
    send(spark, late, [(message(1, "old"), 0, 3), (message(2, "b"), 0, 4)])
    drain(lambda: start(late, second, "c2"))
    assert {r.k: r.v for r in read_keyed(spark, second, MAPPING, base).collect()} == {1: "new", 2: "b"}


def test_repeated_keys_of_one_commit_follow_their_position(spark):
    schema = "k int, v string, _change_type string, _commit_version bigint, _position int"
    rows = [(1, "a", "insert", 0, 0), (1, "b", "insert", 0, 1), (2, "x", "delete", 0, 9), (2, "y", "insert", 0, 3)]
    for order in (rows, rows[::-1]):
        feed = spark.createDataFrame(order, schema).coalesce(1)
        assert {r.k: r.v for r in final_changes(feed, ["k", "v"], "k").collect()} == {1: "b", 2: "y"}
        assert {(r.v, r._minor) for r in feed_changes(feed).collect()} == {("a", 1), ("b", 2), ("x", 0), ("y", 4)}


class Store:
    """A table that is changed in place, and what was done to it."""

    def __init__(self):
        self.rows, self.calls = {}, []

    def __call__(self, writes, removed, batch_id):
        gone = [] if removed is None else [r[0] for r in removed.collect()]
        new = {r.k: r.v for r in writes.collect()}
        for k in gone:
            self.rows.pop(k, None)
        self.rows.update(new)
        self.calls.append((sorted(gone), new))


def test_tables_changed_in_place(spark, tmp_path):
    topic, store = str(tmp_path / "topic"), Store()
    send(spark, topic, [(message(1, "a"), 0, 0), (message(1, "b"), 0, 1), ("junk", 0, 2), (message(2, "c"), 1, 0)])
    for _ in range(2):
        drain(
            lambda: topic_to_table(
                read_message_files(spark, topic), MAPPING, store, str(tmp_path / "c"),
                rejects=str(tmp_path / "rejects"), drain=True,
            )
        )
    assert store.calls == [([], {1: "b", 2: "c"})]
    feed = str(tmp_path / "feed")
    schema = T.StructType(
        [*MAPPING.schema.fields, T.StructField("_change_type", T.StringType()), T.StructField("_commit_version", T.LongType())]
    )
    day = datetime(2024, 1, 1)
    changes = [(1, None, "delete", 1), (2, None, "delete", 1), (2, "back", "insert", 2), (3, "new", "insert", 1), (4, "x", "update_preimage", 1)]
    spark.createDataFrame([(k, v, day, c, n) for k, v, c, n in changes], schema).write.parquet(feed)
    drain(
        lambda: changes_to_table(
            spark.readStream.schema(schema).parquet(feed), MAPPING, store, str(tmp_path / "cf"), drain=True
        )
    )
    assert store.calls[-1] == ([1, 2], {2: "back", 3: "new"}) and store.rows == {2: "back", 3: "new"}


def test_progress_reports_feed_the_job_status(spark, tmp_path):
    topic, path = str(tmp_path / "topic"), str(tmp_path / "reports")
    send(spark, topic, [(message(1, "a"), 0, 0)])
    listener = ProgressReports(spark, path, watermark=lambda job: "5")
    spark.streams.addListener(listener)
    try:
        drain(
            lambda: topic_to_table(
                read_message_files(spark, topic), MAPPING, str(tmp_path / "t"), str(tmp_path / "c"), drain=True, name="good"
            )
        )
        broken = (
            read_message_files(spark, topic)
            .select(F.raise_error(F.lit("boom")).alias("x"))
            .writeStream.format("noop")
            .queryName("bad")
            .option("checkpointLocation", str(tmp_path / "cb"))
            .trigger(availableNow=True)
            .start()
        )
        with pytest.raises(Exception):
            broken.awaitTermination()
        jobs = spark.createDataFrame([("good",), ("bad",), ("none",)], "job string")
        for _ in range(60):
            time.sleep(0.5)
            try:
                reports = spark.read.schema(REPORT_SCHEMA).parquet(path)
                now = datetime.now(timezone.utc)
                got = {r.job: r for r in job_status(jobs, reports, now).collect()}
            except Exception:  # noqa: BLE001 - nothing was written yet
                continue
            if got["good"].phase == "running" and got["bad"].phase == "error":
                break
    finally:
        spark.streams.removeListener(listener)
    assert (got["good"].phase, got["good"].watermark, got["good"].lag, got["good"].alive) == ("running", "5", 0, True)
    assert got["bad"].phase == "error" and "boom" in got["bad"].last_error and not got["bad"].alive
    assert got["none"].phase == "Missing"


def test_shared_folder_is_taken_from_the_session(spark):
    root = spark.conf.get("spark.checkpoint.dir")
    assert shared_folder(spark, "x").startswith(root + "/x-")
    assert shared_folder(spark, "x") != shared_folder(spark, "x")
