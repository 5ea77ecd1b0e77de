"""A lake by days: batches that land once, merged days, removal of old rows."""

from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.test_streams import MAPPING, message, send
from tierspark.operators.changes import final_changes
from tierspark.sources import folders
from tierspark.sources.stores import read_lake
from tierspark.sources.topics import read_message_files
from tierspark.streaming import lake as lakes
from tierspark.streaming.ingest import drain, topic_to_lake


def land(spark, tmp_path, checkpoint="c", **options):
    drain(
        lambda: topic_to_lake(
            read_message_files(spark, str(tmp_path / "topic"), max_files=1), MAPPING, str(tmp_path / "lake"),
            str(tmp_path / checkpoint), day_of="at", drain=True, **options,
        )
    )
    return str(tmp_path / "lake")


def held(spark, lake):
    return sorted((r.k, r.v, r._partition, r._offset) for r in read_lake(spark, lake).collect())


def files(spark, lake):
    return {(str(r.day), r.path): r.size for r in lakes.lake_files(spark, lake).collect()}


def fill(spark, tmp_path, batches=6):
    for n in range(batches):
        send(spark, str(tmp_path / "topic"), [(message(n * 10 + i, "x", 1 + i % 3), n % 2, n * 10 + i) for i in range(9)])
    return sorted((n * 10 + i, "x", n % 2, n * 10 + i) for n in range(batches) for i in range(9))


def test_merge_of_closed_days(spark, tmp_path):
    """Days before the border get one file each; the open day's files, and what any reader sees, stay."""
    want = fill(spark, tmp_path)
    lake = land(spark, tmp_path)
    before = files(spark, lake)
    assert held(spark, lake) == want and len(before) == 18
    assert lakes.merge_days(spark, lake, date(2024, 1, 3)) == 12
    after = files(spark, lake)
    per_day = {day: [p for d, p in after if d == day] for day, _ in after}
    assert {day: len(p) for day, p in per_day.items()} == {"2024-01-01": 1, "2024-01-02": 1, "2024-01-03": 6}
    assert {x for x in before if x[0] == "2024-01-03"} == {x for x in after if x[0] == "2024-01-03"}
    assert held(spark, lake) == want
    assert lakes.merge_days(spark, lake, date(2024, 1, 3)) == 0 and files(spark, lake) == after
    # A late batch for a closed day has its own file until the next merge. New checkpoints add nothing.
    send(spark, str(tmp_path / "topic"), [(message(900, "late", 1), 0, 900)])
    land(spark, tmp_path)
    land(spark, tmp_path, "other")
    want = sorted([*want, (900, "late", 0, 900)])
    assert held(spark, lake) == want and len(files(spark, lake)) == 9
    assert lakes.merge_days(spark, lake, date(2024, 1, 3)) == 2 and held(spark, lake) == want


def test_merge_into_files_of_a_size(spark, tmp_path):
    want = fill(spark, tmp_path)
    lake = land(spark, tmp_path)
    size = max(files(spark, lake).values())
    lakes.merge_days(spark, lake, date(2024, 2, 1), target_bytes=3 * size)
    assert held(spark, lake) == want and len(files(spark, lake)) < 18


@pytest.mark.parametrize("cut", ["before", "while files are exchanged"])
def test_a_merge_that_was_cut_short(spark, tmp_path, monkeypatch, cut):
    want = fill(spark, tmp_path)
    lake = land(spark, tmp_path)

    def fail(*_):
        raise OSError("gone")

    with monkeypatch.context() as patched:
        patched.setattr(lakes.folders, "make" if cut == "before" else "move", fail)
        with pytest.raises(OSError):
            lakes.merge_days(spark, lake, date(2024, 2, 1))
    seen = held(spark, lake)  # of the day whose files are being exchanged a part may be missing, nothing is there twice
    assert len(seen) == len(set(seen)) and set(seen) <= set(want) and len(seen) >= (len(want) if cut == "before" else 36)
    lakes.finish(spark, lake)
    assert held(spark, lake) == want and not [n for n in folders.names_in(spark, lake) if n.startswith("_repl")]


def test_a_batch_that_runs_again_after_its_day_was_merged(spark, tmp_path):
    want = fill(spark, tmp_path, 2)
    lake = land(spark, tmp_path)
    lakes.merge_days(spark, lake, date(2024, 2, 1))
    for kind in ("commits", "offsets"):  # the checkpoint forgets its last batch's end, as in a crash
        assert folders.names_in(spark, str(tmp_path / "c" / kind))
    folders.remove(spark, str(tmp_path / "c" / "commits" / "1"))
    folders.remove(spark, str(tmp_path / "c" / "commits" / ".1.crc"))
    land(spark, tmp_path)
    assert held(spark, lake) == want


def test_replays_and_rejects(spark, tmp_path):
    topic, rejects = str(tmp_path / "topic"), str(tmp_path / "rejects")
    send(spark, topic, [(message(1, "a"), 0, 70_000), ("junk", 0, 70_001), (message(2, "b"), 0, 5)])
    lake = land(spark, tmp_path, rejects=rejects)
    send(spark, topic, [(message(3, "c"), 1, 70_000), ("junk", 1, 5)])
    land(spark, tmp_path, "second", rejects=rejects)
    land(spark, tmp_path, "third", rejects=rejects)
    assert [r[0] for r in held(spark, lake)] == [1, 2, 3]
    assert spark.read.parquet(rejects).count() == 2


def test_topics_of_one_lake_are_kept_apart(spark):
    rows = spark.createDataFrame([("a", 0, 7), ("b", 0, 7), ("a", 0, 8)], "_topic string, _partition int, _offset bigint")
    folder = lakes.shared_folder(spark, "lake")
    lakes.write_positions(rows.where("_topic = 'a' AND _offset = 7"), folder, "one", 0)
    assert sorted(map(tuple, lakes.without_landed(rows, folder, "two").collect())) == [("a", 0, 8), ("b", 0, 7)]
    assert lakes.without_landed(rows, folder, "one").count() == 3
    assert lakes.is_landed(spark, folder, "one", 0) and not lakes.is_landed(spark, folder, "one", 1)


def test_feed_of_a_lake_has_no_ties(spark):
    """Two writes of a key in one commit: the message's place decides."""
    rows = [(1, "late", 0, 9), (1, "early", 3, 8), (2, "low", 1, 5), (2, "high", 2, 5)]
    feed = spark.createDataFrame(rows, "k int, v string, _partition int, _offset bigint").selectExpr(
        "*", "'insert' AS _change_type", "4L AS _commit_version"
    )
    found = {r.k: r.v for r in final_changes(feed, ["k", "v"], "k").collect()}
    assert found == {1: "late", 2: "high"}


def test_pruned_lake_keeps_other_days_files(spark):
    now, start = datetime(2024, 1, 10, 6), datetime(2024, 1, 1)
    rows = [(i, None if i % 7 == 0 else start + timedelta(hours=5 * i)) for i in range(48)]
    df = spark.createDataFrame(rows, "k int, at timestamp_ntz")
    lake = lakes.shared_folder(spark, "lake")
    lakes.write_batch(df, lake, "given", 0, "at")
    before = files(spark, lake)
    removed = lakes.prune_lake(spark, lake, "at", 3, now)
    limit = now - timedelta(days=3)
    stays = [k for k, at in rows if at is None or at >= limit]
    assert sorted(r.k for r in read_lake(spark, lake).collect()) == stays and removed == len(rows) - len(stays)
    after = files(spark, lake)
    later = {x for x in before if x[0] > limit.date().isoformat()}
    assert later and later <= set(after) and min(d for d, _ in after) == limit.date().isoformat()
    assert lakes.prune_lake(spark, lake, "at", 3, now) == 0 and files(spark, lake) == after
    with pytest.raises(ValueError, match="positive"):
        lakes.prune_lake(spark, lake, "at", 0, now)
    # A reader of one day opens no file of another.
    plan = read_lake(spark, lake).where(F.col("day") == F.lit(date(2024, 1, 9)))
    assert {f.split("/day=")[1][:10] for f in plan.inputFiles()} <= {"2024-01-09"} or "PartitionFilters: [isnotnull(day" in plan._jdf.queryExecution().toString()


def test_positions_are_noted_side_by_side(spark):
    """Offsets without neighbours: no task holds all of a batch, and 64 offsets are one row of the notes."""
    rows = spark.range(0, 400_000, 1, 8).selectExpr("CAST(id % 4 AS int) AS _partition", "id AS _offset")
    kind = "_partition int, _offset bigint"
    rows = rows.union(spark.createDataFrame([(None, 5), (0, None)], kind))
    folder = lakes.shared_folder(spark, "lake")
    tracker, group = spark.sparkContext.statusTracker(), "positions"
    spark.sparkContext.setJobGroup(group, group)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        lakes.write_positions(rows, folder, "one", 0)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(group) for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert stages and min(stage.numTasks for stage in stages if stage) >= 4
    assert spark.read.parquet(f"{folder}/_positions").count() == 4 * (400_000 // 64)
    again = rows.union(spark.createDataFrame([(1, 0), (0, 400_000), (0, -4)], kind))
    left = lakes.without_landed(again, folder, "two").collect()
    assert sorted(map(str, map(tuple, left))) == sorted(map(str, [(None, 5), (0, None), (1, 0), (0, 400_000), (0, -4)]))


def test_notes_of_before_are_still_read(spark):
    """Runs of offsets, the form in which batches were noted before."""
    folder = lakes.shared_folder(spark, "lake")
    runs = [(None, 0, 0, 3, 200), (None, 0, 0, 255, 256), (None, 1, 0, 64, 127), (None, 1, 0, 9, 9)]
    old = spark.createDataFrame(runs, "_topic string, _partition int, _block bigint, _low bigint, _high bigint")
    old.write.parquet(f"{folder}/_positions/stream=one/batch_id=0")
    rows = spark.range(300).selectExpr("explode(array(0, 1)) AS _partition", "id AS _offset")
    lakes.write_positions(rows.where("_partition = 1 AND _offset = 10"), folder, "three", 0)
    landed = {(p, n) for _, p, _, low, high in runs for n in range(low, high + 1)} | {(1, 10)}
    left = {tuple(r) for r in lakes.without_landed(rows, folder, "two").collect()}
    assert left == {(p, n) for p in (0, 1) for n in range(300)} - landed


def test_a_batch_of_one_file_is_parsed_by_all_cores(spark, tmp_path):
    """The rows come back together by day, one file each."""
    want = fill(spark, tmp_path, 1)
    query = topic_to_lake(
        read_message_files(spark, str(tmp_path / "topic"), max_files=1), MAPPING, str(tmp_path / "lake"), str(tmp_path / "c"),
        rejects=str(tmp_path / "rejects"), day_of="at", drain=True,
    )
    query.awaitTermination()
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(str(query.runId)) for s in tracker.getJobInfo(j).stageIds]
    assert max(stage.numTasks for stage in stages if stage) >= spark.sparkContext.defaultParallelism
    assert held(spark, str(tmp_path / "lake")) == want and len(files(spark, str(tmp_path / "lake"))) == 3
