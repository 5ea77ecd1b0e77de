"""Streams from topics and change feeds into tables."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tierspark.operators.changes import final_changes, latest_per_key
from tierspark.operators.mapping import Mapping, accepted, map_messages, rejected
from tierspark.functions.times import utc_day
from tierspark.streaming.keyed_log import ORDER, append_batch, batch_folder, feed_changes, message_changes
from tierspark.streaming.lake import PLACE, is_landed, without_landed, write_batch, write_positions
from tierspark.streaming.sinks import create_lake_statement

# Applies one batch to a table that can be changed in place, such as those of
# :mod:`tierspark.streaming.sinks`: rows to write (one per key), keys to remove before (or None), batch id.
Sink = Callable[[DataFrame, DataFrame | None, int], None]


def _start(
    stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, drain: bool, interval: str, name: str | None
) -> StreamingQuery:
    """``drain``: take what is there now and stop; otherwise run on, one batch per ``interval``.

    The checkpoint keeps what was read, so a drain that is started again reads only what is new.
    """
    writer = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    if name:
        writer = writer.queryName(name)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=interval)
    return writer.start()


def _stream_id(spark: SparkSession, checkpoint: str) -> Callable[[], str]:
    """The running query's id, read from its checkpoint once a batch needs it.

    The same checkpoint is the same stream; with a new one, batches count from 0 again under a new id.
    """

    @cache
    def read() -> str:
        return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata").first()[0])["id"]

    return read


def _mapped_batches(
    messages: DataFrame, mapping: Mapping, rejects: str | None, stream_id: Callable[[], str], write: Callable[[DataFrame, int], None]
) -> tuple[DataFrame, Callable[[DataFrame, int], None]]:
    """The mapped stream, and what to do with each of its batches.

    Messages are mapped in the stream's own plan, which is built once. A batch of which the rejected
    messages are kept as well is held while both are written, so messages are parsed once.
    """
    mapped = map_messages(messages, mapping)
    if rejects is None:
        return accepted(mapped, mapping), write

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            write(accepted(batch, mapping), batch_id)
            rejected(batch).write.mode("overwrite").parquet(batch_folder(rejects, stream_id(), batch_id))
        finally:
            batch.unpersist()

    return mapped, each


def _dealt(messages: DataFrame) -> DataFrame:
    """Messages over all cores by their positions: a file with one row group is one task, and parsing takes most of the time."""
    places = [c for c in ("topic", "partition", "offset") if c in messages.columns]
    return messages.repartition(messages.sparkSession.sparkContext.defaultParallelism, *places)


def topic_to_lake(
    messages: DataFrame,
    mapping: Mapping,
    lake: str,
    checkpoint: str,
    rejects: str | None = None,
    day_of: str | None = None,
    rebalance: bool = False,
    format: str = "parquet",
    drain: bool = False,
    interval: str = "5 seconds",
    name: str | None = None,
) -> StreamingQuery:
    """Append accepted messages to a lake table; keys are not deduplicated.

    Each batch writes folders of its own and replaces them when it runs again, so nothing is lost or doubled. Messages
    with partition and offset (and topic) carry these into the lake, and the lake notes what it holds: a stream that
    reads a topic again, with a new checkpoint, leaves that out. Topics of one lake must
    differ in the column ``topic``, or in partitions or offsets. With ``format="delta"`` the batch number does the same for a
    Delta table, which is created by the first batch unless it is there, but a new checkpoint adds its rows again.

    ``day_of`` names a time column by whose day the files are partitioned, for readers that ask for a time
    window, and for :mod:`tierspark.streaming.lake`. ``rebalance`` evens out file sizes at the price of a
    shuffle; days with very many rows are split. Messages with positions are dealt out to all cores before they are
    parsed, since a batch may come in one file, and their rows are always rebalanced.
    """

    spark = messages.sparkSession
    stream_id = _stream_id(spark, checkpoint)
    once = format != "delta" and {"partition", "offset"} <= set(messages.columns)
    rebalance = rebalance or once

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select(*mapping.columns, *[c for c in PLACE if c in rows.columns])
        if format != "delta":
            write_batch(rows, lake, stream_id(), batch_id, day_of, rebalance)
            return
        if day_of:
            rows = rows.withColumn("day", utc_day(rows, day_of))
        if batch_id == 0:
            spark.sql(create_lake_statement(lake, rows.schema, ["day"] if day_of else []))
        if rebalance:
            rows = rows.hint("rebalance", *(["day"] if day_of else []))
        out = rows.write.format(format).option("txnAppId", checkpoint).option("txnVersion", batch_id)
        (out.partitionBy("day") if day_of else out).mode("append").save(lake)

    mapped = map_messages(_dealt(messages) if once else messages, mapping)
    mapped = mapped if rejects else mapped.where("reject_reason IS NULL")

    def each(batch: DataFrame, batch_id: int) -> None:
        if once and is_landed(spark, lake, stream_id(), batch_id):
            return
        # Held before it is compared with the lake's notes: what reads from the lake is dropped, and parsed again, at each write to it.
        held = batch.persist() if once or rejects else batch
        try:
            batch = without_landed(held, lake, stream_id()) if once else held
            write(accepted(batch, mapping), batch_id)
            if rejects:
                bad = rejected(batch).hint("rebalance") if once else rejected(batch)
                bad.write.mode("overwrite").parquet(batch_folder(rejects, stream_id(), batch_id))
            if once:
                write_positions(batch, lake, stream_id(), batch_id)
        finally:
            held.unpersist()

    return _start(mapped, each, checkpoint, drain, interval, name)


def topic_to_table(
    messages: DataFrame,
    mapping: Mapping,
    table: str | Sink,
    checkpoint: str,
    rejects: str | None = None,
    drain: bool = False,
    interval: str = "5 seconds",
    name: str | None = None,
) -> StreamingQuery:
    """Upsert accepted messages into a keyed table.

    ``table`` is the folder of a :mod:`tierspark.streaming.keyed_log`, or a function that changes a
    table in place. Batches may run again after a crash; upserts by key do not mind.
    """

    stream_id = _stream_id(messages.sparkSession, checkpoint)

    def write(rows: DataFrame, batch_id: int) -> None:
        if callable(table):
            last = latest_per_key(message_changes(rows), mapping.key, ORDER)
            table(last.select(*mapping.columns), None, batch_id)
        else:
            append_batch(message_changes(rows), mapping, table, stream_id(), batch_id)

    stream, each = _mapped_batches(messages, mapping, rejects, stream_id, write)
    return _start(stream, each, checkpoint, drain, interval, name)


def changes_to_table(
    feed: DataFrame,
    mapping: Mapping,
    table: str | Sink,
    checkpoint: str,
    drain: bool = False,
    interval: str = "5 seconds",
    name: str | None = None,
) -> StreamingQuery:
    """Carry a lake table's inserts, updates and deletes on into a keyed table, as :func:`topic_to_table`.

    Keys that were deleted at any point of a batch are removed before the rest is written, so that a
    row that came back starts over.
    """

    stream_id = _stream_id(feed.sparkSession, checkpoint)

    def each(batch: DataFrame, batch_id: int) -> None:
        if not callable(table):
            append_batch(feed_changes(batch), mapping, table, stream_id(), batch_id)
            return
        final = final_changes(batch, mapping.columns, mapping.key).persist()
        try:
            removed = final.where("_reset").select(mapping.key)
            table(final.where(~F.col("_deleted")).select(*mapping.columns), removed, batch_id)
        finally:
            final.unpersist()

    return _start(feed, each, checkpoint, drain, interval, name)


def drain(start: Callable[[], StreamingQuery], timeout: float | None = None) -> Sequence[dict]:
    """Start a draining query, wait until it stops and return its latest progress reports.

    Spark keeps as many as ``spark.sql.streaming.numRecentProgressUpdates`` says. A query that is not done
    in time is stopped and raises: what it read so far is kept, and the next drain goes on from there.
    """
    query = start()
    if timeout is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout):
        query.stop()
        raise TimeoutError(f"the stream was not drained in {timeout} seconds")
    return query.recentProgress
