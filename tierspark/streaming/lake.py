"""A lake in plain files: batches that land once, merging of closed days, removal of old ones.

Layout: ``<lake>/day=<day>/stream=<query id>/batch_id=<n>/`` with the mapped columns and each message's
``_partition`` and ``_offset`` (and ``_topic`` where messages have one); without days the outermost level is missing. Names that
begin with an underscore are not seen by readers:

* ``_positions/stream=<query id>/batch_id=<n>/`` notes the offsets that a batch has taken in, 64 neighbours in the bits of one
  number. It is written last, so a batch that runs again and finds its own is done already, wherever its rows are by
  now; a stream with a new checkpoint leaves out what other streams have noted. Older notes hold runs of offsets instead.
* ``_replacing-<id>/`` holds the new files of days that are merged or pruned. Once it is complete, the files they stand for
  are removed and the new ones moved in; if that is cut short, the next merge or prune finishes it first.
"""

from __future__ import annotations

import uuid
from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierspark.functions.names import quoted
from tierspark.functions.times import in_utc, utc_day
from tierspark.operators.retention import expired, prune
from tierspark.session import is_small, shared_folder, written
from tierspark.sources import folders

LEVELS = ["day", "stream", "batch_id"]
# What tells messages apart. Offsets are noted and looked up by words of 2^6, so that one partition is many keys.
PLACE, WORD_BITS = ("_topic", "_partition", "_offset"), 6
NOTES = "_topic string, _partition int, _word bigint, _bits bigint, _low bigint, _high bigint, stream string, batch_id bigint"
UNTIMED = "__HIVE_DEFAULT_PARTITION__"  # fixed value: the folder of rows without a day


def write_batch(rows: DataFrame, lake: str, stream: str, batch_id: int, day_of: str | None, rebalance: bool = False) -> None:
    """Write one batch into folders of its own, one per day; when it runs again it replaces them."""
    levels = LEVELS if day_of else LEVELS[1:]
    if day_of:
        rows = rows.withColumn("day", utc_day(rows, day_of))
    rows = rows.withColumn("stream", F.lit(stream)).withColumn("batch_id", F.lit(batch_id).cast("bigint"))
    if rebalance:
        rows = rows.hint("rebalance", *(["day"] if day_of else []))
    rows.write.partitionBy(*levels).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(lake)


def _notes_folder(table: str) -> str:
    return f"{table.rstrip('/')}/_positions"


def has_positions(rows: DataFrame) -> bool:
    return "_partition" in rows.columns and "_offset" in rows.columns


def _topic(rows: DataFrame) -> Column:
    return F.col("_topic") if "_topic" in rows.columns else F.lit(None).cast("string")


def write_positions(rows: DataFrame, table: str, stream: str, batch_id: int) -> None:
    """Note the positions of a batch that has been written.

    Each task adds up the bits of its own rows, and the words are added up where the shuffle brings them together. They
    are few next to the rows, and go into as few files as their size asks for.
    """
    placed = rows.where("_partition IS NOT NULL AND _offset IS NOT NULL")
    placed = placed.select(_topic(rows).alias("_topic"), "_partition", F.shiftright("_offset", WORD_BITS).alias("_word"), _bit().alias("_bit"))
    found = placed.groupBy("_topic", "_partition", "_word").agg(F.bit_or("_bit").alias("_bits"))
    found.hint("rebalance").write.mode("overwrite").parquet(f"{_notes_folder(table)}/stream={stream}/batch_id={batch_id}")


def _bit() -> Column:
    """The bit of an offset in its word."""
    return F.expr(f"shiftleft(1L, CAST(_offset & {(1 << WORD_BITS) - 1} AS int))")


def is_landed(spark: SparkSession, table: str, stream: str, batch_id: int) -> bool:
    """Whether a batch was written to its end before."""
    return folders.exists(spark, f"{_notes_folder(table)}/stream={stream}/batch_id={batch_id}/_SUCCESS")


def _words(notes: DataFrame) -> DataFrame:
    """Notes as words; a run of offsets, as older notes have it, is all the words it reaches into."""
    last = (1 << WORD_BITS) - 1
    reached = F.expr(f"sequence(shiftright(_low, {WORD_BITS}), shiftright(_high, {WORD_BITS}))")
    words = notes.withColumn("_word", F.explode(F.when(F.col("_low").isNull(), F.array("_word")).otherwise(reached)))
    from_low = F.expr(f"IF(_word = shiftright(_low, {WORD_BITS}), shiftleft(-1L, CAST(_low & {last} AS int)), -1L)")
    upto_high = F.expr(f"IF(_word = shiftright(_high, {WORD_BITS}), shiftrightunsigned(-1L, CAST({last} - (_high & {last}) AS int)), -1L)")
    return words.withColumn("_bits", F.coalesce("_bits", from_low.bitwiseAND(upto_high)))


def without_landed(rows: DataFrame, table: str, stream: str) -> DataFrame:
    """The rows of messages that no other stream has landed in ``table``."""
    spark, folder = rows.sparkSession, _notes_folder(table)
    others = [name for name in folders.names_in(spark, folder) if name.startswith("stream=") and name != f"stream={stream}"]
    if not others:
        return rows
    words = _words(spark.read.schema(NOTES).parquet(folder).where(F.col("stream") != stream))
    words = words.select(*[F.col(c).alias(f"{c}_") for c in ("_topic", "_partition", "_word", "_bits")])
    words = words if is_small(words) else words.hint("merge")
    same = _topic(rows).eqNullSafe(F.col("_topic_")) & (F.col("_partition") == F.col("_partition_"))
    inside = (F.shiftright("_offset", WORD_BITS) == F.col("_word_")) & (F.col("_bits_").bitwiseAND(_bit()) != 0)
    return rows.join(words, same & inside, "left_anti")


def lake_files(spark: SparkSession, lake: str) -> DataFrame:
    """``(day, path, size)`` of every file with rows; no column of them is read."""
    rows = spark.read.parquet(lake).select("day", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size"))
    return rows.distinct()


def merge_days(spark: SparkSession, lake: str, before: date, target_bytes: int = 128 << 20) -> int:
    """Put the files of closed days, those before ``before``, together into files of about ``target_bytes``.

    Returns how many files were replaced. Days that would not get fewer files are left alone, and so are rows
    without a day. Days from ``before`` on are not touched, so streams may write them meanwhile; a
    batch that comes late for a closed day keeps its own files until the next merge. Readers see a day's
    old files or, for a moment while they are exchanged, a part of them, but no row twice.
    """
    finish(spark, lake)
    files = lake_files(spark, lake).where(F.col("day") < F.lit(before))
    day = Window.partitionBy("day")
    upto = Window.partitionBy("day").orderBy("path").rowsBetween(Window.unboundedPreceding, -1)
    counted = files.withColumn("_n", F.count(F.lit(1)).over(day)).withColumn("_least", F.ceil(F.sum("size").over(day) / target_bytes))
    group = F.floor(F.coalesce(F.sum("size").over(upto), F.lit(0)) / target_bytes)
    plan = written(counted.where("_n > _least").select("day", "path", group.alias("_group")), shared_folder(spark, "merge"))
    found = plan.agg(F.count(F.lit(1)), F.min("day"), F.max("day"), F.count_distinct("day", "_group")).first()
    if found[0]:
        rows = spark.read.parquet(lake).where(F.col("day").between(F.lit(found[1]), F.lit(found[2])))
        rows = rows.withColumn("_path", F.col("_metadata.file_path")).join(plan.select(F.col("path").alias("_path"), "_group"), "_path")
        _replace(rows.drop("_path").repartition(found[3], "day", "_group").drop("_group"), plan, lake)
    return found[0]


def prune_lake(spark: SparkSession, lake: str, ts: str, days: int, now: datetime) -> int:
    """Remove the rows older than ``days`` days from a lake with days of ``ts``; returns how many.

    Whole days go with their folders. Only the day that the limit falls into is read and written anew; files
    of later days, and of rows without a time, stay as they are.
    """
    finish(spark, lake)
    rows = spark.read.parquet(lake)
    old = expired(rows, ts, days, now)  # also checks the arguments
    edge = in_utc(now - timedelta(days=days)).date()
    own = rows.where(F.col("day") == F.lit(edge))
    removed = rows.where(F.col("day") < F.lit(edge)).count()
    on_edge = own.where(old).count()
    if on_edge:
        _replace(prune(own, ts, days, now), own.select("day", F.col("_metadata.file_path").alias("path")), lake)
    if removed:
        for name in folders.names_in(spark, lake):
            day = name.removeprefix("day=")
            if name.startswith("day=") and day != UNTIMED and day < edge.isoformat():
                folders.remove(spark, f"{lake.rstrip('/')}/{name}")
    return removed + on_edge


def _replace(rows: DataFrame, paths: DataFrame, lake: str) -> None:
    """Let ``rows`` stand for the files ``(day, path)``."""
    spark, name = rows.sparkSession, uuid.uuid4().hex
    staged = f"{lake.rstrip('/')}/_replacing-{name}"
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("folder")
    kept = [quoted(c) for c in rows.columns if c not in LEVELS]
    rows = rows.select("day", F.lit(f"merged-{name}").alias("stream"), F.lit(0).alias("batch_id"), *kept)
    rows.write.partitionBy(*LEVELS).parquet(f"{staged}/rows")
    paths.select("day", folder).distinct().coalesce(1).write.partitionBy("day").parquet(f"{staged}/covered")
    folders.make(spark, f"{staged}/complete")
    finish(spark, lake)


def finish(spark: SparkSession, lake: str) -> None:
    """Complete a replacement that was cut short after its files were written; forget one that was cut short before."""
    lake = lake.rstrip("/")
    for name in folders.names_in(spark, lake):
        if not name.startswith("_replacing-"):
            continue
        staged = f"{lake}/{name}"
        if folders.exists(spark, f"{staged}/complete"):
            for covered in folders.names_in(spark, f"{staged}/covered"):  # day by day, so that the others stay whole
                if not covered.startswith("day="):
                    continue
                for row in spark.read.schema("folder string").parquet(f"{staged}/covered/{covered}").toLocalIterator():
                    folders.remove(spark, row.folder)
                for stream in folders.names_in(spark, f"{staged}/rows/{covered}"):
                    folders.move(spark, f"{staged}/rows/{covered}/{stream}", f"{lake}/{covered}/{stream}")
        folders.remove(spark, staged)
