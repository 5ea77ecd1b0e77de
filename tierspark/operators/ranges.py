"""A keyed table in ranges of its key, of which an upsert rewrites only those it meets.

Layout: ``<table>/range=<n>/`` with parquet files, sorted by key. The zone map, each range's smallest and largest
key, is one aggregate over the key alone; Spark's own from file footers fails where a file holds only NULL keys.
"""

from __future__ import annotations

from collections.abc import Mapping as Named

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierspark.functions.names import quoted
from tierspark.operators.changes import upsert
from tierspark.session import is_small, shared_folder, written
from tierspark.sources import folders

RANGE = "range"


def write_ranges(rows: DataFrame, table: str, key: str, ranges: int) -> None:
    """Write a table with unique keys in so many ranges of about the same number of rows; NULL keys are in the first."""
    dealt = rows.repartitionByRange(ranges, quoted(key)).sortWithinPartitions(quoted(key))
    dealt.withColumn(RANGE, F.spark_partition_id()).write.partitionBy(RANGE).parquet(table)


def read_ranges(spark: SparkSession, table: str) -> DataFrame:
    return spark.read.parquet(table).drop(RANGE)


def zone_map(spark: SparkSession, table: str, key: str) -> DataFrame:
    """``(range, low, high)``: one row per range that holds a key."""
    rows = spark.read.parquet(table).groupBy(RANGE).agg(F.min(quoted(key)).alias("low"), F.max(quoted(key)).alias("high"))
    return rows.where(F.col("low").isNotNull())


def touched_ranges(changes: DataFrame, zones: DataFrame, key: str) -> DataFrame:
    """``changes`` with the range each belongs to: the last one that starts at or below its key, else the first.

    ``zones`` is small: every task gets it.
    """
    by_low = Window.partitionBy(F.lit(0)).orderBy("low")  # one row per range, which the caller has found to be few
    # Each range reaches to the next one's start, the first from below and the last to above all keys.
    upto = zones.select(RANGE, F.when(F.row_number().over(by_low) > 1, F.col("low")).alias("_from"), F.lead("low").over(by_low).alias("_to"))
    inside = (F.col("_from").isNull() | (quoted(key) >= F.col("_from"))) & (F.col("_to").isNull() | (quoted(key) < F.col("_to")))
    return changes.join(F.broadcast(upto), inside).drop("_from", "_to")


def upsert_touched(
    spark: SparkSession,
    table: str,
    changes: DataFrame,
    key: str,
    defaults: Named[str, Column] | None = None,
    deleted: str | None = None,
    reset: str | None = None,
) -> int:
    """:func:`tierspark.operators.changes.upsert` in place; returns how many ranges were rewritten.

    Files of other ranges are neither read nor written. New rows are written to the shared folder before any file
    is replaced, range by range, so they are not lost with the job; readers may miss a range for the moment of
    its exchange. If there are more ranges than can be sent to every task, all are rewritten in one shuffle of both sides.
    """
    changes = written(changes.where(quoted(key).isNotNull()), shared_folder(spark, "changes"))
    zones = written(zone_map(spark, table, key), shared_folder(spark, "zones"))
    target = spark.read.parquet(table)
    if not is_small(zones):
        met = [int(r[RANGE]) for r in target.select(RANGE).distinct().toLocalIterator()]
        whole = written(upsert(target.drop(RANGE), changes, key, defaults, deleted, reset), shared_folder(spark, "ranges"))
        dealt = whole.repartitionByRange(len(met), quoted(key)).sortWithinPartitions(quoted(key))
        merged = dealt.withColumn(RANGE, F.spark_partition_id())
    else:
        placed = written(touched_ranges(changes, zones, key), shared_folder(spark, "changes"))
        met = sorted(r[RANGE] for r in placed.select(RANGE).distinct().collect())  # no more than there are ranges
        if not met:
            return _first_rows(spark, table, target, changes, key, defaults, deleted, reset)
        own = target.where(F.col(RANGE).isin(met))
        merged = written(upsert(own, placed, key, defaults, deleted, reset), shared_folder(spark, "ranges"))
        merged = merged.repartition(len(met), RANGE).sortWithinPartitions(RANGE, quoted(key))
    merged.write.partitionBy(RANGE).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)
    left = {r[RANGE] for r in merged.select(RANGE).distinct().collect()}
    for number in set(met) - left:  # ranges of which no row is left
        folders.remove(spark, f"{table.rstrip('/')}/{RANGE}={number}")
    return len(met)


def _first_rows(
    spark: SparkSession, table: str, target: DataFrame, changes: DataFrame, key: str,
    defaults: Named[str, Column] | None, deleted: str | None, reset: str | None,
) -> int:
    """Without a range that holds a key, changes that are left fill the first range, next to rows without a key."""
    if changes.isEmpty():
        return 0
    merged = upsert(target.drop(RANGE), changes, key, defaults, deleted, reset).withColumn(RANGE, F.lit(0))
    merged = written(merged, shared_folder(spark, "ranges"))
    merged.write.partitionBy(RANGE).option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(table)
    return 1
