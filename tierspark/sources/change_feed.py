"""Change feeds: table rows with ``_change_type`` and ``_commit_version``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def change_feed_range(feed: DataFrame, last_applied: int, current: int) -> DataFrame:
    """The changes of versions ``last_applied + 1`` to ``current``; none if ``current`` is not newer."""
    version = F.col("_commit_version")
    return feed.where((version > F.lit(last_applied)) & (version <= F.lit(current)))


def read_delta_changes(spark: SparkSession, location: str, last_applied: int, current: int) -> DataFrame:
    """The same range from a Delta table with its change feed on; all partitions of the scan are read."""
    return (
        spark.read.format("delta")
        .option("readChangeFeed", "true")
        .option("startingVersion", last_applied + 1)
        .option("endingVersion", current)
        .load(location)
    )


def stream_delta_changes(spark: SparkSession, location: str, starting_version: int = 0) -> DataFrame:
    """A Delta table's change feed as a stream; the query's checkpoint keeps the last version."""
    return (
        spark.readStream.format("delta")
        .option("readChangeFeed", "true")
        .option("startingVersion", starting_version)
        .load(location)
    )
