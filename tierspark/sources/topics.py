"""Message streams: ``value`` (bytes), ``topic``, ``partition``, ``offset``, ``timestamp``."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MESSAGE_SCHEMA = T.StructType(
    [
        T.StructField("value", T.BinaryType()),
        T.StructField("partition", T.IntegerType()),
        T.StructField("offset", T.LongType()),
    ]
)


def read_topic(
    spark: SparkSession,
    brokers: Sequence[str],
    topic: str,
    max_offsets: int | None = None,
    options: Mapping[str, str] | None = None,
) -> DataFrame:
    """A topic from its earliest offset. The query's checkpoint keeps the position, not a consumer group.

    ``max_offsets`` bounds one batch. Topic partitions become tasks; ``minPartitions`` among the
    options splits large ones further.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", ",".join(brokers))
        .option("subscribe", topic)
        .option("startingOffsets", "earliest")
        .options(**dict(options or {}))
    )
    if max_offsets:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets)
    return reader.load().select("value", "topic", F.col("partition"), F.col("offset"), "timestamp")


def read_message_files(
    spark: SparkSession, path: str, schema: T.StructType = MESSAGE_SCHEMA, max_files: int | None = None
) -> DataFrame:
    """A folder of parquet files with messages, as a stream; new files are new messages."""
    reader = spark.readStream.schema(schema)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)
