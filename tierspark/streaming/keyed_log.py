"""A keyed table in plain files: every batch appends its changes, readers see the last state per key.

Layout: ``<path>/stream=<query id>/batch_id=<n>/`` with the mapped columns, ``_time, _major, _minor`` (the
order of changes) and ``_deleted``. A batch that runs again replaces its own folder, so a restart changes
nothing, and another stream into the same table has folders of its own. The order
travels with the rows, hence it does not matter in which batch a change arrives.
"""

from __future__ import annotations

import hashlib
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions.names import quoted
from tierspark.operators.changes import change_position, latest_per_key
from tierspark.operators.mapping import Mapping
from tierspark.operators.retention import expired
from tierspark.sources import folders

ORDER = ["_time", "_major", "_minor"]
BUCKETS = "_buckets="


def log_schema(mapping: Mapping) -> T.StructType:
    return T.StructType(
        [
            *mapping.schema.fields,
            T.StructField("_time", T.LongType()),
            T.StructField("_major", T.LongType()),
            T.StructField("_minor", T.LongType()),
            T.StructField("_deleted", T.BooleanType()),
            T.StructField("stream", T.StringType()),
            T.StructField("batch_id", T.LongType()),
        ]
    )


def batch_folder(path: str, stream: str, batch_id: int) -> str:
    """The folder of one batch of one stream."""
    return f"{path.rstrip('/')}/stream={stream}/batch_id={batch_id}"


def append_batch(changes: DataFrame, mapping: Mapping, path: str, stream: str, batch_id: int) -> None:
    """Write one batch, reduced to one row per key, into its own folder."""
    last = latest_per_key(changes.select(*[quoted(c) for c in mapping.columns], *ORDER, "_deleted"), mapping.key, ORDER)
    last.write.mode("overwrite").parquet(batch_folder(path, stream, batch_id))


def message_changes(rows: DataFrame) -> DataFrame:
    """Accepted messages as changes: their time decides where they have one, then the offset, then the partition."""
    time = F.unix_micros("_timestamp") if "_timestamp" in rows.columns else F.lit(0)
    return rows.select(
        "*",
        time.cast("bigint").alias("_time"),
        F.col("_offset").alias("_major"),
        F.col("_partition").cast("bigint").alias("_minor"),
        F.lit(False).alias("_deleted"),
    )


def feed_changes(feed: DataFrame) -> DataFrame:
    """Change feed rows as changes: commit order, deletes before writes of the same commit, then position."""
    removes = F.col("_change_type") == "delete"
    position = change_position(feed)
    return feed.where(F.col("_change_type").isin("insert", "update_postimage", "delete")).select(
        "*",
        F.lit(0).cast("bigint").alias("_time"),
        F.col("_commit_version").alias("_major"),
        F.when(removes, 0).otherwise(1 + position).cast("bigint").alias("_minor"),
        removes.alias("_deleted"),
    )


def read_log(spark: SparkSession, path: str, mapping: Mapping) -> DataFrame:
    return spark.read.schema(log_schema(mapping)).parquet(path)


def base_schema(mapping: Mapping) -> T.StructType:
    return T.StructType([f for f in log_schema(mapping).fields if f.name not in ("stream", "batch_id")])


def buckets_of(spark: SparkSession, base: str) -> int | None:
    """The number of buckets of a base, which it notes in the name of a folder; None if it has none."""
    found = [name for name in folders.names_in(spark, base) if name.startswith(BUCKETS)]
    return int(found[0].removeprefix(BUCKETS)) if found else None


def read_base(spark: SparkSession, base: str, mapping: Mapping) -> DataFrame:
    """What :func:`compact` wrote: one row per key with its place in the order; deleted keys are marked.

    A base in buckets is read as such: its rows are known to be dealt out by key already.
    """
    buckets = buckets_of(spark, base)
    if buckets is None:
        rows = spark.read.schema(base_schema(mapping)).parquet(base)
    else:
        name = _table_name(base)
        if not spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base_schema(mapping))
            key = f"`{mapping.key}`"
            spark.sql(
                f"CREATE TABLE {name} ({columns}) USING parquet "
                f"CLUSTERED BY ({key}) SORTED BY ({key}) INTO {buckets} BUCKETS LOCATION '{base}'"
            )
        rows = spark.table(name)
    return rows.withColumn("_deleted", F.coalesce("_deleted", F.lit(False)))


def _table_name(base: str) -> str:
    return "keyed_base_" + hashlib.md5(base.encode()).hexdigest()


def _last(log: DataFrame, base: DataFrame | None, key: str, buckets: int | None = None) -> DataFrame:
    """The last state of every key in log and base, deleted ones too. Of equal places the base's counts.

    Log and base go through one aggregate. If the base lies in ``buckets``, the log is reduced first and dealt
    out like them, and only then meets the base, which stays where it is.
    """
    log = log.drop("stream", "batch_id")
    if base is not None and buckets:
        state = lambda df, name: df.select(quoted(key).alias(f"{name}_key"), F.struct("*").alias(name))
        new = state(latest_per_key(log.where(quoted(key).isNotNull()), key, ORDER), "_new")
        new = new.repartition(buckets, "_new_key").hint("shuffle_hash")
        met = state(base, "_old").join(new, F.col("_old_key") == F.col("_new_key"), "full_outer")
        place = lambda name: F.struct(*[F.col(name).getField(c) for c in ORDER])
        newer = F.col("_old").isNull() | (F.col("_new").isNotNull() & (place("_new") > place("_old")))
        chosen = F.when(newer, F.col("_new")).otherwise(F.col("_old"))
        return met.select(chosen.alias("_row")).select(*[F.col("_row").getField(c).alias(c) for c in base.columns])
    rows = log.withColumn("_settled", F.lit(False))
    if base is not None:
        rows = rows.unionByName(base.withColumn("_settled", F.lit(True)))
    return latest_per_key(rows, key, [*ORDER, "_settled"]).drop("_settled")


def read_keyed(spark: SparkSession, path: str, mapping: Mapping, base: str | None = None) -> DataFrame:
    """The table's current rows.

    With ``base``, written by :func:`compact`, the log only has to hold what came later. Both carry the
    order of changes, so the log may still hold what the base covers, and a change that comes late or again
    is no newer than it is. A base in buckets is not moved.
    """
    settled = None if base is None else read_base(spark, base, mapping)
    last = _last(read_log(spark, path, mapping), settled, mapping.key, base and buckets_of(spark, base))
    return last.where(~F.col("_deleted")).select(*[quoted(c) for c in mapping.columns])


def compact(
    spark: SparkSession,
    path: str,
    mapping: Mapping,
    target: str,
    base: str | None = None,
    retention: tuple[str, int, datetime] | None = None,
    forget: Column | None = None,
    buckets: int | None = None,
) -> list[str]:
    """Write the last state of every key to ``target``, a new base, and return the log folders it covers.

    Those folders may be removed afterwards; folders that streams add meanwhile are not among them.
    ``retention`` (time column, days, now) deletes rows that are too old. Deleted keys stay in the base
    without their contents, so that older changes do not bring them back; ``forget`` is a condition on
    ``_time, _major, _minor`` for deletions so old that no earlier change can come any more. ``buckets``
    lays the base out by key in so many parts, sorted: later reads and compactions move only the log.
    """
    log = read_log(spark, path, mapping)
    settled = None if base is None else read_base(spark, base, mapping)
    last = _last(log, settled, mapping.key, base and buckets_of(spark, base))
    if retention:
        last = last.withColumn("_deleted", F.col("_deleted") | F.coalesce(expired(last, *retention), F.lit(False)))
    if forget is not None:
        last = last.where(~(F.col("_deleted") & F.coalesce(forget, F.lit(False))))
    contents = [F.when(~F.col("_deleted"), quoted(c)).alias(c) for c in mapping.columns if c != mapping.key]
    last = last.select(quoted(mapping.key), *contents, *ORDER, "_deleted").select(*base_schema(mapping).fieldNames())
    if buckets:
        dealt = last.repartition(buckets, quoted(mapping.key)).write.bucketBy(buckets, mapping.key).sortBy(mapping.key)
        dealt.format("parquet").option("path", target).mode("errorifexists").saveAsTable(_table_name(target))
        folders.make(spark, f"{target.rstrip('/')}/{BUCKETS}{buckets}")
    else:
        last.write.mode("errorifexists").parquet(target)
    return sorted({file.rpartition("/")[0] for file in log.inputFiles()})
