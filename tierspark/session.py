"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that change results, not speed.
RESULT_SETTINGS = {
    # Instants are stored and shown in UTC.
    "spark.sql.session.timeZone": "UTC",
    # A JSON object that repeats a key keeps the last value instead of failing.
    "spark.sql.variant.allowDuplicateKeys": "true",
}

# Settings that only change speed.
SPEED_SETTINGS = {
    # The JVM never compiles a method of more than 8000 bytes. Message mapping can generate such a
    # method; Spark then splits it by operator instead.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Lets totals be read from the footers of parquet files.
    "spark.sql.parquet.aggregatePushdown": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the settings the library's results depend on, and those that suit its plans."""
    for key, value in {**RESULT_SETTINGS, **SPEED_SETTINGS}.items():
        spark.conf.set(key, value)
    return spark


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder for one run's intermediate tables.

    It lies below ``spark.checkpoint.dir``, which every executor can reach. Without that setting only
    a local master may use a temporary folder of this machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        root = tempfile.mkdtemp(prefix="tierspark-")
    return f"{root.rstrip('/')}/{purpose}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` and read it back: cuts the lineage and gives the optimizer the real size."""
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def is_small(df: DataFrame) -> bool:
    """Whether a written table is small enough to send to every executor, by the session's own limit.

    Both its files and its rows in memory count: compressed files say little about the latter, so every
    column of every row is taken as 32 bytes at least.
    """
    limit = int(df.sparkSession._jsparkSession.sessionState().conf().autoBroadcastJoinThreshold())
    files = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return files <= limit and df.count() * 32 * len(df.columns) <= limit
