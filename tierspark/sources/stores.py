"""Where rows are read from: lake tables and database tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def lake_location(bucket: str, path: str, scheme: str = "s3a") -> str:
    """The address of a lake table: bucket and path, slashes around the path trimmed."""
    return f"{scheme}://{bucket}/{path.strip('/')}"


def read_lake(
    spark: SparkSession, location: str, format: str = "parquet", schema: T.StructType | None = None
) -> DataFrame:
    """A lake table. Column choice and time bounds applied later reach its scan."""
    reader = spark.read.format(format)
    if schema is not None and format != "delta":
        reader = reader.schema(schema)
    return reader.load(location)


def read_footers(spark: SparkSession, location: str) -> DataFrame:
    """A parquet lake through Spark's second reader, which counts rows by the files' footers alone.

    Counts of all rows, or of those of some partitions, read no row if ``spark.sql.parquet.aggregatePushdown`` is
    on (see ``configure``); other uses read the same rows as :func:`read_lake`, but smallest and largest values fail
    in Spark where a file has only NULLs.
    """
    name = "spark.sql.sources.useV1SourceList"
    before = spark.conf.get(name)
    spark.conf.set(name, ",".join(kind for kind in before.split(",") if kind.strip() != "parquet"))
    try:
        return spark.read.parquet(location)
    finally:
        spark.conf.set(name, before)


def read_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str] | None = None,
    split_column: str | None = None,
    lower: str | int | None = None,
    upper: str | int | None = None,
    partitions: int = 1,
) -> DataFrame:
    """One database table by its bare name; a dot is part of the name.

    Column choice and time bounds applied later are sent to the database. ``split_column`` with its
    usual range reads the table in ``partitions`` parallel queries; rows outside the range are read
    too, by the first and last query.
    """
    reader = (
        spark.read.format("jdbc")
        .option("url", url)
        .option("dbtable", '"' + table.replace('"', '""') + '"')
        .option("fetchsize", 10_000)
        .options(**dict(properties or {}))
    )
    if split_column:
        reader = (
            reader.option("partitionColumn", split_column)
            .option("lowerBound", lower)
            .option("upperBound", upper)
            .option("numPartitions", partitions)
        )
    return reader.load()
