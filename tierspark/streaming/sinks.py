"""Keyed targets that can change rows in place: Delta tables and databases.

Both need packages that are not part of Spark; the SQL they send is built here and tested as text.
"""

from __future__ import annotations

from collections.abc import Mapping as Named
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tierspark.functions.times import in_utc
from tierspark.operators.mapping import Mapping


def merge_statement(target: str, changes: str, mapping: Mapping, quote: str = '"') -> str:
    """One MERGE that applies ``changes`` (one row per key, no deletes) to ``target``.

    Matching rows take every mapped column but the key; without any, they stay as they are.
    """

    def name(column: str) -> str:
        return quote + column.replace(quote, quote * 2) + quote

    key = name(mapping.key)
    rest = [name(c) for c in mapping.columns if c != mapping.key]
    every = [name(c) for c in mapping.columns]
    lines = [f"MERGE INTO {target} AS t USING {changes} AS c ON t.{key} = c.{key}"]
    if rest:
        lines.append("WHEN MATCHED THEN UPDATE SET " + ", ".join(f"{c} = c.{c}" for c in rest))
    lines.append(f"WHEN NOT MATCHED THEN INSERT ({', '.join(every)}) VALUES ({', '.join('c.' + c for c in every)})")
    return "\n".join(lines)


def delete_statement(target: str, changes: str, mapping: Mapping, quote: str = '"') -> str:
    """Removal of the rows whose key is in ``changes``."""
    key = quote + mapping.key.replace(quote, quote * 2) + quote
    return f"DELETE FROM {target} WHERE {key} IN (SELECT {key} FROM {changes})"


def create_lake_statement(location: str, schema: T.StructType, partitioned_by: Sequence[str] = ()) -> str:
    """A Delta table of these columns, with its change feed on, unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    layout = f"PARTITIONED BY ({', '.join(f'`{c}`' for c in partitioned_by)}) " if partitioned_by else ""
    return (
        f"CREATE TABLE IF NOT EXISTS delta.`{location}` ({columns}) USING delta {layout}"
        "TBLPROPERTIES (delta.enableChangeDataFeed = true)"
    )


def prune_statement(target: str, ts: str, days: int, now: datetime, quote: str = '"') -> str:
    """Removal of the rows whose time is more than ``days`` days before ``now``; rows without a time stay."""
    if days <= 0:
        raise ValueError("days must be positive")
    limit = (in_utc(now) - timedelta(days=days)).strftime("%Y-%m-%d %H:%M:%S.%f+00:00")
    column = quote + ts.replace(quote, quote * 2) + quote
    kind = "TIMESTAMP" if quote == "`" else "TIMESTAMP WITH TIME ZONE"
    return f"DELETE FROM {target} WHERE {column} < CAST('{limit}' AS {kind})"


def prune_delta(spark: SparkSession, location: str, ts: str, days: int, now: datetime) -> None:
    """Remove old rows from a Delta table; whole files are dropped where its statistics allow."""
    spark.sql(prune_statement(f"delta.`{location}`", ts, days, now, "`"))


def merge_into_delta(writes: DataFrame, removed: DataFrame | None, location: str, mapping: Mapping) -> None:
    """Remove the keys of ``removed``, then merge ``writes``, in a Delta table."""
    spark = writes.sparkSession
    target = f"delta.`{location}`"
    if removed is not None:
        removed.createOrReplaceTempView("removed_keys")
        spark.sql(delete_statement(target, "removed_keys", mapping, "`"))
    writes.createOrReplaceTempView("merged_rows")
    spark.sql(merge_statement(target, "merged_rows", mapping, "`"))


def merge_into_database(
    writes: DataFrame,
    removed: DataFrame | None,
    url: str,
    table: str,
    mapping: Mapping,
    properties: Named[str, str] | None = None,
    connections: int = 8,
) -> None:
    """The same in a database that knows MERGE: tasks fill staging tables, one transaction applies them.

    ``connections`` bounds how many tasks write at once.
    """
    settings = dict(properties or {})
    target = '"' + table.replace('"', '""') + '"'
    staging = {f"{table}_merged_rows": writes}
    if removed is not None:
        staging[f"{table}_removed_keys"] = removed
    for name, rows in staging.items():
        (
            rows.write.format("jdbc")
            .options(url=url, dbtable='"' + name.replace('"', '""') + '"', numPartitions=connections, **settings)
            .mode("overwrite")
            .save()
        )
    statements = [merge_statement(target, f'"{table}_merged_rows"', mapping)]
    if removed is not None:
        statements.insert(0, delete_statement(target, f'"{table}_removed_keys"', mapping))
    jvm = writes.sparkSession._jvm
    java_settings = jvm.java.util.Properties()
    for key, value in settings.items():
        java_settings.setProperty(key, value)
    connection = jvm.java.sql.DriverManager.getConnection(url, java_settings)
    try:
        connection.setAutoCommit(False)
        statement = connection.createStatement()
        for text in statements:
            statement.executeUpdate(text)
        connection.commit()
    finally:
        connection.close()
