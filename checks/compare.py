"""Run registered queries next to their SQL: ``python -m checks.compare [sf_dir] [query ...]``."""

from __future__ import annotations

import math
import sys
import time
from collections import Counter

import duckdb
from pyspark.sql import SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"


def expected(sf_dir: str, sql: str) -> tuple[list[str], list[tuple]]:
    con = duckdb.connect()
    for name in TABLES.split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    cursor = con.execute(sql)
    return [d[0] for d in cursor.description], cursor.fetchall()


def _plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return (type(value).__name__, value)


def _bag(columns: list[str], rows: list) -> Counter:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(columns: list[str], rows: list, want_columns: list[str], want_rows: list) -> str | None:
    """None if both hold the same rows, else what differs."""
    if sorted(columns) != sorted(want_columns):
        return f"columns {sorted(columns)}, want {sorted(want_columns)}"
    got, want = _bag(columns, rows), _bag(want_columns, want_rows)
    if got == want:
        return None
    return f"{len(rows)} rows, want {len(want_rows)}; extra {list((got - want))[:3]}, missing {list((want - got))[:3]}"


def main(arguments: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import QUERIES

    sf_dir = arguments[0] if arguments else "/root/testdata/sf0.01"
    spark = SparkSession.builder.master("local[8]").config("spark.ui.enabled", "false").config(
        "spark.sql.shuffle.partitions", "8"
    ).config("spark.driver.memory", "8g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    failed = 0
    for name in arguments[1:] or QUERIES:
        start = time.time()
        try:
            df = QUERIES[name](spark, sf_dir)
            rows = df.collect()
            took = time.time() - start
            problem = difference(df.columns, rows, *expected(sf_dir, ORACLES[name])) if name in ORACLES else "no SQL"
        except Exception as error:  # noqa: BLE001
            took, rows, problem = time.time() - start, [], f"{type(error).__name__}: {str(error)[:1500]}"
        failed += problem is not None
        print(f"{name:28s} {took:7.2f}s {len(rows):7d} {problem or 'ok'}", flush=True)
    spark.stop()
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
