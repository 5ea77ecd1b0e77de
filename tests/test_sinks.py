from datetime import datetime

import duckdb
import pytest

from tierspark.operators.mapping import Mapping
from tierspark.sources.stores import lake_location
from tierspark.streaming.sinks import create_lake_statement, delete_statement, merge_statement, prune_statement

WIDE = Mapping('k"1', [("k", 'k"1', "int"), ("v", "v", "text"), ("t", "t", "timestamp")])
NARROW = Mapping("k", [("k", "k", "int")])


def test_statements_change_rows_in_place():
    con = duckdb.connect()
    con.execute("""CREATE TABLE t ("k""1" BIGINT, v VARCHAR, t TIMESTAMP, kept INT)""")
    con.execute("INSERT INTO t VALUES (1, 'a', NULL, 10), (2, 'b', NULL, 20), (3, 'c', NULL, 30)")
    con.execute("""CREATE TABLE c AS SELECT * FROM (VALUES (2, 'B', NULL), (4, 'D', NULL)) x("k""1", v, t)""")
    con.execute("""CREATE TABLE d AS SELECT 3 AS "k""1" """)
    for _ in range(2):
        con.execute(delete_statement("t", "d", WIDE))
        con.execute(merge_statement("t", "c", WIDE))
        assert con.execute("SELECT * FROM t ORDER BY 1").fetchall() == [
            (1, "a", None, 10), (2, "B", None, 20), (4, "D", None, None),
        ]


def test_a_key_alone_updates_nothing():
    assert "UPDATE" not in merge_statement("t", "c", NARROW)
    con = duckdb.connect()
    con.execute("CREATE TABLE t AS SELECT 1 AS k, 'x' AS v")
    con.execute("CREATE TABLE c AS SELECT unnest([1, 2]) AS k")
    con.execute(merge_statement("t", "c", NARROW))
    assert con.execute("SELECT * FROM t ORDER BY 1").fetchall() == [(1, "x"), (2, None)]


def test_lake_table_statement(spark):
    assert create_lake_statement("s3a://b/p", WIDE.schema) == (
        'CREATE TABLE IF NOT EXISTS delta.`s3a://b/p` (`k"1` bigint, `v` string, `t` timestamp) USING delta '
        "TBLPROPERTIES (delta.enableChangeDataFeed = true)"
    )
    with pytest.raises(Exception, match="(?i)delta"):
        spark.sql(create_lake_statement("s3a://b/p", WIDE.schema))


def test_lake_location():
    assert lake_location("bucket", "/events/raw/") == "s3a://bucket/events/raw"


def test_prune_statement(spark):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    con.execute(
        "CREATE TABLE t AS SELECT * FROM (VALUES (1, TIMESTAMPTZ '2024-01-23 23:59:59+00'), "
        "(2, TIMESTAMPTZ '2024-01-24 00:00:00+00'), (3, NULL)) x(id, ts)"
    )
    con.execute(prune_statement("t", "ts", 7, datetime(2024, 1, 31)))
    assert con.execute("SELECT id FROM t ORDER BY 1").fetchall() == [(2,), (3,)]
    text = prune_statement("t", "ts", 7, datetime(2024, 1, 31), "`")
    assert text == "DELETE FROM t WHERE `ts` < CAST('2024-01-24 00:00:00.000000+00:00' AS TIMESTAMP)"
    with pytest.raises(ValueError):
        prune_statement("t", "ts", 0, datetime(2024, 1, 31))
