import pytest
from pyspark.sql import functions as F

from tierspark.functions.display import binary_to_string, key_text
from tierspark.operators.views import column_view, describe_result


def test_pick_order_rename(spark):
    df = spark.createDataFrame([(1, "x", 2.0)], "`a.b` int, c string, d double")
    view = column_view(df, ["d", ("a.b", "first"), ("c", "")])
    assert view.columns == ["d", "first", "c"]
    assert view.first() == (2.0, 1, "x")


def test_all_columns_if_none_are_named(spark):
    assert column_view(spark.range(1)).columns == ["id"]


def test_unknown_column(spark):
    with pytest.raises(ValueError, match="'x' not found"):
        column_view(spark.range(1), ["x"])


def test_duplicate_output_name(spark):
    with pytest.raises(ValueError, match="duplicate"):
        column_view(spark.range(1), ["id", ("id", "id")])


def test_description(spark):
    df = spark.range(3).withColumn("t", F.lit("x"))
    assert [tuple(r) for r in describe_result(df).collect()] == [(1, "id", "bigint", 3), (2, "t", "string", 3)]
    assert [r.total for r in describe_result(df.limit(0)).collect()] == [0, 0]


def test_nothing_to_describe(spark):
    with pytest.raises(ValueError, match="not found"):
        describe_result(spark.range(1).select())


def test_bytes_become_text(spark):
    df = spark.createDataFrame([(bytearray(b"ok\xc3\xa9"), 1), (bytearray(b"a\xffb"), 2), (None, 3)], "b binary, n int")
    assert [r.b for r in binary_to_string(df).orderBy("n").collect()] == ["oké", "a�b", None]


def test_key_texts(spark):
    df = spark.sql(
        "SELECT timestamp'2024-01-02 03:04:05Z' whole, timestamp'2024-01-02 03:04:05.120Z' milli, "
        "timestamp'2024-01-02 03:04:05.000012Z' micro, 5L n, 12345678.9D d, 3D e, true b, 'x' s"
    )
    assert tuple(df.select(*[key_text(df, c) for c in df.columns]).first()) == (
        "2024-01-02T03:04:05+00:00",
        "2024-01-02T03:04:05.120+00:00",
        "2024-01-02T03:04:05.000012+00:00",
        "5",
        "12345678.9",
        "3",
        "true",
        "x",
    )


@pytest.mark.parametrize("zone", ["UTC", "America/New_York", "Asia/Kolkata"])
def test_key_texts_of_times_are_in_utc(spark, zone):
    """Also in sessions of other zones, and for local times that a zone's clocks leave out."""
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.sql("SELECT timestamp'2024-03-10 07:30:00.5Z' t, timestamp'1969-12-31 23:59:59.000001Z' o, timestamp_ntz'2024-03-10 02:30:00.25' n")
        assert tuple(df.select(*[key_text(df, c) for c in df.columns]).first()) == (
            "2024-03-10T07:30:00.500+00:00", "1969-12-31T23:59:59.000001+00:00", "2024-03-10T02:30:00.250+00:00",
        )
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
