import json
import math
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions.payloads import double_text, field_path
from tierspark.operators.mapping import MALFORMED, Field, Mapping, accepted, map_messages, reject_counts, rejected


def messages(spark, payloads):
    rows = [
        (None if p is None else bytearray(p if isinstance(p, bytes) else p.encode()), 0, i)
        for i, p in enumerate(payloads)
    ]
    return spark.createDataFrame(rows, "value binary, partition int, offset bigint")


def outcome(spark, declared, payloads):
    """Per payload the value of field ``v``, or the reason as ``!reason``."""
    mapped = map_messages(messages(spark, payloads), Mapping("v", [("$.v", "v", declared)]))
    return [f"!{r.reject_reason}" if r.reject_reason else r.v for r in mapped.orderBy("_offset").collect()]


GOOD = '{"v":"x"}'


@pytest.mark.parametrize(
    "payload",
    [
        None,
        "",
        " ",
        '{"v":"x"',
        '{"v":"x"} y',
        '{"v":"x"}{"v":"y"}',
        '{"v":"x"},{"v":"y"}',
        '{"v":"x"}]',
        '{"v":"x"},"~end~"]',
        '{"v":"x"},"0"',
        b'{"v":"\xff"}',
        b'\xef\xbb\xbf{"v":"x"}',
        "{'v':'x'}",
        '{"v":NaN}',
        '{"v":01}',
        '{"v":"x",}',
        "not json",
    ],
)
def test_malformed(spark, payload):
    assert outcome(spark, "text", [payload, GOOD]) == [f"!{MALFORMED}", "x"]


def test_well_formed_but_not_an_object(spark):
    for payload in ("1", "null", '"v"', '[{"v":"x"}]', "{}"):
        assert outcome(spark, "text", [payload]) == ["!v: path $.v not found"]


def test_whitespace_and_repeated_keys(spark):
    assert outcome(spark, "text", [' \n{"v":"x"}\t ', '{"v":"a","v":"b"}', '{"v":"é\\u00e9"}']) == ["x", "b", "éé"]


def v(values):
    return [f'{{"v":{x}}}' for x in values]


@pytest.mark.parametrize(
    ("declared", "cases"),
    [
        ("text", {
            '"a"': "a", '""': "", '"null"': "null", "null": "null", "true": "true", "1": "1", "-7": "-7",
            "1.0": "1.0", "1.50": "1.5", "12345678.9": "12345678.9", "1e3": "1000.0", "1e16": "1e16",
            "1e15": "1000000000000000.0", "1.5e-7": "1.5e-7", "0.00012": "0.00012", "0.00001": "0.00001",
            "9223372036854775807": "9223372036854775807", "18446744073709551615": "18446744073709551615",
            "123456789012345678901234567890": "1.2345678901234568e29", "-2.5e20": "-2.5e20",
            '{"b":1,"a":[1, null]}': '{"a":[1,null],"b":1}', "[]": "[]", '" 5 "': " 5 ",
        }),
        ("whatever", {'"a"': "a", "null": "null", "3": "3"}),
        ("bigint", {
            "5": 5, "-5": -5, '"5"': 5, '"+5"': 5, '"-05"': -5, "9223372036854775807": 2**63 - 1,
            '"-9223372036854775808"': -(2**63), '"9223372036854775808"': None, "9223372036854775808": None,
            "1.0": None, "1e2": None, '" 5"': None, '"5\\n"': None, '"5.0"': None, '""': None, '"+"': None,
            "null": None, "true": None, "[5]": None, "{}": None,
        }),
        ("double", {
            "5": 5.0, "1.25": 1.25, "1e3": 1000.0, "-1e-300": -1e-300, '"1.5"': None, "null": None, "true": None,
            "1e400": None, "-1e400": None, "[]": None, "18446744073709551616": 18446744073709551616.0,
        }),
        ("bool", {"true": True, "false": False, '"true"': None, "1": None, "null": None, "{}": None}),
    ],
)
def test_coercion(spark, declared, cases):
    want = [f"!v: not a {declared}" if x is None else x for x in cases.values()]
    assert outcome(spark, declared, v(cases)) == want


def test_times(spark):
    cases = {
        "2024-01-02T03:04:05Z": "2024-01-02 03:04:05",
        "2024-01-02t03:04:05.5z": "2024-01-02 03:04:05.5",
        "2024-01-02 03:04:05Z": "2024-01-02 03:04:05",
        "2024-01-02T03:04:05.123456789+05:30": "2024-01-01 21:34:05.123456",
        "2024-01-02T03:04:05-00:30": "2024-01-02 03:34:05",
        "2024-01-02": None,
        "2024-01-02T03:04:05": None,
        "2024-01-02T03:04Z": None,
        "2024-01-02T03:04:05.Z": None,
        "2024-01-02T03:04:05+0530": None,
        "2024-01-02T03:04:05 UTC": None,
        "2024-02-30T03:04:05Z": None,
        "2024-01-02T25:04:05Z": None,
        " 2024-01-02T03:04:05Z": None,
        "2024-01-02T03:04:05Z\\n": None,
        "now": None,
    }
    mapped = map_messages(messages(spark, v(f'"{c}"' for c in cases)), Mapping("v", [("v", "v", "timestamp")]))
    got = mapped.orderBy("_offset").select(F.col("v").cast("string"), "reject_reason").collect()
    assert [r.v for r in got] == list(cases.values())
    assert {r.reject_reason for r in got if r.v is None} == {"v: not a timestamp"}
    assert outcome(spark, "timestamptz", v(["1704164645", "null", "true", "{}"])) == ["!v: not a timestamptz"] * 4


def digits(text):
    """The significant digits of a number's text."""
    return text.lower().split("e")[0].replace("-", "").replace(".", "").strip("0")


def test_double_texts_round_trip(spark):
    numbers = [0.0, 1.0, 1 / 3, 1e7, 9999999.5, 1.5e10, 123456789.125, 1e15, 9.5e15, 1e16, 1e17, 1.25e22, 1e300]
    numbers += [0.001, 0.000999, 1.25e-4, 1e-5, 9.9e-6, 1e-7, 4.2e-200]
    numbers += [5.11e21, 1.294e22, 8.41e21, 2e23, 2.0**-44, 1.1e-5, 4.35, 0.1 + 0.2, 1e23, 9007199254740993.0]
    r = random.Random(1)
    numbers += [r.random() * 10 ** r.randint(-30, 30) for _ in range(300)]
    numbers += [round(r.random(), r.randint(1, 5)) * 10.0 ** r.randint(-30, 30) for _ in range(300)]
    numbers += [-x for x in numbers[1:]]
    df = spark.createDataFrame([(x,) for x in numbers], "x double")
    for row in df.select("x", double_text(F.col("x")).alias("t")).collect():
        # Python writes the shortest digits too. Of two texts with 16 digits either may be taken.
        assert float(row.t) == row.x and len(digits(row.t)) == len(digits(repr(row.x))), row
        assert ("e" in row.t) == (row.x != 0 and not 1e-5 <= math.fabs(row.x) < 1e16), row
        assert "e" in row.t or "." in row.t


def test_first_fault_in_mapping_order_is_the_reason(spark):
    mapping = Mapping("a", [("a", "a", "int"), ("b", "b", "bool"), ("c", "c", "text")])
    payloads = ['{"a":"x","b":1}', '{"a":1,"b":1}', '{"a":1,"b":true}', '{"a":1,"b":true,"c":null}', "{"]
    mapped = map_messages(messages(spark, payloads), mapping)
    assert [r.reject_reason for r in mapped.orderBy("_offset").collect()] == [
        "a: not a int", "b: not a bool", "c: path c not found", None, MALFORMED,
    ]
    assert accepted(mapped, mapping).collect() == [(1, True, "null", 0, 3)]
    assert [(r._offset, bytes(r._value)) for r in rejected(mapped).orderBy("_offset").collect()][-1] == (4, b"{")
    assert sum(r.messages for r in reject_counts(mapped).collect()) == 4


def test_paths(spark):
    doc = {"a": {"b.c": 1, "b": {"c": 2, "it's": 3}}, "$": 4, "l": [{"x": 5}]}
    found = {}
    for path in ("$.a.b.c", "a.b.c", "$.a.b.it's", "$", "$.l.x", "l.0", "a.b.c.d", "A.b.c"):
        mapping = Mapping("v", [(path, "v", "int")])
        row = map_messages(messages(spark, [json.dumps(doc)]), mapping).first()
        found[path] = row.v
    assert found == {
        "$.a.b.c": 2, "a.b.c": 2, "$.a.b.it's": 3, "$": 4, "$.l.x": None, "l.0": None, "a.b.c.d": None, "A.b.c": None,
    }
    for path in ("", "a..b", "a.", """it's "both" """):
        with pytest.raises(ValueError):
            field_path(path)


def test_schema():
    types = ["text", "json", "timestamptz", "timestamp", "int", "bigint", "float", "double", "boolean", "bool", "odd"]
    mapping = Mapping("c0", [(f"$.f{i}", f"c{i}", t) for i, t in enumerate(types)])
    assert mapping.schema.simpleString() == (
        "struct<c0:string,c1:string,c2:timestamp,c3:timestamp,c4:bigint,c5:bigint,c6:double,c7:double,"
        "c8:boolean,c9:boolean,c10:string>"
    )
    assert all(f.nullable for f in mapping.schema)


@pytest.mark.parametrize(
    ("key", "fields"),
    [
        ("a", []),
        ("b", [("$.a", "a", "int")]),
        ("a", [("$.a", "a", "int"), ("$.b", "a", "int")]),
        ("a", [("", "a", "int")]),
        ("_offset", [("$.a", "_offset", "int")]),
    ],
)
def test_mapping_checks(key, fields):
    with pytest.raises(ValueError):
        Mapping(key, [Field(*f) for f in fields])


def test_messages_without_position(spark):
    df = messages(spark, [GOOD]).select("value")
    mapping = Mapping("v", [("v", "v", "text")])
    assert accepted(map_messages(df, mapping), mapping).schema == T.StructType([T.StructField("v", T.StringType())])


def test_mapping_is_one_pass(spark):
    """The filter on the reason must not copy the parse below itself."""
    mapping = Mapping("v", [("v", "v", "text"), ("w", "w", "int"), ("x", "x", "timestamp")])
    for df in (accepted(map_messages(messages(spark, [GOOD]), mapping), mapping), rejected(map_messages(messages(spark, [GOOD]), mapping))):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("parseJson") == 1
        assert plan.count("rlike") + plan.count("RLIKE") <= 2
        assert "Exchange" not in plan


def test_the_same_instant_in_any_session_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    mapping = Mapping("v", [("v", "v", "timestamp")])
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        row = map_messages(messages(spark, v(['"2024-01-02T03:04:05Z"'])), mapping).select(F.unix_seconds("v")).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert row[0] == (datetime(2024, 1, 2, 3, 4, 5) - datetime(1970, 1, 1)).total_seconds()
