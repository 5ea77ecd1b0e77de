import re
import random
from datetime import datetime, timedelta

import pytest

from tierspark.plans.paging import Key, page, page_arguments, page_summary, table_page, tiered_page
from tierspark.plans.tiers import Tier

NOW = datetime(2024, 1, 31)


@pytest.mark.parametrize(
    ("limit", "offset", "want"),
    [
        (None, None, (20, 0)),
        ("", "", (20, 0)),
        (0, -1, (20, 0)),
        (-5, 7, (20, 7)),
        (500, 0, (500, 0)),
        (501, 0, (20, 0)),
        ("x", "y", (20, 0)),
        (" 5", "1_0", (20, 0)),
        ("+5", "-3", (5, 0)),
        ("2.5", str(2**63), (20, 0)),
    ],
)
def test_arguments(limit, offset, want):
    assert page_arguments(limit, offset) == want


@pytest.fixture(scope="module")
def data():
    """Times with one instant that holds a third of all rows, far-off outliers, and tied instants."""
    r = random.Random(7)
    hot = datetime(2024, 1, 20)
    times = [hot] * 1000 + [hot - timedelta(seconds=r.randrange(500)) for _ in range(1000)]
    times += [datetime(2024, 1, 1) + timedelta(microseconds=r.randrange(2_500_000_000_000)) for _ in range(990)]
    times += [datetime(1970, 1, 1), datetime(2023, 1, 1), datetime(2024, 1, 30, 23, 59, 59, 999999)] + [NOW] * 7
    r.shuffle(times)
    return [(i * 3 - 4000, t) for i, t in enumerate(times)]


@pytest.fixture(scope="module")
def rows(spark, data):
    return spark.createDataFrame(data, "id bigint, ts timestamp_ntz").repartition(5).cache()


OFFSETS = [0, 3, 50, 300, 900, 1100, 1500, 1999, 2400, 2950, 2990, 3000, 9999]


@pytest.mark.parametrize("offset", OFFSETS)
def test_deep_pages_match_a_full_sort(rows, data, offset):
    want = sorted(data, key=lambda x: (-(x[1] - datetime(1970, 1, 1)).total_seconds(), x[0]))[offset : offset + 40]
    got = page(rows, [Key("ts", True), Key("id")], 40, offset, direct_rows=60)
    assert list(map(tuple, got.collect())) == want


@pytest.mark.parametrize("offset", [0, 100, 2960, 2995])
@pytest.mark.parametrize("descending", [False, True])
def test_deep_pages_by_number(rows, data, offset, descending):
    want = sorted((x[0] for x in data), reverse=descending)[offset : offset + 40]
    got = page(rows, [Key("id", descending)], 40, offset, direct_rows=60)
    assert [r.id for r in got.collect()] == want


def test_deep_pages_of_large_numbers(spark):
    numbers = [2**62 + i * 7 for i in range(500)] + [-(2**62) + i for i in range(500)]
    df = spark.createDataFrame([(n,) for n in numbers], "id bigint")
    got = page(df, [Key("id")], 5, 700, direct_rows=20)
    assert sorted(r.id for r in got.collect()) == sorted(numbers)[700:705]


TEXTS = [f"evt-{i}" for i in range(300)] + [f"évt-{i}x" for i in range(40)] + ["", "e", "evt", "evt-", "日本", "日", "😀"]
TEXTS += [f"{i:x}" * 5 for i in range(300)]


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("offset", [0, 21, 100, 305, 340, 500, 620, 640, len(TEXTS)])
def test_deep_pages_by_text(spark, offset, descending):
    df = spark.createDataFrame([(t,) for t in TEXTS], "id string").repartition(3)
    want = sorted(TEXTS, key=str.encode, reverse=descending)[offset : offset + 9]
    assert [r.id for r in page(df, [Key("id", descending)], 9, offset, direct_rows=20).collect()] == want


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("offset", [0, 30, 50, 58, 60, 100, 155])
def test_deep_pages_with_nulls_and_ties(spark, offset, descending):
    data = [(None, f"a{i:03d}") for i in range(60)] + [(7, f"b{i:03d}") for i in range(60)] + [(i, "c") for i in range(8, 48)]
    df = spark.createDataFrame(data, "n int, t string").repartition(3)
    nulls, filled = data[:60], data[60:]
    if descending:
        want = sorted(filled, key=lambda r: (-r[0], r[1])) + nulls
    else:
        want = nulls + sorted(filled)
    got = page(df, [Key("n", descending), Key("t")], 5, offset, direct_rows=10)
    assert list(map(tuple, got.collect())) == want[offset : offset + 5]


def test_deep_pages_of_one_value(spark):
    df = spark.range(50).selectExpr("1 n", "cast(null as string) t")
    assert page(df, [Key("n"), Key("t")], 5, 30, direct_rows=10).count() == 5


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize(
    "key",
    [
        "date_add(date'1969-12-01', cast(id % 300 as int))",
        "cast((id - 250) / 8 as decimal(9,3))",
        "cast(id - 250 as decimal(18,0))",
        "cast((id - 250) / 1000 as decimal(18,18))",
        "cast(id - 300 as decimal(30,2))",
        "id % 3 = 0",
        "cast(if(id < 350, 5.5, (id - 400) * 1.25e-3) as double)",
        "case when id % 9 = 0 then double('NaN') when id % 9 = 1 then double('-Infinity') when id % 9 = 2 then null "
        "when id % 9 = 3 then -0.0D when id % 9 = 4 then 0.0D else pow(-1.7D, id % 200) end",
        "cast((id - 300) * 0.1 as float)",
        "cast(pow(10, 25) * (id % 7) + id as decimal(38,2))",
        "double('NaN')",
    ],
)
def test_deep_pages_by_other_types(spark, key, descending):
    """A day twice, decimals below zero and at the limit of their digits, two values that hold all rows."""
    df = spark.range(600).selectExpr(f"{key} k", "id").repartition(3)
    order = [Key("k", descending), Key("id")]
    want = list(map(str, df.orderBy(*[k.order() for k in order]).collect()))
    for offset in (0, 25, 199, 330, 595):
        assert list(map(str, page(df, order, 9, offset, direct_rows=20).collect())) == want[offset : offset + 9]


def test_deep_pages_by_date_sort_few_rows(spark):
    df = spark.range(5000).selectExpr("date_add(date'2000-01-01', cast(id as int)) d")
    found = page(df, [Key("d")], 5, 4000, direct_rows=20)
    assert "limit=40" not in found._jdf.queryExecution().executedPlan().toString()


def test_deep_pages_by_double_sort_few_rows(spark):
    """Skewed values too: a page from the middle never sorts its whole offset."""
    df = spark.range(5000).selectExpr("cast(if(id < 4000, id, exp(id / 10)) as double) d", "id")
    for offset in (300, 3999, 4500):
        found = page(df, [Key("d"), Key("id")], 5, offset, direct_rows=200)
        head = re.search("TakeOrderedAndProject\\(limit=([0-9]+)", found._jdf.queryExecution().executedPlan().toString())
        assert int(head[1]) <= 205
        assert [r.id for r in found.collect()] == list(range(offset, offset + 5))


def tiers(rows):
    return [
        Tier("recent", rows, ["id"], "ts", max_age="7d"),
        Tier("middle", rows, ["id"], "ts", min_age="7d", max_age="11d"),
        Tier("old", rows, ["id"], "ts", min_age="11d"),
    ]


@pytest.mark.parametrize("direct_rows", [60, 20_000])
def test_pages_walk_through_all_tiers(rows, data, direct_rows):
    want = [x[0] for x in sorted(data, key=lambda x: (-(x[1] - datetime(1970, 1, 1)).total_seconds(), x[0]))]
    for offset in (0, 480, 500, 1480, 2960):
        got = tiered_page(tiers(rows), NOW, ["id"], 30, offset, direct_rows=direct_rows)
        assert got.columns == ["id"]
        assert [r.id for r in got.collect()] == want[offset : offset + 30]


def test_past_the_end(rows):
    assert tiered_page(tiers(rows), NOW, ["id"], 30, 3000).count() == 0
    assert page_summary(tiers(rows), NOW, 30, 3000).first().asDict() == {
        "total": 3000, "limit": 30, "offset": 3000, "tiered": True, "first_row": 3001, "last_row": 3000,
    }


def test_single_source_pages(spark):
    df = spark.range(50)
    assert [r.n for r in table_page(df, ["id"], 3, 10, [("id", "n")]).collect()] == [10, 11, 12]
    only = [Tier("only", df, ["id"])]
    assert [r.id for r in tiered_page(only, NOW, ["id"], 3, 10).collect()] == [10, 11, 12]
    assert page_summary(only, NOW).first().tiered is False
