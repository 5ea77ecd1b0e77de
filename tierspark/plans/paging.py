"""Pages of a table or of a tiered view, and their totals."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass
from datetime import datetime
from decimal import Decimal
from os.path import commonprefix

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions.names import quoted
from tierspark.operators.views import ColumnSpec, column_view
from tierspark.plans.tiers import Tier, tier_counts, tiered_rows

# Page size by default and at most.
DEFAULT_LIMIT = 20
MAX_LIMIT = 500

# Up to this many rows a page is cut from one sorted head, whose rows all pass the driver. Beyond, the
# page's place is first found by counting.
DIRECT_ROWS = 20_000
BUCKETS = 1024
QUANTILES = 64


def _number(value: object, default: int) -> int:
    """A 64-bit whole number, or the default for anything else."""
    text = str(value)
    if not re.fullmatch(r"[+-]?[0-9]+", text) or not -(2**63) <= int(text) < 2**63:
        return default
    return int(text)


def page_arguments(limit: object = None, offset: object = None) -> tuple[int, int]:
    """Usable ``(limit, offset)``: a limit that is no number, not positive or above 500 becomes 20."""
    size, start = _number(limit, DEFAULT_LIMIT), _number(offset, 0)
    return (size if 0 < size <= MAX_LIMIT else DEFAULT_LIMIT), max(start, 0)


@dataclass(frozen=True)
class Key:
    """One column of the sort order."""

    column: str
    descending: bool = False

    def order(self) -> Column:
        return quoted(self.column).desc() if self.descending else quoted(self.column).asc()


def page(
    df: DataFrame, order: Sequence[Key], limit: int, offset: int, direct_rows: int = DIRECT_ROWS
) -> DataFrame:
    """``limit`` rows from ``offset`` on, in the given order, which must not tie.

    Near the start, each task keeps ``offset + limit`` rows and the driver merges them. Deep pages
    are found without sorting: rows are counted in up to 1024 equal ranges of the first sort column
    (texts by the first character in which they differ), the range with the page is split again, and
    so on until few rows stand before the page. Floating-point numbers and decimals of more than 18 digits are cut
    at quantiles instead, 64 at a time, so they need no equal width. A value that alone holds more rows than that is split
    by the next column. Only columns of other types, such as arrays, are sorted whole.
    """
    if offset + limit > direct_rows:
        return _deep_page(df, list(order), limit, offset, direct_rows)
    return df.orderBy(*[k.order() for k in order]).offset(offset).limit(limit)


def _rank(df: DataFrame, column: str) -> Column | None:
    """A sort column in a form that can be split into ranges: a whole number, or plain text."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(quoted(column).cast("timestamp"))
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(quoted(column))
    if isinstance(kind, T.IntegralType):
        return quoted(column).cast("bigint")
    if isinstance(kind, T.DateType):
        return F.unix_date(quoted(column)).cast("bigint")
    if isinstance(kind, T.BooleanType):
        return quoted(column).cast("bigint")
    if isinstance(kind, T.DecimalType) and kind.precision <= 18:
        return (quoted(column) * F.lit(Decimal(10**kind.scale))).cast("bigint")
    if kind.simpleString() == "string":
        return quoted(column)
    return None


def _is_split_by_value(kind: T.DataType) -> bool:
    return isinstance(kind, (T.FractionalType, T.DecimalType))


def _counted(rows: DataFrame, bucket: Column) -> list:
    return rows.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()


def _split_numbers(
    rows: DataFrame, column: str, rank: Column, low: int, high: int
) -> tuple[list, Callable[[list], DataFrame]]:
    """Counts of up to 1025 equal ranges, ascending, and the rows of neighbouring ones.

    Ranges are compared in the column's own type, so that scans skip.
    """
    width = -(-(high - low + 1) // BUCKETS)
    kind = rows.schema[column].dataType
    # A division of doubles would lose digits of large keys.
    bucket = F.floor((rank.cast("decimal(20,0)") - F.lit(low)) / F.lit(width).cast("decimal(20,0)")).cast("bigint")

    def bound(value: int) -> Column:
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.timestamp_micros(F.lit(value)).cast(kind)
        if isinstance(kind, T.DateType):
            return F.date_from_unix_date(F.lit(value))
        if isinstance(kind, T.DecimalType):
            return F.lit(Decimal(value).scaleb(-kind.scale)).cast(kind)
        return F.lit(value).cast(kind)

    def select(buckets: list) -> DataFrame:
        values = [c.b for c in buckets]
        first, last = low + min(values) * width, min(high, low + (max(values) + 1) * width - 1)
        return rows.where((quoted(column) >= bound(first)) & (quoted(column) <= bound(last)))

    return sorted(_counted(rows, bucket)), select


def _split_texts(rows: DataFrame, column: str, low: str, high: str) -> tuple[list, Callable[[list], DataFrame]]:
    """Counts by the first character in which texts differ, in text order, and the rows of some of them."""
    shared = len(commonprefix([low, high]))
    head = F.substring(quoted(column), 1, shared + 1)

    def select(buckets: list) -> DataFrame:
        if len(buckets) == 1 and len(buckets[0].b) > shared:
            return rows.where(quoted(column).startswith(buckets[0].b))
        return rows.where(head.isin([c.b for c in buckets]))

    return sorted(_counted(rows, head), key=lambda c: c.b.encode()), select


def _split_values(rows: DataFrame, column: str) -> tuple[list, Callable[[list], DataFrame]]:
    """Counts between and at quantiles, ascending, and the rows of neighbouring ones.

    Quantiles are values of the column, found by a sketch; that they are rough does not matter, as counts are exact.
    Each stands for itself, so a value that is very frequent ends up alone.
    """
    kind, value = rows.schema[column].dataType, quoted(column)
    found = rows.agg(F.percentile_approx(value, [i / QUANTILES for i in range(QUANTILES + 1)], 10_000)).first()[0]
    bounds = sorted(set(found))
    literals = [F.lit(b).cast(kind) for b in bounds]
    every = F.array(*literals)
    below = F.size(F.filter(every, lambda b: b < value))
    bucket = (below * 2 + F.exists(every, lambda b: b == value).cast("int")).cast("bigint")

    def select(buckets: list) -> DataFrame:
        first, last = min(c.b for c in buckets), max(c.b for c in buckets)
        low, high = (first - 1) // 2, last // 2  # odd ones are bounds, even ones lie between two
        wanted = F.lit(True)
        if low >= 0:
            wanted = wanted & (value >= literals[low] if first % 2 else value > literals[low])
        if high < len(bounds):
            wanted = wanted & (value <= literals[high] if last % 2 else value < literals[high])
        return rows.where(wanted)

    return sorted(_counted(rows, bucket)), select


def _deep_page(df: DataFrame, order: list[Key], limit: int, offset: int, direct_rows: int) -> DataFrame:
    first, rest = order[0], order[1:]
    sort = [k.order() for k in order]
    kind, rank = df.schema[first.column].dataType, _rank(df, first.column)
    by_value = rank is None and _is_split_by_value(kind)
    if rank is None and not by_value:
        return df.orderBy(*sort).offset(offset).limit(limit)
    own = quoted(first.column)
    odd = F.isnan(own) if isinstance(kind, (T.DoubleType, T.FloatType)) else F.lit(False)  # greater than all numbers
    rank = own if rank is None else rank
    low, high, count, present, nans = df.agg(
        F.min(F.when(~odd, rank)), F.max(F.when(~odd, rank)), F.count(F.lit(1)), F.count(own), F.count_if(odd)
    ).first()
    if offset >= count:
        return df.limit(0)
    if nans == count or (low == high and present in (0, count) and not nans):
        # One value holds more rows than can be skipped directly: go on with the next column.
        if rest:
            return page(df, rest, limit, offset, direct_rows)
        return df.orderBy(*sort).offset(offset).limit(limit)
    if present < count:
        # NULLs stand first, or last in descending order.
        split = [Row(b=True, n=count - present), Row(b=False, n=present)]

        def select(buckets: list) -> DataFrame:
            return df.where(own.isNull().isin([c.b for c in buckets]))
    elif nans:
        split = [Row(b=False, n=count - nans), Row(b=True, n=nans)]

        def select(buckets: list) -> DataFrame:
            return df.where(odd.isin([c.b for c in buckets]))
    elif by_value:
        split, select = _split_values(df, first.column)
    elif isinstance(low, str):
        split, select = _split_texts(df, first.column, low, high)
    else:
        split, select = _split_numbers(df, first.column, rank, low, high)

    if first.descending:
        split.reverse()
    while split[0].n <= offset:
        offset -= split.pop(0).n
    seen, needed = 0, []
    while split and seen < offset + limit:
        seen += split[0].n
        needed.append(split.pop(0))
    if offset + limit > direct_rows and len(needed) > 1:
        # The page starts deep inside one range and runs into the next ones: two pages.
        size = needed[0].n - offset
        both = page(select(needed[:1]), order, size, offset, direct_rows).unionByName(
            page(select(needed[1:]), order, limit - size, 0, direct_rows)
        )
        return both.orderBy(*sort).limit(limit)
    return page(select(needed), order, limit, offset, direct_rows)


def table_page(
    df: DataFrame, tie: Sequence[str], limit: object = None, offset: object = None, columns: Sequence[ColumnSpec] = ()
) -> DataFrame:
    """A page of a single source, in the order of its ``tie`` (key) columns."""
    size, start = page_arguments(limit, offset)
    return column_view(page(df, [Key(c) for c in tie], size, start), columns)


def tiered_page(
    tiers: Sequence[Tier],
    now: datetime,
    tie: Sequence[str],
    limit: object = None,
    offset: object = None,
    direct_rows: int = DIRECT_ROWS,
) -> DataFrame:
    """A page of the view, newest first across all tiers.

    Windows are disjoint in time and tiers are ranked by age, so ordering by time alone walks the
    tiers youngest to oldest. ``tie`` names shown columns that tell rows of one instant apart.
    """
    size, start = page_arguments(limit, offset)
    rows = tiered_rows(tiers, now)
    order = [Key("_ts", descending=True)] if len(tiers) > 1 else []
    return page(rows, order + [Key(c) for c in tie], size, start, direct_rows).drop("_tier", "_ts")


def page_summary(tiers: Sequence[Tier], now: datetime, limit: object = None, offset: object = None) -> DataFrame:
    """One row: total over all tiers, the page arguments in use, and which rows the page shows."""
    size, start = page_arguments(limit, offset)
    return (
        tier_counts(tiers, now)
        .agg(F.sum("rows").alias("total"))
        .select(
            "total",
            F.lit(size).cast("bigint").alias("limit"),
            F.lit(start).cast("bigint").alias("offset"),
            F.lit(len(tiers) > 1).alias("tiered"),
            F.lit(start + 1).cast("bigint").alias("first_row"),
            F.least(F.lit(start + size).cast("bigint"), F.col("total")).alias("last_row"),
        )
    )
