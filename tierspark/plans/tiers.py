"""Tiered reads: recent rows from one source, older rows from others, as one table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.functions.ages import parse_age, whole_seconds
from tierspark.functions.names import quoted
from tierspark.functions.times import in_utc, instant_literal, time_type
from tierspark.operators.views import ColumnSpec, column_view, output_pairs
from tierspark.sources.stores import read_footers

TIME_RANGE = "timeRange"


@dataclass(frozen=True)
class Tier:
    """One source of a view and the ages of the rows it answers for: ``min_age <= age < max_age``.

    ``ts`` is the source's own time column; it need not be among the shown ``columns``. ``day`` names
    a date column that holds the day of ``ts``, typically the partition column of a lake table, so
    that whole partitions outside the window are skipped. ``lake`` is the location of ``rows`` if they are a
    whole lake with such partitions: totals then read whole days from the files' statistics.
    """

    name: str
    rows: DataFrame = field(repr=False)
    columns: Sequence[ColumnSpec]
    ts: str | None = None
    min_age: str | None = None
    max_age: str | None = None
    routing: str = TIME_RANGE
    day: str | None = None
    lake: str | None = None

    @property
    def routed(self) -> bool:
        return bool(self.ts or self.min_age or self.max_age)

    @property
    def shown(self) -> list[str]:
        return [name for _, name in output_pairs(self.columns)]

    def bounds(self, now: datetime) -> tuple[datetime | None, datetime | None]:
        """The window as ``(after, before]`` instants; ages count in whole seconds."""

        def back(age: str | None) -> datetime | None:
            return None if not age else in_utc(now) - timedelta(seconds=whole_seconds(parse_age(age)))

        return back(self.max_age), back(self.min_age)


def window_condition(
    df: DataFrame, ts: str, after: datetime | None, before: datetime | None, day: str | None = None
) -> Column | None:
    """``after < ts <= before`` with literal bounds; None without bounds. A NULL time is outside any bound."""
    kind = time_type(df, ts)
    parts = []
    if after is not None:
        parts.append(quoted(ts) > instant_literal(after, kind))
        if day:
            parts.append(quoted(day) >= F.lit(in_utc(after).date()))
    if before is not None:
        parts.append(quoted(ts) <= instant_literal(before, kind))
        if day:
            parts.append(quoted(day) <= F.lit(in_utc(before).date()))
    return reduce(lambda a, b: a & b, parts) if parts else None


def time_range(
    df: DataFrame, ts: str, after: datetime | None = None, before: datetime | None = None, day: str | None = None
) -> DataFrame:
    """The rows with ``after < ts <= before``; all rows without bounds."""
    condition = window_condition(df, ts, after, before, day)
    return df if condition is None else df.where(condition)


def age_window(
    df: DataFrame, ts: str, now: datetime, min_age: str | None = None, max_age: str | None = None
) -> DataFrame:
    """The rows whose age at ``now`` is at least ``min_age`` and less than ``max_age``."""
    return time_range(df, ts, *Tier("", df, (), ts, min_age, max_age).bounds(now))


def ordered_tiers(tiers: Sequence[Tier]) -> list[Tier]:
    """The tiers youngest first, after checking that they form one consistent view.

    A single source is read whole, without routing. Several sources must be distinct, show the same
    columns in the same order and types, and their windows must cover all of time once: no lower
    bound on the youngest, no upper bound on the oldest, and each upper bound the next lower bound.
    """
    if not tiers:
        raise ValueError("a view needs at least one source")
    names = [t.name for t in tiers]
    if len(set(names)) != len(names):
        raise ValueError("a source is named twice")
    for tier in tiers:
        if tier.lake and not tier.day:
            raise ValueError("the files of a lake tell totals by its day column only")
        if not tier.columns:
            raise ValueError(f"source {tier.name!r}: at least one column is required")
        output_pairs(tier.columns)
    if len(tiers) == 1:
        if tiers[0].routed:
            raise ValueError("a single source takes no routing")
        return list(tiers)

    ages = {}
    for tier in tiers:
        if tier.routing != TIME_RANGE:
            raise ValueError(f"source {tier.name!r}: unsupported routing type {tier.routing!r}")
        if not tier.ts:
            raise ValueError(f"source {tier.name!r}: a time column is required")
        low = parse_age(tier.min_age) if tier.min_age else None
        high = parse_age(tier.max_age) if tier.max_age else None
        if high is not None and (low or 0) >= high:
            raise ValueError(f"source {tier.name!r}: the minimum age must be less than the maximum age")
        ages[tier.name] = (low, high)
    ordered = sorted(tiers, key=lambda t: ages[t.name][0] or 0)
    if ages[ordered[0].name][0] is not None:
        raise ValueError(f"source {ordered[0].name!r} is the youngest and takes no minimum age")
    if ages[ordered[-1].name][1] is not None:
        raise ValueError(f"source {ordered[-1].name!r} is the oldest and takes no maximum age")
    for young, old in zip(ordered, ordered[1:]):
        if ages[young.name][1] is None or ages[young.name][1] != ages[old.name][0]:
            raise ValueError(f"the windows of {young.name!r} and {old.name!r} leave a gap or overlap")

    first = ordered[0]
    for tier in ordered[1:]:
        if tier.shown != first.shown:
            raise ValueError(f"source {tier.name!r} shows {tier.shown}, want {first.shown}")
    shape = _shape(first)
    for tier in ordered[1:]:
        if _shape(tier) != shape:
            raise ValueError(f"source {tier.name!r} shows {_shape(tier)}, want {shape}")
    if len({time_type(t.rows, t.ts) for t in ordered}) > 1:
        raise ValueError("the sources have different types of time column")
    return ordered


def _shape(tier: Tier) -> list[tuple[str, str]]:
    return [(f.name, f.dataType.simpleString()) for f in column_view(tier.rows, tier.columns).schema]


def _in_window(tier: Tier, now: datetime) -> DataFrame:
    return time_range(tier.rows, tier.ts, *tier.bounds(now), tier.day) if tier.ts else tier.rows


def tiered_rows(tiers: Sequence[Tier], now: datetime) -> DataFrame:
    """All rows of the view, with ``_tier`` (0 is the youngest) and ``_ts``.

    ``now`` is one literal for all tiers, so the windows fit together and reach every scan.
    """

    def part(rank: int, tier: Tier) -> DataFrame:
        rows = _in_window(tier, now)
        ts = quoted(tier.ts) if tier.ts else F.lit(None).cast("timestamp")
        return rows.select(
            *[quoted(source).alias(name) for source, name in output_pairs(tier.columns)],
            F.lit(rank).alias("_tier"),
            ts.alias("_ts"),
        )

    ordered = ordered_tiers(tiers)
    for tier in ordered:
        column_view(tier.rows, tier.columns)
    return reduce(DataFrame.unionByName, [part(i, t) for i, t in enumerate(ordered)])


def tiered_read(tiers: Sequence[Tier], now: datetime) -> DataFrame:
    """All rows of the view; each row comes from the one tier whose window holds its age."""
    return tiered_rows(tiers, now).drop("_tier", "_ts")


def _count(tier: Tier, now: datetime) -> DataFrame:
    """The number of a tier's rows in its window, as one row.

    In a lake by days only the days into which the window's ends fall are scanned. Days wholly inside are
    counted by the row numbers in the files' footers.
    """
    number = F.count(F.lit(1)).alias("rows")
    if not tier.lake:
        return _in_window(tier, now).agg(number)
    footers = read_footers(tier.rows.sparkSession, tier.lake)
    ends = [(in_utc(end).date() if end else None) for end in (tier.bounds(now) if tier.ts else (None, None))]
    after, before = ends
    if after is None and before is None:
        return footers.agg(number)
    day = quoted(tier.day)
    whole = footers if after is None else footers.where(day > F.lit(after))
    whole = whole if before is None else whole.where(day < F.lit(before))
    edges = _in_window(tier, now).where(day.isin([end for end in ends if end]))
    return whole.agg(number).unionByName(edges.agg(number)).agg(F.sum("rows").alias("rows"))


def tier_counts(tiers: Sequence[Tier], now: datetime) -> DataFrame:
    """Rows per tier, ``(tier, rows)``, empty tiers included; one job that reads only time columns, or less: :func:`_count`."""
    parts = [_count(tier, now).select(F.lit(tier.name).alias("tier"), "rows") for tier in ordered_tiers(tiers)]
    return reduce(DataFrame.unionByName, parts)


def tier_coverage(tiers: Sequence[Tier], now: datetime) -> DataFrame:
    """Per tier: rows it answers, rows it holds outside its window, and rows no view shows for want of a time."""
    parts = []
    for tier in ordered_tiers(tiers):
        if not tier.ts:
            raise ValueError("coverage needs several tiers")
        inside = window_condition(tier.rows, tier.ts, *tier.bounds(now))
        parts.append(
            tier.rows.agg(
                F.count_if(inside).alias("in_window"),
                F.count_if(~inside).alias("outside_window"),
                F.count_if(quoted(tier.ts).isNull()).alias("without_time"),
            ).select(F.lit(tier.name).alias("tier"), "in_window", "outside_window", "without_time")
        )
    return reduce(DataFrame.unionByName, parts)
