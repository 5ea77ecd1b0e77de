"""Literals for comparing a time column with an instant."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def in_utc(instant: datetime) -> datetime:
    """A naive instant is taken as UTC."""
    if instant.tzinfo is None:
        return instant.replace(tzinfo=timezone.utc)
    return instant.astimezone(timezone.utc)


def time_type(df: DataFrame, column: str) -> T.DataType:
    """The type of a time column; other types are refused rather than cast row by row."""
    kind = df.schema[column].dataType
    if not isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"column {column!r} has type {kind.simpleString()}, want a timestamp")
    return kind


def instant_literal(instant: datetime, kind: T.DataType) -> Column:
    """A foldable literal of the column's own type, so that the comparison reaches the scan."""
    text = in_utc(instant).strftime("%Y-%m-%d %H:%M:%S.%f")
    if isinstance(kind, T.TimestampType):
        text += "Z"
    return F.lit(text).cast(kind)


def utc_day(df: DataFrame, column: str) -> Column:
    """The day of a time column in UTC, whatever the session's zone."""
    if isinstance(time_type(df, column), T.TimestampNTZType):
        return F.to_date(F.col(column))
    days = F.floor(F.unix_micros(column) / F.lit(86_400_000_000).cast("decimal(20,0)")).cast("int")
    return F.date_add(F.lit("1970-01-01").cast("date"), days)
