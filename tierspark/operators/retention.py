"""Removal of old rows."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.functions.names import quoted
from tierspark.functions.times import instant_literal, time_type


def expired(df: DataFrame, ts: str, days: int, now: datetime) -> Column:
    """Whether a row is older than ``days`` days; NULL without a time."""
    if days <= 0:
        raise ValueError("days must be positive")
    return quoted(ts) < instant_literal(now - timedelta(days=days), time_type(df, ts))


def prune(df: DataFrame, ts: str, days: int, now: datetime) -> DataFrame:
    """The rows that stay: not older than ``days`` days, or without a time."""
    return df.where(~expired(df, ts, days, now) | quoted(ts).isNull())


def pruned_count(df: DataFrame, ts: str, days: int, now: datetime) -> DataFrame:
    """How many rows :func:`prune` removes."""
    return df.where(expired(df, ts, days, now)).agg(F.count(F.lit(1)).alias("pruned"))
