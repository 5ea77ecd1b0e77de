"""A tiered view by name: a SQL table function whose argument is the instant it is read at."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from tierspark.functions.ages import parse_age, whole_seconds
from tierspark.functions.times import in_utc, time_type
from tierspark.operators.views import column_view, output_pairs
from tierspark.plans.tiers import Tier, ordered_tiers

_INSTANT = "at"


def _name(text: str) -> str:
    return "`" + text.replace("`", "``") + "`"


def _bound(kind: T.DataType, age: str, function: str) -> str:
    """The instant minus an age, in the type of a time column; Spark folds it to a literal."""
    at = f"{_name(function)}.{_name(_INSTANT)}"
    if isinstance(kind, T.TimestampNTZType):  # its digits in UTC, whatever the session's zone
        at = f"(TIMESTAMP_NTZ'1970-01-01 00:00:00' + make_dt_interval(0, 0, 0, CAST(CAST(unix_micros({at}) AS DECIMAL(20, 0)) / 1000000 AS DECIMAL(18, 6))))"
    return f"({at} - make_dt_interval(0, 0, 0, {whole_seconds(parse_age(age))}))"


def _window(tier: Tier, function: str) -> str:
    if not tier.ts:
        return ""
    kind, conditions = time_type(tier.rows, tier.ts), []
    for age, sign, day_sign in ((tier.max_age, ">", ">="), (tier.min_age, "<=", "<=")):
        if age:
            bound = _bound(kind, age, function)
            conditions.append(f"{_name(tier.ts)} {sign} {bound}")
            if tier.day:
                utc = bound if isinstance(kind, T.TimestampNTZType) else _bound(T.TimestampNTZType(), age, function)
                conditions.append(f"{_name(tier.day)} {day_sign} CAST({utc} AS DATE)")
    return " WHERE " + " AND ".join(conditions) if conditions else ""


def create_view_function(spark: SparkSession, name: str, tiers: Sequence[Tier]) -> None:
    """Let the session's SQL read a view as ``SELECT ... FROM name(<instant>)``.

    Each row comes from the one tier whose window holds its age at the instant. With a literal instant the
    windows are literals, too, and reach every scan, as those of :func:`tierspark.plans.tiers.tiered_read` do. The
    function, and a temporary view per tier named ``name_tier_<n>``, last as long as the session; a second call replaces them.
    """
    ordered, parts = ordered_tiers(tiers), []
    for number, tier in enumerate(ordered):
        source = f"{name}_tier_{number}"
        tier.rows.createOrReplaceTempView(_name(source))
        shown = ", ".join(_name(column) for column, _ in output_pairs(tier.columns)) or "*"
        parts.append(f"SELECT {shown} FROM {_name(source)}{_window(tier, name)}")
    fields = column_view(ordered[0].rows, ordered[0].columns).schema
    columns = ", ".join(f"{_name(f.name)} {f.dataType.simpleString()}" for f in fields)
    spark.sql(
        f"CREATE OR REPLACE TEMPORARY FUNCTION {_name(name)}({_name(_INSTANT)} TIMESTAMP) "
        f"RETURNS TABLE ({columns}) RETURN " + " UNION ALL ".join(parts)
    )


def read_view(spark: SparkSession, name: str, now: datetime, select: str = "*") -> DataFrame:
    """``SELECT select FROM name(now)``; a naive instant is taken as UTC."""
    instant = in_utc(now).strftime("%Y-%m-%d %H:%M:%S.%fZ")
    return spark.sql(f"SELECT {select} FROM {_name(name)}(TIMESTAMP'{instant}')")
