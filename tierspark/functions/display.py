"""Columns as callers see them: bytes as text, values as key texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions.names import quoted
from tierspark.functions.payloads import double_text


def binary_to_string(df: DataFrame) -> DataFrame:
    """Every binary column as text; bytes that are not UTF-8 become the replacement character."""
    return df.select(
        *[
            F.make_valid_utf8(quoted(f.name).cast("string")).alias(f.name)
            if isinstance(f.dataType, T.BinaryType)
            else quoted(f.name)
            for f in df.schema
        ]
    )


def key_text(df: DataFrame, column: str) -> Column:
    """A typed value as text: RFC 3339 for instants, plain numbers, ``true`` and ``false``."""
    kind, value = df.schema[column].dataType, quoted(column)
    if isinstance(kind, T.TimestampType):
        # The instant's digits in UTC, whatever the session's zone.
        seconds = (F.unix_micros(value).cast("decimal(18,0)") / F.lit(1_000_000)).cast("decimal(18,6)")
        zero = F.lit(0)
        value = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz") + F.make_dt_interval(zero, zero, zero, seconds)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        # No fraction is written for whole seconds; otherwise three or six digits.
        text = value.cast("string")
        micros = F.rpad(F.when(F.contains(text, F.lit(".")), F.substring_index(text, ".", -1)).otherwise(F.lit("")), 6, "0")
        fraction = (
            F.when(micros == "000000", F.lit(""))
            .when(micros.endswith("000"), F.concat(F.lit("."), F.substring(micros, 1, 3)))
            .otherwise(F.concat(F.lit("."), micros))
        )
        whole = F.replace(F.substring_index(text, ".", 1), F.lit(" "), F.lit("T"))
        return F.concat(whole, fraction, F.lit("+00:00"))
    if isinstance(kind, T.DoubleType):
        return F.regexp_replace(double_text(value), r"\.0$", "")
    return value.cast("string")
