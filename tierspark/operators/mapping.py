"""Raw messages to typed rows, with a reason for every message that does not qualify."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tierspark.functions import payloads
from tierspark.functions.names import quoted

MALFORMED = "malformed JSON"

# Where a message came from; carried through so that later steps can order and report rows.
POSITION = ("_topic", "_partition", "_offset", "_timestamp")


@dataclass(frozen=True)
class Field:
    path: str
    column: str
    type: str


@dataclass(frozen=True)
class Mapping:
    """The columns of a table, in order, each with the JSON path and the type it is read as."""

    key: str
    fields: tuple[Field, ...]

    def __init__(self, key: str, fields: Sequence[Field | tuple[str, str, str]]):
        object.__setattr__(self, "key", key)
        object.__setattr__(self, "fields", tuple(f if isinstance(f, Field) else Field(*f) for f in fields))
        if not self.fields:
            raise ValueError("a mapping needs at least one field")
        if any(not (f.path and f.column and f.type) for f in self.fields):
            raise ValueError("path, column and type are all required")
        names = self.columns
        if len(set(names)) != len(names):
            raise ValueError("a column is mapped twice")
        if any(n.startswith("_") or n == "reject_reason" for n in names):
            raise ValueError("mapped columns may not start with _ or be named reject_reason")
        if key not in names:
            raise ValueError(f"key {key!r} is not a mapped column")

    @property
    def columns(self) -> list[str]:
        return [f.column for f in self.fields]

    @property
    def schema(self) -> T.StructType:
        """The table's schema; every column may be NULL."""
        return T.StructType(
            [T.StructField(f.column, payloads.spark_type(f.type), True) for f in self.fields]
        )


def map_messages(messages: DataFrame, mapping: Mapping) -> DataFrame:
    """One row per message: mapped columns, position, raw payload and ``reject_reason``.

    ``messages`` has ``value`` and may have ``topic``, ``partition``, ``offset`` and ``timestamp``. A message is
    rejected as a whole if its payload is not one JSON document, or if any field is missing or of the
    wrong kind; the first such field in mapping order is the reason. Accepted and rejected rows come
    out of one parse: see :func:`accepted` and :func:`rejected`.

    The steps are separate projections because each uses the result of the one before several times.
    The partition id keeps a later filter on the reason from being copied, with all that leads to it,
    below these projections: a projection that depends on the task is not moved.
    """
    messages.sparkSession.conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    position = [name.removeprefix("_") for name in POSITION if name.removeprefix("_") in messages.columns]
    carried = [f"_{c}" for c in position] + ["_value"]
    ids = range(len(mapping.fields))

    parsed = messages.select(
        *[F.col(c).alias(f"_{c}") for c in position],
        F.col("value").alias("_value"),
        payloads.parse_document(F.col("value")).alias("_doc"),
    )
    located = parsed.select(
        *carried,
        payloads.is_document(F.col("_doc"), F.col("_value")).alias("_whole"),
        *[payloads.field_at(F.col("_doc"), f.path).alias(f"_field{i}") for i, f in enumerate(mapping.fields)],
    )
    kinds = located.select("*", *[payloads.kind_of(F.col(f"_field{i}")).alias(f"_kind{i}") for i in ids])
    typed = kinds.select(
        *carried,
        (F.col("_whole") & (F.spark_partition_id() >= 0)).alias("_whole"),
        *[F.col(f"_field{i}").isNull().alias(f"_missing{i}") for i in ids],
        *[
            payloads.coerce(F.col(f"_field{i}"), F.col(f"_kind{i}"), f.type).alias(f.column)
            for i, f in enumerate(mapping.fields)
        ],
    )
    faults = [F.when(~F.col("_whole"), F.lit(MALFORMED))]
    for i, f in enumerate(mapping.fields):
        fault = F.when(F.col(f"_missing{i}"), F.lit(f"{f.column}: path {f.path} not found"))
        faults.append(F.when(quoted(f.column).isNull(), fault.otherwise(F.lit(f"{f.column}: not a {f.type}"))))
    return typed.select(
        *[quoted(c) for c in mapping.columns], *carried, F.coalesce(*faults).alias("reject_reason")
    )


def accepted(mapped: DataFrame, mapping: Mapping) -> DataFrame:
    """The typed rows with their position."""
    position = [c for c in POSITION if c in mapped.columns]
    return mapped.where(F.col("reject_reason").isNull()).select(*[quoted(c) for c in mapping.columns], *position)


def rejected(mapped: DataFrame) -> DataFrame:
    """Position, raw payload and reason of the messages that did not qualify."""
    kept = [c for c in (*POSITION, "_value", "reject_reason") if c in mapped.columns]
    return mapped.where(F.col("reject_reason").isNotNull()).select(*kept)


def reject_counts(mapped: DataFrame) -> DataFrame:
    """Messages per reason."""
    return (
        mapped.where(F.col("reject_reason").isNotNull())
        .groupBy("reject_reason")
        .agg(F.count(F.lit(1)).alias("messages"))
    )
