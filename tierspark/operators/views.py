"""Column views: pick, order and rename."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.functions.names import quoted

# One output column: its name in the source, optionally with the name it is shown under.
ColumnSpec = str | tuple[str, str]


def output_pairs(columns: Sequence[ColumnSpec]) -> list[tuple[str, str]]:
    """``(source, shown as)`` pairs; refuses the same output name twice."""
    pairs = [(c, c) if isinstance(c, str) else (c[0], c[1] or c[0]) for c in columns]
    seen: set[str] = set()
    for _, name in pairs:
        if name in seen:
            raise ValueError(f"column {name!r} is a duplicate among the shown columns")
        seen.add(name)
    return pairs


def column_view(df: DataFrame, columns: Sequence[ColumnSpec] = ()) -> DataFrame:
    """The named columns under their shown names, in the given order; all columns if none are named."""
    if not columns:
        return df
    pairs = output_pairs(columns)
    for source, _ in pairs:
        if source not in df.columns:
            raise ValueError(f"column {source!r} not found")
    return df.select(*[quoted(source).alias(name) for source, name in pairs])


def describe_result(df: DataFrame) -> DataFrame:
    """A result's column list with its total: one row ``(ordinal, name, type, total)`` per column."""
    if not df.columns:
        raise ValueError("table not found")
    header = F.array(
        *[
            F.struct(
                F.lit(i).cast("bigint").alias("ordinal"),
                F.lit(f.name).alias("name"),
                F.lit(f.dataType.simpleString()).alias("type"),
            )
            for i, f in enumerate(df.schema, start=1)
        ]
    )
    return (
        df.agg(F.count(F.lit(1)).alias("total"))
        .select(F.explode(header).alias("column"), "total")
        .select("column.*", "total")
    )
