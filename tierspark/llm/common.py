"""Small helpers that the operators of this package share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspark.session import shared_folder, written

__all__ = ["arrow_map", "bounded", "pick", "shared_folder", "sliced", "stored", "table", "written"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Columns by their exact names, as ``new=old``, whatever else the table holds.

    Spark ignores case when it looks a name up, so a second column that differs only in case, or not at
    all, would make the name ambiguous. Columns are therefore renumbered first; the first of equals wins.
    """
    places = {name: df.columns.index(old) if old in df.columns else -1 for name, old in columns.items()}
    missing = [columns[name] for name, place in places.items() if place < 0]
    if missing:
        raise ValueError(f"columns not found: {missing}")
    bounded(df.sparkSession)
    numbered = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
    return numbered.select(*[F.col(f"_{place}").alias(name) for name, place in places.items()])


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """``df`` written to the shared folder and read again, so that losing an executor does not undo it.

    Files cannot hold columns whose names differ in case only; there, and so only there, columns have numbers.
    """
    names, folder = df.columns, shared_folder(df.sparkSession, purpose)
    if len({name.lower() for name in names}) == len(names):
        return written(df, folder)
    return written(df.toDF(*[f"_{i}" for i in range(len(names))]), folder).toDF(*names)


# Bytes of text that are worked on at once, and rows that Spark hands to Python at once: whole texts are
# long, and Spark's own limit of 10 000 rows would hold tens of megabytes on both sides of each task.
SLICE = 4 << 20
ROWS_AT_ONCE = 1024


def bounded(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to :data:`ROWS_AT_ONCE`; a smaller one of the user's stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= ROWS_AT_ONCE:
        spark.conf.set(name, str(ROWS_AT_ONCE))


def sliced(batches: Iterable[pa.RecordBatch], text: int) -> Iterator[pa.RecordBatch]:
    """The rows of all batches in slices of about 4 MB of the text column at ``text``, which bounds what a task holds."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
        first = 0
        while first < len(batch):
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + SLICE, "right")))
            yield batch.slice(first, last - first)
            first = last


def arrow_map(
    df: DataFrame, each: Callable[[list[list]], list[list]], schema: str
) -> DataFrame:
    """``mapInArrow`` over plain Python lists: ``each`` gets the columns of a batch and returns those of the result."""
    from pyspark.sql.types import _parse_datatype_string  # the parser behind schema strings
    from pyspark.sql.pandas.types import to_arrow_schema

    target = to_arrow_schema(_parse_datatype_string(schema))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = each([column.to_pylist() for column in batch.columns])
            yield pa.RecordBatch.from_arrays(
                [pa.array(values, type=field.type) for values, field in zip(columns, target)], schema=target
            )

    return df.mapInArrow(run, schema)
