"""Exact deduplication with a Golomb-coded fingerprint exchange.

1. Every task of the scan fingerprints its texts (64 bits) and sends each owner, a range of the fingerprints,
   its distinct ones: sorted, as gaps in Golomb code.
2. An owner decodes its lists and answers each with a bitmap: which of its fingerprints others sent as well.
3. A task's rows meet the bitmaps for it. Fingerprints that are marked, or occur twice in the task itself,
   are suspects; everything else is unique and needs no text.
4. Only suspects' texts are moved: grouping by the text itself compares byte by byte. Copies are reduced
   within each task first, so a text that a third of all rows share sends one row per task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierspark.llm.bitset import mark_held
from tierspark.llm.common import pick, shared_folder, stored

# Rows of a task that are sent together, and fingerprints an owner gets on average, at most.
RUN = 1 << 17
PER_OWNER = 1 << 20
LEAST_OWNERS = 64
HEADER = np.dtype([("n", "<i8"), ("unary_bits", "<i8"), ("remainder_bits", "<i8")])


def golomb(values: np.ndarray, low: int, span: int) -> bytes:
    """Sorted distinct numbers from ``low`` on, within ``span``, as gaps: quotients in unary, remainders in binary.

    The divisor is the power of two next below the mean gap (a Rice code, Golomb's code for such divisors).
    """
    if not len(values):
        return np.zeros(1, HEADER).tobytes()
    width = max(0, (span // len(values)).bit_length() - 1)
    gaps = np.diff(values, prepend=np.uint64(low))
    quotients = (gaps >> np.uint64(width)).astype(np.int64)
    ends = np.cumsum(quotients + 1)
    unary = np.zeros(int(ends[-1]), np.uint8)
    unary[ends - 1] = 1
    bits = np.unpackbits(gaps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")[:, :width]
    header = np.array([(len(values), len(unary), width)], HEADER)
    return header.tobytes() + np.packbits(unary).tobytes() + np.packbits(bits).tobytes()


def from_golomb(code: bytes, low: int) -> np.ndarray:
    """The numbers of :func:`golomb`."""
    n, length, width = (int(v) for v in np.frombuffer(code, HEADER, 1)[0])
    if not n:
        return np.zeros(0, np.uint64)
    at = HEADER.itemsize + -(-length // 8)
    unary = np.unpackbits(np.frombuffer(code[HEADER.itemsize : at], np.uint8), count=length)
    quotients = np.diff(np.flatnonzero(unary), prepend=-1) - 1
    bits = np.zeros((n, 64), np.uint8)
    if width:
        bits[:, :width] = np.unpackbits(np.frombuffer(code[at:], np.uint8), count=n * width).reshape(n, width)
    remainders = np.packbits(bits, axis=1, bitorder="little").view("<u8").ravel()
    gaps = (quotients.astype(np.uint64) << np.uint64(width)) | remainders
    return np.uint64(low) + np.cumsum(gaps, dtype=np.uint64)


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; NULL as the empty text."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+", " ")


def _send(rows: DataFrame, owner_bits: int, key_type: pa.DataType) -> DataFrame:
    """Per row its fingerprint and digest (``kind`` 0), and per run and owner a coded list (``kind`` 1)."""
    shift, span = np.uint64(64 - owner_bits), 1 << (64 - owner_bits)
    kinds = [("kind", pa.int32()), ("part", pa.int64()), ("owner", pa.int64()), ("_key", key_type)]
    target = pa.schema([*kinds, ("fp", pa.int64()), ("sha", pa.binary()), ("code", pa.binary())])

    def table(n: int, **columns: object) -> pa.RecordBatch:
        filled = [columns.get(f.name) for f in target]
        return pa.RecordBatch.from_arrays(
            [
                pa.nulls(n, f.type) if c is None else c if isinstance(c, pa.Array) else pa.array(c, f.type)
                for c, f in zip(filled, target)
            ],
            schema=target,
        )

    def lists(part: int, found: list[np.ndarray]) -> pa.RecordBatch:
        distinct = np.unique(np.concatenate(found).view(np.uint64))
        owners = (distinct >> shift).astype(np.int64)
        present, first = np.unique(owners, return_index=True)
        codes = [
            golomb(run, owner * span, span) for owner, run in zip(present.tolist(), np.split(distinct, first[1:]))
        ]
        return table(len(codes), kind=[1] * len(codes), part=[part] * len(codes), owner=present, code=codes)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, count = TaskContext.get().partitionId() << 24, [], 0
        for batch in batches:
            for first in range(0, len(batch), RUN):
                rows = batch.slice(first, RUN)
                if held and count + len(rows) > RUN:
                    yield lists(part, held)
                    part, held, count = part + 1, [], 0
                n = len(rows)
                yield table(n, kind=[0] * n, part=[part] * n, _key=rows.column(0), fp=rows.column(1), sha=rows.column(2))
                held.append(rows.column(1).to_numpy())
                count += n
        if held:
            yield lists(part, held)

    key = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"kind int, part bigint, owner bigint, _key {key}, fp bigint, sha binary, code binary"
    )


def _answers(codes: DataFrame, owner_bits: int) -> DataFrame:
    """Per list a bitmap of the fingerprints that another list holds too."""
    span = 1 << (64 - owner_bits)

    def answer(rows: pd.DataFrame) -> pd.DataFrame:
        low = int(rows["owner"].iloc[0]) * span
        found = [from_golomb(code, low) for code in rows["code"]]
        values, counts = np.unique(np.concatenate(found), return_counts=True)
        shared = values[counts > 1]
        marks = []
        for run in found:
            at = np.minimum(np.searchsorted(shared, run), max(0, len(shared) - 1))
            marks.append(np.packbits(shared[at] == run if len(shared) else np.zeros(len(run), bool)).tobytes())
        return pd.DataFrame(
            {"part": rows["part"], "owner": rows["owner"], "n": [len(f) for f in found], "marks": marks}
        )

    return codes.groupBy("owner").applyInPandas(answer, "part bigint, owner bigint, n bigint, marks binary")


def _marked(rows: DataFrame, answers: DataFrame) -> DataFrame:
    """Every row with ``suspect``, from the answers to its task."""

    def mark(rows: pa.Table, answers: pa.Table) -> pa.Table:
        answers = answers.sort_by("owner")
        parts = [
            np.unpackbits(np.frombuffer(m, np.uint8), count=n)
            for m, n in zip(answers["marks"].to_pylist(), answers["n"].to_pylist())
        ]
        own = rows["fp"].to_numpy().view(np.uint64)
        _, places, counts = np.unique(own, return_inverse=True, return_counts=True)
        suspect = (np.concatenate(parts) > 0)[places] | (counts[places] > 1)
        return rows.select(["_key", "fp", "sha"]).append_column("suspect", pa.array(suspect))

    key = rows.schema["_key"].dataType.simpleString()
    return (
        rows.groupBy("part")
        .cogroup(answers.groupBy("part"))
        .applyInArrow(mark, f"_key {key}, fp bigint, sha binary, suspect boolean")
    )


def exact_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, keep_id, group_size, kept, text_sha256)`` for every row of ``docs``.

    Texts are equal if they are so after :func:`normalised`; NULL is the empty text. ``keep_id`` is the
    smallest key among equal texts. Rows that repeat key and text are one document and answered alike. A
    row without a key is kept only if its whole group has none. The key is a whole number or a text.
    """
    rows = pick(docs, _key=key, _text=text).select("_key", normalised(F.col("_text")).alias("_norm"))
    prints = rows.select("_key", F.xxhash64("_norm").alias("fp"), F.unhex(F.sha2("_norm", 256)).alias("sha"))
    owners = max(LEAST_OWNERS, -(-docs.count() // PER_OWNER))
    owner_bits = (owners - 1).bit_length()
    spark = docs.sparkSession
    sent = _send(prints, owner_bits, to_arrow_type(prints.schema["_key"].dataType))
    folder = shared_folder(spark, "fingerprints")
    sent.write.partitionBy("kind").parquet(folder)
    exchanged = spark.read.schema(sent.schema).parquet(folder)
    own = exchanged.where("kind = 0").select("part", "_key", "fp", "sha")
    codes = exchanged.where("kind = 1").select("part", "owner", "code")
    marked = stored(_marked(own, _answers(codes, owner_bits)), "suspects")

    # Only texts that may be suspects are moved; those that pass by chance meet no suspect below.
    suspects = marked.where("suspect")
    near = mark_held(rows.withColumn("fp", F.xxhash64("_norm")), stored(suspects.select("fp").distinct(), "suspects"))
    verified = near.where("_held").groupBy("fp", "_norm").agg(F.min("_key").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    groups = verified.select("fp", F.unhex(F.sha2("_norm", 256)).alias("sha"), "keep_id", "group_size")
    copied = suspects.join(groups, ["fp", "sha"]).select("_key", "keep_id", "group_size", "sha")
    single = marked.where("NOT suspect").select(
        "_key", F.col("_key").alias("keep_id"), F.lit(1).cast("bigint").alias("group_size"), "sha"
    )
    return copied.unionByName(single).select(
        F.col("_key").alias(key),
        "keep_id",
        "group_size",
        F.col("_key").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )
