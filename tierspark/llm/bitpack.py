"""Token ids in files: fixed-width bit packing with block offsets.

Every id takes the fewest bits that hold the vocabulary. A file is a run of *segments*, one row each:

=========== =============================================================================================
shard       number of the file's key range; shards, and segments in them, are in ascending key order
segment     number of the segment in its shard
first       ids of the shard before this segment
n_ids       ids in the segment; documents are never cut between segments
width       bits per id
block       ids per block; a block starts at a byte
offsets     byte at which each block begins
keys        keys of the segment's documents
starts      ids of the segment before each document
payload     the packed blocks, lowest bits first
=========== =============================================================================================

Rows lie in Parquet files, which every store Spark writes to can hold, and whose statistics on
``shard, segment, first`` let a reader skip. One id is found by its block's offset alone.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tierspark.llm.bpe_trie import encoder
from tierspark.llm.common import pick, shared_folder, sliced, stored

BLOCK = 4096
SEGMENT = 1 << 18
DOCS_PER_SHARD = 1 << 14
# A shard has more distinct pieces than a worker remembers; their words are kept from one shard to the next.
KEPT_WORDS = 600_000

COLUMNS = (
    "shard int, segment int, first bigint, n_ids bigint, width int, block int, "
    "offsets array<bigint>, keys array<bigint>, starts array<bigint>, payload binary"
)


def width_of(vocabulary_size: int) -> int:
    """Bits that hold every id of a vocabulary."""
    return max(1, int(vocabulary_size - 1).bit_length())


def packed(ids: np.ndarray, width: int, block: int = BLOCK) -> tuple[bytes, list[int]]:
    """Ids as blocks of ``width`` bits each, and the byte at which each block begins."""
    parts, offsets, at = [], [], 0
    for first in range(0, len(ids), block):
        part = np.ascontiguousarray(ids[first : first + block], dtype="<u4")
        if width in (8, 16, 32):
            raw = part.astype(f"<u{width // 8}").tobytes()
        else:
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
            raw = np.packbits(bits, bitorder="little").tobytes()
        offsets.append(at)
        parts.append(raw)
        at += len(raw)
    return b"".join(parts), offsets


def unpacked(raw: bytes, width: int, count: int) -> np.ndarray:
    """The ``count`` ids of one block."""
    if width in (8, 16, 32):
        return np.frombuffer(raw, f"<u{width // 8}", count).astype(np.uint32)
    bits = np.unpackbits(np.frombuffer(raw, np.uint8), count=count * width, bitorder="little").reshape(count, width)
    spread = np.zeros((count, 32), np.uint8)
    spread[:, :width] = bits
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").ravel()


def read_ids(row: dict, first: int, last: int) -> np.ndarray:
    """Ids ``first`` to ``last`` of a segment; only the blocks that hold them are unpacked."""
    width, block, offsets, payload, total = row["width"], row["block"], row["offsets"], row["payload"], row["n_ids"]
    last = min(last, total)
    if first >= last:
        return np.zeros(0, np.uint32)
    wanted = range(first // block, -(-last // block))
    ends = [*offsets[1:], len(payload)]
    found = [unpacked(payload[offsets[b] : ends[b]], width, min(block, total - b * block)) for b in wanted]
    skipped = wanted.start * block
    return np.concatenate(found)[first - skipped : last - skipped]


def write_ids(
    docs: DataFrame, folder: str, path: str, end_id: int, key: str = "doc_id", text: str = "text", shards: int | None = None
) -> None:
    """Encode every whole text, append ``end_id``, and write all ids in ascending order of the (whole-number) key.

    Texts are dealt out by ranges of the key once, then encoded and written by the same task. Rows without
    a key come first; rows that share one follow each other. A NULL or empty text is the end id alone.
    """
    rows = pick(docs, _key=key, _text=text)
    rows = rows.select(F.col("_key").cast("bigint"), "_text")
    if shards is None:
        shards = max(1, -(-rows.count() // DOCS_PER_SHARD), rows.sparkSession.sparkContext.defaultParallelism)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("shard", pa.int32()), ("segment", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int64())]
            + [("width", pa.int32()), ("block", pa.int32())]
            + [(name, pa.list_(pa.int64())) for name in ("offsets", "keys", "starts")]
            + [("payload", pa.binary())]
        )
        shard, first, segment = TaskContext.get().partitionId(), 0, 0
        for batch in sliced(batches, 1):
            coder = encoder(path, library=True, keep=KEPT_WORDS)
            width = width_of(max(coder.vocabulary.size, end_id + 1))
            found, offsets = coder.encode(batch.column(1))
            ids = np.insert(found, offsets[1:], np.uint32(end_id))
            bounds = offsets + np.arange(len(offsets))
            keys = batch.column(0).to_pylist()
            at = 0
            while at < len(keys):  # whole documents, until a segment is full
                upto = max(at + 1, int(np.searchsorted(bounds, bounds[at] + SEGMENT, "right")) - 1)
                part = ids[bounds[at] : bounds[upto]]
                payload, blocks = packed(part, width)
                starts = (bounds[at:upto] - bounds[at]).tolist()
                row = [shard, segment, first, len(part), width, BLOCK, blocks, keys[at:upto], starts, payload]
                yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema)
                first, segment, at = first + len(part), segment + 1, upto
        encoder(path, library=True, keep=KEPT_WORDS).forget(words=False)  # the next task need not learn the same words again

    dealt = rows.repartitionByRange(shards, F.col("_key").asc_nulls_first()).sortWithinPartitions(
        F.col("_key").asc_nulls_first(), F.xxhash64("_text")
    )
    dealt.mapInArrow(run, COLUMNS).write.option("compression", "none").mode("overwrite").parquet(folder)


def read_segments(spark: SparkSession, folder: str) -> DataFrame:
    """The segments with ``base``, the ids of all shards before theirs: one number per shard is added up."""
    segments = spark.read.schema(COLUMNS).parquet(folder)
    totals = segments.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("bigint").alias("base"))
    # Written first, so that Spark knows their size: while that is within its limit for broadcasts, no payload is moved.
    return segments.join(stored(bases, "bases"), "shard")


def documents_in(spark: SparkSession, folder: str, key: str = "doc_id", keep_ids: bool = False) -> DataFrame:
    """``(key, start, n_tokens, ids_crc32[, ids])`` of every document, read back from the files."""
    segments = read_segments(spark, folder).select(
        "first", "base", "n_ids", "width", "block", "offsets", "keys", "starts", "payload"
    )

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(len(batch)):
                row = {name: batch.column(name)[at].as_py() for name in batch.schema.names}
                ids = np.ascontiguousarray(read_ids(row, 0, row["n_ids"]), "<u4")
                starts = np.array(row["starts"], np.int64)
                ends = np.append(starts[1:], len(ids))
                raw = memoryview(ids).cast("B")
                parts = [raw[4 * a : 4 * b] for a, b in zip(starts.tolist(), ends.tolist())]
                columns = [
                    pa.array(row["keys"], pa.int64()),
                    pa.array(starts + (row["base"] + row["first"])),
                    pa.array(ends - starts),
                    pa.array([zlib.crc32(part) for part in parts], pa.int64()),
                ]
                if keep_ids:
                    columns.append(pa.array([bytes(part) for part in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, [key, "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    schema = f"`{key}` bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + (", ids binary" if keep_ids else "")
    return segments.mapInArrow(run, schema)


def ids_between(spark: SparkSession, folder: str, first: int, last: int) -> DataFrame:
    """``(position, id)`` of the ids ``first`` to ``last`` (exclusive) of the whole corpus, by random access."""
    place = F.col("base") + F.col("first")
    inside = read_segments(spark, folder).where((place < F.lit(last)) & (place + F.col("n_ids") > F.lit(first)))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                begin = row["base"] + row["first"]
                low = max(0, first - begin)
                ids = read_ids(row, low, last - begin)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(len(ids)) + begin + low), pa.array(ids.astype(np.int64))], ["position", "id"]
                )

    return inside.mapInArrow(run, "position bigint, id bigint")


def round_trip(docs: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Write the ids of ``docs`` to a new folder and read the documents back from it."""
    folder = shared_folder(docs.sparkSession, "token-ids")
    write_ids(docs, folder, path, end_id, key, text)
    return documents_in(docs.sparkSession, folder, key)
