"""Best-fit packing of token pieces into sequences of a fixed capacity.

Bounded-space online best fit: pieces come in one by one, and a fixed number of bins is open. The open
bins are keyed by their free space, and a bitset says which amounts of free space occur; the best bin for
a piece, the one it fills most, is the lowest set bit at or above its length. If none fits, a new bin is
opened; if too many are open, the fullest is closed first.

Documents are encoded where they lie. Only slim rows (key, length, checksum) are then dealt out to packers,
in a pseudo-random but repeatable order, so that a packer sees enough pieces of all lengths to fill its
bins. Each packer works on a bounded number of rows; more data means more packers.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tierspark.llm.bpe_trie import as_binary, encoder
from tierspark.llm.common import pick, sliced, stored

CAPACITY = 2048
OPEN_BINS = 4096
PIECES_PER_PACKER = 1 << 19
SEQUENCES_PER_PACKER = 40  # bits; a packer's number stands above them


class OpenBins:
    """The open bins of one packer."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.spaces = 0  # bit s is set if some open bin has s free tokens
        self.count = self.opened = 0

    def _take(self, space: int) -> int:
        bins = self.by_space[space]
        taken = bins.pop()
        if not bins:
            self.spaces &= ~(1 << space)
        self.count -= 1
        return taken

    def place(self, length: int) -> tuple[int, int]:
        """``(bin, offset)`` for a piece of ``length`` tokens, at most the capacity."""
        fitting = self.spaces >> length
        if fitting:
            space = length + (fitting & -fitting).bit_length() - 1
            chosen = self._take(space)
        else:
            if self.count >= self.most:
                self._take((self.spaces & -self.spaces).bit_length() - 1)
            space, chosen = self.capacity, self.opened
            self.opened += 1
        left = space - length
        if left:
            self.by_space[left].append(chosen)
            self.spaces |= 1 << left
            self.count += 1
        return chosen, self.capacity - space


def pieces(
    docs: DataFrame,
    path: str,
    end_id: int,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32[, ids])``: each document's ids and the end id, cut at ``capacity``.

    Only documents longer than that are cut. A NULL or empty text is the end id alone. Rows that repeat,
    or have no key, are documents like any other.
    """
    rows = pick(docs, **{key: key, "_text": text})
    schema = f"`{key}` {rows.schema[key].dataType.simpleString()}, piece int, start bigint, length bigint, ids_crc32 bigint"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 1):
            found, offsets = encoder(path, library=True).encode(batch.column(1))
            ids = np.insert(found, offsets[1:], np.uint32(end_id))
            bounds = offsets + np.arange(len(offsets))
            lengths = np.diff(bounds)
            counts = -(-lengths // capacity)
            owner = np.repeat(np.arange(len(lengths)), counts)
            piece = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, lengths[owner] - start)
            first = bounds[:-1][owner] + start
            raw = memoryview(ids).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(first.tolist(), (first + length).tolist())]
            columns = [
                batch.column(0).take(pa.array(owner)),
                pa.array(piece, pa.int32()),
                pa.array(start, pa.int64()),
                pa.array(length, pa.int64()),
                pa.array(crc, pa.int64()),
            ]
            if keep_ids:  # pieces follow each other without gaps
                columns.append(as_binary(ids, np.append(first, len(ids))))
            yield pa.RecordBatch.from_arrays(columns, [key, "piece", "start", "length", "ids_crc32", "ids"][: len(columns)])
        encoder(path, library=True).forget()

    return rows.mapInArrow(run, schema + (", ids binary" if keep_ids else ""))


def pack(rows: DataFrame, packers: int, order: list[str], capacity: int = CAPACITY, open_bins: int = OPEN_BINS) -> DataFrame:
    """``rows`` with ``sequence_id`` and ``offset``; ``length`` is 1 to ``capacity`` in each.

    ``order`` names columns that tell rows apart; their hash deals rows out to ``packers`` tasks and orders
    them there, so a task that runs again packs the same way. Rows equal in all of them are
    interchangeable.
    """
    by = F.xxhash64(*order)
    dealt = rows.withColumn("_at", by).repartition(packers, "_at").sortWithinPartitions("_at", *order).drop("_at")
    place = dealt.columns.index("length")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins = OpenBins(capacity, open_bins)
        base = TaskContext.get().partitionId() << SEQUENCES_PER_PACKER
        for batch in batches:
            found = [bins.place(length) for length in batch.column(place).to_pylist()]
            added = [pa.array([base + b for b, _ in found], pa.int64()), pa.array([o for _, o in found], pa.int64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    return dealt.mapInArrow(run, kinds + ", sequence_id bigint, offset bigint")


def pack_documents(
    docs: DataFrame,
    path: str,
    end_id: int = 0,
    capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS,
    key: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """Every piece of every document with its ``sequence_id`` and ``offset``; sequences have no gaps.

    The pieces are written first, which tells how many packers are needed and encodes each text once.
    """
    made = stored(pieces(docs, path, end_id, capacity, key, text, keep_ids), "pieces")
    packers = max(1, -(-made.count() // PIECES_PER_PACKER))
    return pack(made, packers, [key, "piece", "length", "ids_crc32"], capacity, open_bins)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids, starts)`` of pieces that kept their ids: a sequence is at most ``capacity`` tokens."""
    return (
        packed.groupBy("sequence_id")
        .agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"))
        .select(
            "sequence_id",
            F.aggregate("parts", F.lit(b""), lambda ids, part: F.concat(ids, part["ids"])).alias("ids"),
            F.col("parts.offset").alias("starts"),
        )
    )
