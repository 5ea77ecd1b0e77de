"""Near-duplicates by SimHash, found with pigeonring filtering.

The 64 bits of a fingerprint are cut into 8 segments on a ring. If two fingerprints differ in at most
t bits, some segment starts a chain in which the first l segments differ in at most l*t/8 bits, for every
l (the pigeonring principle; the pigeonhole principle is the case l = 1). With t = 3 the budgets are
0, 0, 1, 1, 1, 2, 2, 3: two neighbouring segments are equal, and of the next three at least two. That gives
three join keys of 32 bits per start, and candidates must keep the rest of the chain before the full
comparison.

Equal fingerprints are one class from the start, so groups of copies are never paired. A key that very many
fingerprints share is compared in bounded blocks. Only the links that hold a block together are passed on.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tierspark.llm.common import pick, stored
from tierspark.llm.components import components, forest

BITS = 64
MOST_BITS = 3
SHINGLE = 3
SEED = 42
SEGMENTS = 8
SEGMENT_BITS = BITS // SEGMENTS
# Fingerprints that share a key are compared in blocks of so many.
BLOCK = 2048


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """A hash per word shingle of a text; A-Z count as a-z, words end at ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, "<u8")
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(shingle, len(words))
    spans = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    return np.array([digest(line[a:b], SEED) for a, b in spans], "<u8")


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles; 0 for a text without words."""
    hashes = shingle_hashes(text, shingle)
    ones = np.zeros(BITS, np.int64)
    for first in range(0, len(hashes), 1 << 16):
        part = hashes[first : first + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """``(key, fp)``: each document's fingerprint as a signed 64-bit number. NULL and empty texts have 0."""
    rows = pick(docs, **{key: key, "_text": text})
    rows = rows.select(F.col(key), F.coalesce("_text", F.lit("")).cast("binary").alias("_text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(value.as_py(), shingle) for value in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], [key, "fp"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[key].dataType.simpleString()}, fp bigint")


def _segment(fp: Column, number: int) -> Column:
    number %= SEGMENTS
    return F.shiftrightunsigned(fp, number * SEGMENT_BITS).bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))


def chain_keys(fp: Column) -> Column:
    """The keys of a fingerprint: per start, two equal segments and two of the next three.

    Bits: the start (3), which of the three segments is left out (2), the four segments (32).
    """
    keys = []
    for start in range(SEGMENTS):
        for left_out in range(3):
            chosen = [start, start + 1, *(start + 2 + n for n in range(3) if n != left_out)]
            value = F.lit((start * 3 + left_out) << 32).cast("bigint")
            for place, number in enumerate(chosen):
                value = value.bitwiseOR(F.shiftleft(_segment(fp, number), place * SEGMENT_BITS))
            keys.append(value)
    return F.array(*keys)


def in_chain(a: np.ndarray, b: np.ndarray, start: int, most: int = MOST_BITS) -> np.ndarray:
    """Which pairs keep every budget of the chain from ``start`` on; the last budget is the full comparison."""
    differing = a ^ b
    turn = np.uint64(start * SEGMENT_BITS)
    if start:
        differing = (differing >> turn) | (differing << np.uint64(BITS) - turn)
    keep = np.ones(differing.shape, bool)
    for length in range(1, SEGMENTS + 1):
        mask = np.uint64((1 << length * SEGMENT_BITS) - 1)
        keep &= np.bitwise_count(differing & mask) <= length * most // SEGMENTS
    return keep


def _linked(a: np.ndarray, b: np.ndarray, start: int, same: bool) -> np.ndarray:
    """The edges that hold two blocks of fingerprints together, as many as fingerprints at most."""
    found = []
    for first in range(0, len(a), 256):
        part = a[first : first + 256]
        i, j = np.nonzero(in_chain(part[:, None], b[None, :], start))
        pairs = np.stack([part[i], b[j]], axis=1)
        found.append(pairs[i + first < j] if same else pairs)
    pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
    return forest(pairs.view(np.int64))


def links(fps: DataFrame) -> DataFrame:
    """``(a, b)``: pairs of the distinct fingerprints in ``fps`` within 3 bits that connect all that are so linked.

    ``fps`` has one column ``fp`` and is read more than once.
    """
    keyed = fps.select("fp", F.explode(chain_keys(F.col("fp"))).alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    large = stored(sizes.where(F.col("n") > BLOCK), "large-keys")
    crowded = not large.isEmpty()
    few = keyed.join(large.select("key"), "key", "left_anti").select("fp", "key") if crowded else keyed
    spread = few.repartition("key").sortWithinPartitions("key")

    def small_groups(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_keys, held_fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def edges(keys: np.ndarray, values: np.ndarray) -> np.ndarray:
            """Of whole groups: neighbours one apart, then two apart, and so on as long as any group is that long."""
            found, apart = [], 1
            starts = (keys >> 32) // 3
            while apart < len(keys):
                left = np.flatnonzero(keys[apart:] == keys[:-apart])
                if not len(left):
                    break
                for start in range(SEGMENTS):
                    own = left[starts[left] == start]
                    own = own[in_chain(values[own], values[own + apart], start)]
                    found.append(np.stack([values[own], values[own + apart]], axis=1))
                apart += 1
            pairs = np.concatenate(found) if found else np.zeros((0, 2), np.uint64)
            return forest(pairs.view(np.int64))

        def batch_of(pairs: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            held_fps = np.concatenate([held_fps, batch.column(0).to_numpy().view(np.uint64)])
            held_keys = np.concatenate([held_keys, batch.column(1).to_numpy()])
            whole = int(np.searchsorted(held_keys, held_keys[-1])) if len(held_keys) else 0  # the last group may go on
            if whole:
                yield batch_of(edges(held_keys[:whole], held_fps[:whole]))
                held_keys, held_fps = held_keys[whole:], held_fps[whole:]
        if len(held_keys):
            yield batch_of(edges(held_keys, held_fps))

    found = spread.mapInArrow(small_groups, "a bigint, b bigint")
    return found.unionByName(_large_groups(keyed.join(large, "key"))) if crowded else found


def _large_groups(rows: DataFrame) -> DataFrame:
    """The same for keys of very many fingerprints: every two blocks of a key meet in a group of their own."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    placed = rows.select("key", "fp", blocks.alias("blocks"), F.pmod(F.xxhash64("fp"), blocks).cast("int").alias("own"))
    met = placed.select("key", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    cells = met.select(
        "key", "fp", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")
    )

    def cell(rows: pd.DataFrame) -> pd.DataFrame:
        low, high, start = rows["low"].iloc[0], rows["high"].iloc[0], int(rows["key"].iloc[0] >> 32) // 3
        a = rows["fp"][rows["own"] == low].to_numpy().view(np.uint64)
        b = rows["fp"][rows["own"] == high].to_numpy().view(np.uint64)
        pairs = _linked(a, b, start, bool(low == high))
        return pd.DataFrame({"a": pairs[:, 0], "b": pairs[:, 1]})

    return cells.groupBy("key", "low", "high").applyInPandas(cell, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, fingerprint, component_id)`` per document.

    ``component_id`` is the smallest key reachable through links of at most 3 differing bits, the document's
    own included; documents with the same fingerprint are linked. Rows without a key take part like others;
    a component of such rows alone has no number. Repeated rows are returned as often as they come.
    """
    marked = stored(fingerprints(docs, key, text), "fingerprints")
    classes = stored(marked.groupBy("fp").agg(F.min(key).alias("_least")), "classes")
    roots = components(links(classes.select("fp")))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "_least", F.coalesce("root", "fp").alias("_root")
    )
    named = placed.groupBy("_root").agg(F.min("_least").alias("component_id"))
    per_class = placed.join(named, "_root").select("fp", "component_id")
    return marked.join(per_class, "fp").select(
        key, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )
