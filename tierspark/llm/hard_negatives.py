"""Hard-negative mining over Hilbert-ordered blocks with zone maps.

Rows lie in Parquet in order of label and of their place on a Hilbert curve, cut into blocks of one label; each
block is a row that holds its vectors and, per dimension, their least and largest value. From this zone map,
interval arithmetic bounds the inner product of an anchor with any vector of the block from both sides.

1. Positives: an anchor's own block, its neighbours on the curve, gives a score that its k-th positive reaches.
   Only blocks of its label whose upper bound is not below that score are read.
2. Negatives: each positive opens a window of scores. Only blocks of other labels whose interval of bounds meets a
   window of an anchor are read.

Anchors come in chunks of neighbours, blocks in pages. A chunk first meets the zone maps of a page, and then those
blocks of it that one of its anchors needs; both meetings are of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierspark.llm.common import bounded, stored

# Rows of a block, blocks of a page and anchors of a chunk, at most; vectors of many dimensions get fewer, so that
# none of them holds more than so many components.
BLOCK, PAGE, CHUNK = 128, 256, 256
COMPONENTS = 1 << 20
# Steps of the curve in each dimension, as bits.
CURVE_BITS = 4
# Below this every sum of products is exact in a double.
EXACT = 1 << 53
LEAST = np.iinfo(np.int64).min
# A positive's window: LOW <= SCALE * negative / positive <= HIGH.
LOW, HIGH, SCALE = 50, 95, 100


def curve_keys(cells: np.ndarray, bits: int = CURVE_BITS) -> np.ndarray:
    """The places of points with coordinates below 2^bits on a Hilbert curve, as rows of bytes that sort alike.

    Skilling's transformation (Programming the Hilbert curve, 2004), for all points at once.
    """
    axes = [cells[:, i].astype(np.uint64) for i in range(cells.shape[1])]
    for level in range(bits - 1, 0, -1):
        lower = np.uint64((1 << level) - 1)
        for i, axis in enumerate(axes):
            upper_half = (axis >> np.uint64(level)) & np.uint64(1) == 1
            swapped = np.where(upper_half, np.uint64(0), (axes[0] ^ axis) & lower)
            axes[0] = axes[0] ^ np.where(upper_half, lower, swapped)
            if i:
                axes[i] = axis ^ swapped
    for i in range(1, len(axes)):
        axes[i] = axes[i] ^ axes[i - 1]
    turned = np.zeros(len(cells), np.uint64)
    for level in range(bits - 1, 0, -1):
        turned ^= ((axes[-1] >> np.uint64(level)) & np.uint64(1)) * np.uint64((1 << level) - 1)
    axes = [axis ^ turned for axis in axes]
    planes = [(axis >> np.uint64(level)) & np.uint64(1) for level in range(bits - 1, -1, -1) for axis in axes]
    return np.packbits(np.stack(planes, axis=1).astype(np.uint8), axis=1)


def _fewer(most: int, size: int) -> int:
    return max(1, min(most, COMPONENTS // max(1, size)))


def _packed(vectors: np.ndarray) -> tuple[int, bytes]:
    """Whole numbers in the fewest bytes (2, 4 or 8) that hold them all."""
    largest = max(-int(vectors.min(initial=0)) - 1, int(vectors.max(initial=0)))
    width = 2 if largest < 1 << 15 else 4 if largest < 1 << 31 else 8
    return width, vectors.astype(f"<i{width}").tobytes()


def _unpacked(raw: bytes, width: int, n: int) -> np.ndarray:
    return np.frombuffer(raw, f"<i{width}").astype(np.int64).reshape(n, -1)


def _numbers(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<i8")


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of ``a`` with those of ``b``."""
    largest = lambda m: max(abs(int(m.min(initial=0))), int(m.max(initial=0)))
    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def score_bounds(anchors: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest inner product that an anchor can have with a vector inside each zone."""
    positive, negative = np.maximum(anchors, 0), np.maximum(-anchors, 0)
    return (
        _product(positive, lows) - _product(negative, highs),
        _product(positive, highs) - _product(negative, lows),
    )


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id, in that order."""
    if len(scores) > k:
        least = np.partition(scores, len(scores) - k)[len(scores) - k]
        places = np.flatnonzero(scores >= least)
    else:
        places = np.arange(len(scores))
    return places[np.lexsort((ids[places], -scores[places]))[:k]]


def _arrow(df: DataFrame, run: Callable[[Iterable[pa.RecordBatch]], Iterator[dict[str, list]]], schema: str) -> DataFrame:
    """``mapInArrow`` for functions that yield rows as columns of plain lists."""
    names = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "boolean": pa.bool_()}
    fields = [part.split() for part in schema.split(", ")]
    target = pa.schema([(name, names[kind]) for name, kind in fields])

    def arrow(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in run(batches):
            yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

    return df.mapInArrow(arrow, schema)


def _placed(rows: DataFrame) -> DataFrame:
    """Rows with their key on the curve; the range of all components is cut into equal steps."""
    ends = rows.agg(F.min(F.array_min("vector")).alias("low"), F.max(F.array_max("vector")).alias("high")).first()
    low, step = ends.low or 0, max(1, -(-((ends.high or 0) - (ends.low or 0) + 1) >> CURVE_BITS))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column("vector")
            sizes, keys = np.diff(vectors.offsets.to_numpy()), np.empty(len(batch), object)
            values, starts = vectors.flatten().to_numpy(), np.concatenate([[0], np.cumsum(sizes)])
            for size in np.unique(sizes):
                own = np.flatnonzero(sizes == size)
                cells = (values[starts[own][:, None] + np.arange(size)] - low) // step
                keys[own] = [key.tobytes() for key in curve_keys(cells)] if size else b""
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys, pa.binary())], [*batch.schema.names, "place"])

    return rows.mapInArrow(run, "id bigint, label bigint, anchor boolean, vector array<bigint>, place binary")


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows in order of label, length and curve as blocks of one label and length, with zone maps."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[int, bool, list[int]]] = []
        now = None

        def block() -> dict[str, list]:
            vectors = np.array([v for _, _, v in held], np.int64).reshape(len(held), now[1])
            ends = np.concatenate([vectors.min(axis=0, keepdims=True), vectors.max(axis=0, keepdims=True)])
            width, raw = _packed(vectors)
            zone_width, zone = _packed(ends)
            ids, flags = np.array([i for i, _, _ in held], "<i8"), np.array([a for _, a, _ in held], np.uint8)
            return {
                "block": [number], "label": [now[0]], "size": [now[1]], "n": [len(held)], "ids": [ids.tobytes()],
                "flags": [flags.tobytes()], "width": [width], "vectors": [raw], "zone_width": [zone_width], "zone": [zone],
            }

        for batch in batches:
            for key, label, anchor, vector in zip(*(batch.column(i).to_pylist() for i in range(4))):
                kind = (label, len(vector))
                if held and (kind != now or len(held) == _fewer(BLOCK, now[1])):
                    yield block()
                    number, held = number + 1, []
                now = kind
                held.append((key, bool(anchor), vector))
        if held:
            yield block()

    return _arrow(
        rows,
        run,
        "block bigint, label bigint, size int, n int, ids binary, flags binary, width int, vectors binary, zone_width int, zone binary",
    )


def _groups(parts: Iterable[tuple], most: int) -> Iterator[list[tuple]]:
    """Tuples in runs of the same first entry, the vectors' length, of at most ``most`` or as many as fit."""
    held: list[tuple] = []
    for part in parts:
        if held and (part[0] != held[0][0] or len(held) == _fewer(most, held[0][0])):
            yield held
            held = []
        held.append(part)
    if held:
        yield held


def _pages(blocks: DataFrame) -> DataFrame:
    """The zone maps of neighbouring blocks of one length together."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        zones = (zone for b in batches for zone in zip(*(b.column(i).to_pylist() for i in range(5))))
        page = TaskContext.get().partitionId() << 32
        for held in _groups(zones, PAGE):
            size, numbers, labels, widths, raws = zip(*held)
            ends = np.stack([_unpacked(raw, width, 2) for raw, width in zip(raws, widths)])
            width, raw = _packed(ends)
            yield {
                "page": [page], "size": [size[0]], "n": [len(held)], "blocks": [np.array(numbers, "<i8").tobytes()],
                "labels": [np.array(labels, "<i8").tobytes()], "width": [width], "zones": [raw],
            }
            page += 1

    zones = blocks.select("size", "block", "label", "zone_width", "zone")
    return _arrow(zones, run, "page bigint, size int, n int, blocks binary, labels binary, width int, zones binary")


def _chunks(blocks: DataFrame, k: int) -> DataFrame:
    """The anchors of neighbouring blocks together, each with a score that its k-th best of its label reaches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        def anchors() -> Iterator[tuple]:
            for batch in batches:
                for label, n, ids, flags, width, raw in zip(*(batch.column(i).to_pylist() for i in range(6))):
                    vectors, own = _unpacked(raw, width, n), np.flatnonzero(np.frombuffer(flags, np.uint8))
                    scores = _product(vectors[own], vectors)
                    for place, row in zip(own.tolist(), scores):
                        others = np.delete(row, place)
                        floor = int(np.partition(others, n - 1 - k)[n - 1 - k]) if n - 1 >= k else LEAST
                        yield vectors.shape[1], int(_numbers(ids)[place]), label, floor, vectors[place]

        chunk = TaskContext.get().partitionId() << 32
        for held in _groups(anchors(), CHUNK):
            size, ids, labels, floors, vectors = zip(*held)
            width, raw = _packed(np.stack(vectors))
            yield {
                "chunk": [chunk], "size": [size[0]], "n": [len(held)], "ids": [np.array(ids, "<i8").tobytes()],
                "labels": [np.array(labels, "<i8").tobytes()], "floors": [np.array(floors, "<i8").tobytes()],
                "width": [width], "vectors": [raw],
            }
            chunk += 1

    with_anchors = blocks.where(F.expr("instr(hex(flags), '01') > 0")).select("label", "n", "ids", "flags", "width", "vectors")
    return _arrow(
        with_anchors, run, "chunk bigint, size int, n int, ids binary, labels binary, floors binary, width int, vectors binary"
    )


def _windows(raw: bytes, n: int, own: tuple[int, int, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of packed (anchor, positive, score): the anchor, the positive's place, and its window's least and largest score."""
    found = _numbers(raw).reshape(-1, 3)
    low, high, scale = own
    return found[:, 0], found[:, 1], -(-low * found[:, 2] // scale), high * found[:, 2] // scale


def _wanted(cells: DataFrame, pages: DataFrame, chunks: DataFrame, window: tuple[int, int, int] | None) -> DataFrame:
    """``(chunk, page, block)``: the blocks of each cell that an anchor needs, by their bounds alone.

    Without ``window`` blocks of the anchor's label that can reach its floor, else those of other labels that can
    hold a score of one of its windows.
    """
    left = pages.select("page", *[F.col(c).alias(f"page_{c}") for c in ("n", "blocks", "labels", "width", "zones")])
    columns = ["chunk", "n", "labels", "floors" if window is None else "windows", "width", "vectors"]
    met = cells.join(left, "page").join(chunks.select(*columns), "chunk")
    met = met.select("chunk", "page", "page_n", "page_blocks", "page_labels", "page_width", "page_zones", *columns[1:])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for i in range(len(batch)):
                chunk, page, zones, blocks, block_labels, zone_width, ends, n, labels, goal, width, raw = (
                    batch.column(c)[i].as_py() for c in range(12)
                )
                ends = _unpacked(ends, zone_width, zones).reshape(zones, 2, -1)
                least, most = score_bounds(_unpacked(raw, width, n), ends[:, 0], ends[:, 1])
                same = _numbers(labels)[:, None] == _numbers(block_labels)[None, :]
                if window is None:
                    need = (same & (most >= _numbers(goal)[:, None])).any(axis=0)
                else:
                    anchor, _, low, high = _windows(goal, n, window)
                    need = (~same[anchor] & (most[anchor] >= low[:, None]) & (least[anchor] <= high[:, None])).any(axis=0)
                needed = _numbers(blocks)[need].tolist()
                if needed:
                    yield {"chunk": [chunk] * len(needed), "page": [page] * len(needed), "block": needed}

    return _arrow(met, run, "chunk bigint, page bigint, block bigint")


def _read(wanted: DataFrame, blocks: DataFrame, chunks: DataFrame, k: int, window: tuple[int, int, int] | None) -> DataFrame:
    """The best of each cell: ``(chunk, anchor, id, score)`` of the anchor's label, or with a window also ``place``.

    ``anchor`` is a place in the chunk, ``place`` one among the positives of the chunk. Each meeting holds one
    chunk and the wanted blocks of one page.
    """
    columns = ["ids", "labels", "floors" if window is None else "windows", "n", "width", "vectors"]
    left = wanted.join(blocks.select("block", "label", "n", "ids", "width", "vectors"), "block")
    right = wanted.select("chunk", "page").distinct().join(chunks.select("chunk", *columns), "chunk")
    right = right.select(F.col("chunk").alias("with_chunk"), F.col("page").alias("with_page"), *columns)

    def meet(blocks: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        own = chunk.iloc[0]
        anchor_ids, anchor_labels, vectors = _numbers(own["ids"]), _numbers(own["labels"]), _unpacked(own["vectors"], own["width"], own["n"])
        ids = np.concatenate([_numbers(raw) for raw in blocks["ids"]])
        labels = np.repeat(blocks["label"].to_numpy(), blocks["n"].to_numpy())
        held = np.concatenate([_unpacked(*part) for part in zip(blocks["vectors"], blocks["width"], blocks["n"])])
        if window is None:
            floors = _numbers(own["floors"])
        else:
            of, places, lows, highs = _windows(own["windows"], own["n"], window)
            owned = [np.flatnonzero(of == i) for i in range(own["n"])]
        found: list[tuple] = []
        for first in range(0, own["n"], 32):  # bounds the scores held at once
            for i, scores in enumerate(_product(vectors[first : first + 32], held), first):
                if window is None:
                    at = np.flatnonzero((labels == anchor_labels[i]) & (ids != anchor_ids[i]) & (scores >= floors[i]))
                    at = at[_best(scores[at], ids[at], k)]
                    found += [(i, 0, a, s) for a, s in zip(ids[at].tolist(), scores[at].tolist())]
                    continue
                if not len(owned[i]):
                    continue
                at = np.flatnonzero((labels != anchor_labels[i]) & (scores >= lows[owned[i]].min()) & (scores <= highs[owned[i]].max()))
                for w in owned[i].tolist():
                    in_window = at[(scores[at] >= lows[w]) & (scores[at] <= highs[w])]
                    in_window = in_window[_best(scores[in_window], ids[in_window], k)]
                    found += [(i, int(places[w]), a, s) for a, s in zip(ids[in_window].tolist(), scores[in_window].tolist())]
        result = pd.DataFrame(found, columns=["anchor", "place", "id", "score"]).astype("int64")
        result.insert(0, "chunk", own["with_chunk"])
        return result.astype({"chunk": "int64"})

    return left.groupBy("chunk", "page").cogroup(right.groupBy("with_chunk", "with_page")).applyInPandas(
        meet, "chunk bigint, anchor bigint, place bigint, id bigint, score bigint"
    )


def _first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    best = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def hard_negatives(
    rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = LOW, high: int = HIGH, scale: int = SCALE
) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` over ``rows(id, label, vector)``.

    ``vector`` holds whole numbers. An anchor's positives are the ``positives`` other rows of its label with the
    highest inner products; for each of them the ``negatives`` first rows of other labels follow with
    low * positive_score <= scale * negative_score <= high * positive_score. Higher scores come first, ties go to the
    smaller id. Rows with a NULL in id, label or vector take no part; of rows that share an id the one with
    the smallest vector, then label, counts; vectors meet those of their own length only. Scores times ``scale`` and ``high`` stay
    within 64 bits.
    """
    bounded(rows.sparkSession)
    whole = "id IS NOT NULL AND label IS NOT NULL AND vector IS NOT NULL AND NOT exists(vector, x -> x IS NULL)"
    typed = rows.select(F.col("id").cast("bigint"), F.col("label").cast("bigint"), F.col("vector").cast("array<bigint>"))
    one = typed.where(whole).groupBy("id").agg(F.min(F.struct("vector", "label")).alias("_row"))
    one = stored(one.select("id", "_row.label", F.coalesce(is_anchor, F.lit(False)).alias("anchor"), "_row.vector"), "vectors")

    order = ["label", "_size", "place", "id"]
    placed = _placed(one).withColumn("_size", F.size("vector"))
    ordered = placed.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = stored(_blocks(ordered), "blocks")
    pages, chunks = stored(_pages(blocks), "pages"), stored(_chunks(blocks, positives), "chunks")

    # Positives: pages that hold a label of the chunk.
    in_page, in_chunk = _labels(pages, "page"), _labels(chunks, "chunk")
    cells = in_page.join(in_chunk, ["size", "label"]).select("page", "chunk").distinct()
    wanted = stored(_wanted(cells, pages, chunks, None), "wanted")
    found = _first(_read(wanted, blocks, chunks, positives, None), positives, "chunk", "anchor")
    found = stored(found.select("chunk", "anchor", "id", "score", "rank"), "positives")

    # Negatives: every page meets every chunk of its length, by number. A window is known by its place in the chunk.
    place = F.col("anchor") * positives + F.col("rank") - 1
    windows = found.groupBy("chunk").agg(F.flatten(F.array_sort(F.collect_list(F.array("anchor", place, "score")))).alias("_w"))
    windows = _arrow(windows, _pack_windows, "chunk bigint, windows binary")
    opened = stored(chunks.drop("floors").join(windows, "chunk"), "windows")
    numbers = opened.select("size", "chunk")
    cells = pages.select("size", "page").join(numbers, "size").select("page", "chunk")
    wanted = stored(_wanted(cells, pages, opened, (low, high, scale)), "wanted")
    mined = _first(_read(wanted, blocks, opened, negatives, (low, high, scale)), negatives, "chunk", "anchor", "place")
    owners = _arrow(chunks.select("chunk", "ids"), _unpack_ids, "chunk bigint, anchor bigint, anchor_id bigint")
    positive = found.select("chunk", "anchor", place.alias("place"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    return mined.join(positive, ["chunk", "anchor", "place"]).join(owners, ["chunk", "anchor"]).select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )


def _labels(table: DataFrame, name: str) -> DataFrame:
    """``(size, name, label)``: the labels that each page or chunk holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
        for batch in batches:
            for size, number, raw in zip(*(column.to_pylist() for column in batch.columns)):
                labels = np.unique(_numbers(raw)).tolist()
                yield {"size": [size] * len(labels), name: [number] * len(labels), "label": labels}

    return _arrow(table.select("size", name, "labels"), run, f"size int, {name} bigint, label bigint")


def _pack_windows(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        packed = [np.array(w, "<i8").tobytes() for w in batch.column(1).to_pylist()]
        yield {"chunk": batch.column(0).to_pylist(), "windows": packed}


def _unpack_ids(batches: Iterable[pa.RecordBatch]) -> Iterator[dict[str, list]]:
    for batch in batches:
        for chunk, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            ids = _numbers(raw).tolist()
            yield {"chunk": [chunk] * len(ids), "anchor": list(range(len(ids))), "anchor_id": ids}
