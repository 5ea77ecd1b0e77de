"""Exact top-k search by inner product with block-at-a-time pruning.

Candidates are laid out in blocks of neighbouring ids. A block keeps a forward index (its vectors) and the
maximum of each term, where every dimension is two terms: its positive and its negative part. For a query,
the summed products with a block's term maxima bound every score in it. Blocks are visited by falling bound,
each scored through its forward index, until the bound falls below the k-th best score so far.

Queries are a stated set and come in chunks. A chunk first scores its queries against each other, which
gives every query a threshold to start from, since queries are candidates too. Chunks meet super-blocks
(runs of blocks) one by one; each such meeting holds one bounded chunk and one bounded super-block.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierspark.llm.common import pick, stored

BLOCK = 128
SUPER_BLOCK = 64  # blocks
CHUNK = 1024  # queries
# Below this every sum of products is exact in a double.
EXACT = 1 << 53


def _blocks(rows: DataFrame, size: int, name: str) -> DataFrame:
    """Rows in order of ``id`` as blocks ``(name, ids, vectors)``; vectors are packed 64-bit integers.

    A block also holds rows of one length of vector only. ``name`` numbers the blocks of all tasks.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        ids: list[int] = []
        vectors: list[list[int]] = []

        def block() -> pa.RecordBatch:
            columns = [[number], [np.array(ids, "<i8").tobytes()], [np.array(vectors, "<i8").tobytes()], [len(ids)]]
            kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], [name, "ids", "vectors", "n"]
            )

        for batch in batches:
            for key, vector in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if ids and (len(ids) == size or len(vector) != len(vectors[0])):
                    yield block()
                    number, ids, vectors = number + 1, [], []
                ids.append(key)
                vectors.append(vector)
        if ids:
            yield block()

    return rows.mapInArrow(run, f"{name} bigint, ids binary, vectors binary, n int")


def _matrix(raw: bytes, n: int) -> np.ndarray:
    return np.frombuffer(raw, "<i8").reshape(n, -1)


def _product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows; doubles where they are exact, integers elsewhere."""
    largest = lambda m: int(np.abs(m).max(initial=0))
    if largest(a) * largest(b) * max(1, a.shape[1]) < EXACT:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def best_in(
    query_ids: np.ndarray, queries: np.ndarray, floor: np.ndarray, blocks: list[tuple[np.ndarray, np.ndarray]], k: int
) -> list[tuple[int, int, int]]:
    """``(query, id, score)``: the k best of the blocks per query, best first, ties to the smaller id.

    ``floor`` is a score that the k-th best overall is known to reach; less is left out.
    """
    positive = np.stack([np.maximum(v, 0).max(axis=0) for _, v in blocks])
    negative = np.stack([np.maximum(-v, 0).max(axis=0) for _, v in blocks])
    # A block's bound: parts of equal sign with their maxima; parts of unlike sign add nothing.
    bounds = _product(np.maximum(queries, 0), positive) + _product(np.maximum(-queries, 0), negative)
    order = np.argsort(-bounds, axis=1, kind="stable")
    found = []
    for q in range(len(queries)):
        least, ids, scores = floor[q], np.zeros(0, np.int64), np.zeros(0, np.int64)
        for block in order[q]:
            if bounds[q, block] < least:
                break
            keys, vectors = blocks[block]
            value = _product(queries[q : q + 1], vectors)[0]
            keep = (value >= least) & (keys != query_ids[q])
            ids, scores = np.concatenate([ids, keys[keep]]), np.concatenate([scores, value[keep]])
            if len(ids) >= k:
                best = np.lexsort((ids, -scores))[:k]
                ids, scores = ids[best], scores[best]
                least = max(least, scores[-1]) if len(ids) == k else least
        best = np.lexsort((ids, -scores))[:k]
        found += [(int(query_ids[q]), int(ids[b]), int(scores[b])) for b in best]
    return found


def _floors(ids: np.ndarray, vectors: np.ndarray, k: int) -> np.ndarray:
    """A score that each query's k-th best reaches: its k-th best among the other queries of its chunk."""
    lowest = np.iinfo(np.int64).min
    if len(ids) <= k:
        return np.full(len(ids), lowest)
    scores = _product(vectors, vectors)
    scores[ids[:, None] == ids[None, :]] = lowest
    return np.partition(scores, len(ids) - k, axis=1)[:, len(ids) - k]


def scaled(vector: Column) -> Column:
    """Each component x as floor(1024 x)."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * 1024))


def top_k(rows: DataFrame, is_query: Column, k: int = 10) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` for the query rows of ``rows(id, vector)`` against all others.

    ``vector`` holds whole numbers. Rows without an id or vector, or with a NULL in it, take no part. Of rows
    that share an id, the one with the smallest vector counts. A query meets only vectors of its own length.
    Products beyond 64 bits wrap around.
    """
    whole = F.col("id").isNotNull() & F.col("vector").isNotNull() & ~F.exists("vector", lambda x: x.isNull())
    good = rows.where(whole).select(F.col("id").cast("bigint"), F.col("vector").cast("array<bigint>"))
    one = stored(good.groupBy("id").agg(F.min("vector").alias("vector")), "vectors")
    ordered = one.repartitionByRange("id").sortWithinPartitions("id")
    blocks = _blocks(ordered, BLOCK, "block").withColumn("super", F.floor(F.col("block") / SUPER_BLOCK))
    blocks = stored(blocks, "blocks")
    chosen = one.where(is_query).repartitionByRange("id").sortWithinPartitions("id")
    chunks = stored(_blocks(chosen.coalesce(max(1, -(-one.where(is_query).count() // CHUNK))), CHUNK, "chunk"), "chunks")

    # Each meeting of a chunk and a super-block is one group of bounded size. Chunks are numbered without gaps.
    n_chunks = chunks.count()
    # Only the numbers, one per chunk, meet in one place; the vectors stay where they are.
    place = (F.row_number().over(Window.orderBy("chunk")) - 1).cast("bigint").alias("place")
    chunks = chunks.join(stored(chunks.select("chunk", place), "numbers"), "chunk").drop("chunk").withColumnRenamed("place", "chunk")
    if not n_chunks:
        blocks = blocks.limit(0)
    last = F.lit(max(0, n_chunks - 1)).cast("bigint")
    every_chunk = F.explode(F.sequence(F.lit(0).cast("bigint"), last)).alias("chunk")
    left = blocks.select("super", every_chunk, "block", "ids", "vectors", "n")
    cells = blocks.select("super").distinct().select("super", every_chunk)
    right = cells.join(chunks, "chunk").select(
        F.col("super").alias("with_super"), F.col("chunk").alias("with_chunk"), "ids", "vectors", "n"
    )

    def meet(blocks: pd.DataFrame, chunk: pd.DataFrame) -> pd.DataFrame:
        held = [
            (np.frombuffer(ids, "<i8"), _matrix(vectors, n))
            for ids, vectors, n in zip(blocks["ids"], blocks["vectors"], blocks["n"])
        ]
        ids = np.frombuffer(chunk["ids"].iloc[0], "<i8")
        vectors = _matrix(chunk["vectors"].iloc[0], chunk["n"].iloc[0])
        held = [(i, v) for i, v in held if v.shape[1] == vectors.shape[1]]
        found = best_in(ids, vectors, _floors(ids, vectors, k), held, k) if held else []
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"]).astype("int64")

    met = left.groupBy("super", "chunk").cogroup(right.groupBy("with_super", "with_chunk")).applyInPandas(
        meet, "query_id bigint, vec_id bigint, score bigint"
    )
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return met.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )
