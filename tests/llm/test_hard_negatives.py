"""Hard negatives against brute force, with tiny blocks, pages and chunks."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from tierspark.llm import hard_negatives as hn

SCHEMA = "id bigint, label int, vector array<bigint>, ID_ string, Anchor string"


def plain(rows, k=5, m=3):
    one = {}
    for key, label, vector in rows:
        if key is None or label is None or vector is None or None in vector:
            continue
        one[key] = min(one.get(key, (vector, label)), (vector, label))
    found = []
    for a, (v, label) in one.items():
        if a % 5:
            continue
        scored = [(-sum(x * y for x, y in zip(v, w)), b, other) for b, (w, other) in one.items() if b != a and len(v) == len(w)]
        scored.sort()
        for s, p, _ in [x for x in scored if x[2] == label][:k]:
            ps = -s
            fits = [(-t, n) for t, n, other in scored if other != label and 50 * ps <= -100 * t <= 95 * ps]
            found += [(a, p, r, n, ps, ns) for r, (ns, n) in enumerate(fits[:m], 1)]
    return sorted(found)


def mined(spark, rows):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    found = hn.hard_negatives(df, F.col("id") % 5 == 0)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, monkeypatch, seed):
    """Ties, a hot label, repeated ids, NULLs, unlike and no lengths, wide numbers; many blocks, pages and chunks."""
    for name, size in (("BLOCK", 4), ("PAGE", 3), ("CHUNK", 3)):
        monkeypatch.setattr(hn, name, size)
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(120):
        size, span = int(rng.choice([2, 5, 0], p=[0.2, 0.75, 0.05])), int(rng.choice([3, 40, 1 << 18]))
        vector = rng.integers(-span // 2, span, size).tolist()
        rows.append((i, int(rng.choice([0, 0, 0, 1, 2, 900])), vector))
    rows += [rows[5], (7, 1, [1, 2]), (None, 1, [1] * 5), (201, None, [1] * 5), (205, 1, None), (210, 1, [1, None, 2, 3, 4])]
    rows += [(300 + i, i % 2, [9, 9, 9, 9, 9]) for i in range(12)]
    assert mined(spark, rows) == plain(rows)


def test_empty_table_and_single_label(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(i, 1, [i, 1]) for i in range(10)]) == []


@pytest.mark.parametrize("dimensions,bits", [(1, 3), (2, 4), (3, 3), (5, 2)])
def test_curve_visits_every_cell_by_single_steps(dimensions, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dimensions)))
    keys = [key.tobytes() for key in hn.curve_keys(cells, bits)]
    assert len(set(keys)) == len(cells)
    path = cells[np.argsort(np.array(keys, object))]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_bounds_hold_every_score():
    rng = np.random.default_rng(4)
    vectors, anchors = rng.integers(-50, 50, (30, 8)), rng.integers(-50, 50, (9, 8))
    low, high = hn.score_bounds(anchors, vectors.min(axis=0, keepdims=True), vectors.max(axis=0, keepdims=True))
    scores = anchors @ vectors.T
    assert (low[:, 0] <= scores.min(axis=1)).all() and (high[:, 0] >= scores.max(axis=1)).all()


def test_zone_maps_spare_blocks(spark, monkeypatch):
    """Of two far groups of rows only the near one's blocks are read for positives."""
    monkeypatch.setattr(hn, "BLOCK", 8)
    rows = [(i, 1, [100 + i % 3, 100] if i % 2 else [-100 - i % 3, -100]) for i in range(256)]
    one = spark.createDataFrame(rows, "id bigint, label bigint, vector array<bigint>").withColumn("anchor", F.col("id") == 5)
    order = ["label", "place", "id"]
    ordered = hn._placed(one.select("id", "label", "anchor", "vector")).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = hn.stored(hn._blocks(ordered), "blocks")
    pages, chunks = hn.stored(hn._pages(blocks), "pages"), hn.stored(hn._chunks(blocks, 5), "chunks")
    cells = pages.select("page", F.lit(chunks.first().chunk).alias("chunk"))
    assert 0 < hn._wanted(cells, pages, chunks, None).count() <= blocks.count() // 2 + 1
