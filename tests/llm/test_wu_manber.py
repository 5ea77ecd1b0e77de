"""Wu-Manber search against plain comparison of word windows."""

import random
import re

import pytest

from tierspark.llm.wu_manber import Benchmark, contamination

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
DOCS = "doc_id bigint, text string, TEXT string, n_words string, items string"
ITEMS = "item_id bigint, text string, n_hit string, Item_Id string"


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, window=10):
    windows = {}
    for item, text in items:
        own = words(text)
        size = min(window, len(own))
        for i in range(len(own) - size + 1 if size else 0):
            windows.setdefault(tuple(own[i : i + size]), set()).add(item)
    found = []
    for text in docs:
        own, hit, named = words(text), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(own) - size + 1):
                if tuple(own[i : i + size]) in windows:
                    hit |= set(range(i, i + size))
                    named |= windows[tuple(own[i : i + size])]
        found.append((len(own), len(hit), sorted(map(str, named - {None}))))
    return found


@pytest.mark.parametrize("seed", range(20))
def test_search_equals_plain_comparison(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c1", "ñe", "x y", "été", "…", "zz", "--", "\n", "İ"][: rng.randint(2, 11)]

    def text(n):
        return rng.choice([" ", "-", ".  ", "\0"]).join(rng.choice(vocabulary) for _ in range(n))

    items = [(rng.choice([i, i % 5, None]), text(rng.choice([0, 1, 2, 5, 9, 10, 11, 30]))) for i in range(rng.randint(0, 12))]
    docs = [text(rng.choice([0, 1, 3, 9, 10, 50, 3000])) for _ in range(15)]
    docs += [text(5) + " " + t + " " + text(3) for _, t in items]
    window = rng.choice([2, 5, 10])
    benchmark = Benchmark([(None if i is None else str(i), t.encode()) for i, t in items], window)
    n_words, n_hit, runs, named = benchmark.judge([d.encode() for d in docs])
    got = [(int(n), int(h), named.get(i, [])) for i, (n, h) in enumerate(zip(n_words, n_hit))]
    assert got == plain(docs, items, window)
    assert [sum(b - a + 1 for a, b in runs.get(i, [])) for i in range(len(docs))] == n_hit.tolist()


TEN = "one two three four five six seven eight nine ten"
ROWS = [
    (1, None), (2, ""), (3, f"x {TEN.upper()}, eleven y"), (3, f"x {TEN.upper()}, eleven y"), (None, TEN), (4, "short thing"),
    (5, "word " * 200_000 + TEN), (6, TEN.replace("ten", "tenth")), (7, f"a short thing and {TEN}"),
]
TESTS = [(10, TEN + " eleven"), (2, "Short-thing!"), (2, "Short-thing!"), (9, None), (8, ""), (11, TEN + " eleven"), (None, "tenth")]


@pytest.mark.parametrize("at_once", [1 << 20, 40])
def test_edges_and_parts(spark, at_once):
    """NULLs, empty and long texts, repeated rows and items, clashing names; items in one part and in several."""
    docs = spark.createDataFrame([(k, t, "x", "y", "z") for k, t in ROWS], DOCS)
    items = spark.createDataFrame([(k, t, "x", "y") for k, t in TESTS], ITEMS)
    found = contamination(docs, items, at_once=at_once)
    assert found.columns == ["doc_id", "n_words", "n_hit", "spans", "items"]
    rows = found.collect()
    want = [(k, *answer) for (k, _), answer in zip(ROWS, plain([t for _, t in ROWS], TESTS))]
    assert sorted([(r.doc_id, r.n_words, r.n_hit, sorted(r["items"])) for r in rows], key=str) == sorted(want, key=str)
    for row in rows:
        spans = [(s.first, s.last) for s in row.spans]
        assert sum(b - a + 1 for a, b in spans) == row.n_hit and spans == sorted(spans)
        assert all(b + 1 < c for (_, b), (c, _) in zip(spans, spans[1:]))


def test_empty_tables(spark):
    docs, items = spark.createDataFrame([(1, TEN)], "doc_id bigint, text string"), spark.createDataFrame([(1, TEN)], "item_id int, text string")
    assert contamination(docs.limit(0), items).count() == 0
    assert [tuple(r) for r in contamination(docs, items.limit(0)).collect()] == [(1, 10, 0, [], [])]
