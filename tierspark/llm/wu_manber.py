"""Benchmark decontamination by Wu-Manber search for many word windows at once.

A test item gives one search string per window of ten consecutive words, written as `` w1 w2 ... w10 `` with a
space at both ends; documents are brought to the same form, so that a string occurs where its words do. Of all
strings the first m bytes count, m being the length of the shortest:

1. The shift table tells, for a block of bytes, how far its last place in any string is from byte m. A block
   that no string holds lets the search skip m minus its length. Spans of a text are searched side by side, each at
   a place of its own.
2. Where the shift is 0 the block is a suffix, and its hash, with that of the first bytes, selects a bucket.
3. The strings of a bucket are compared with the text directly.

Items shorter than a window are one string each. Strings of equally many words are searched together, so that
few short ones do not shorten everyone's skips.
"""

from __future__ import annotations

import uuid
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tierspark.llm.common import pick, sliced, stored

WINDOW = 10
# Bytes of items' texts that one scan of the documents searches for, on average; more items take more scans.
ITEMS_AT_ONCE = 32 << 20
TABLE_BITS = 20
# Bytes of a text that are searched by one cursor.
LANE = 2048
MIX = np.uint64(0x9E3779B97F4A7C15)

# Words are letters and digits of ASCII and everything beyond ASCII; A-Z count as a-z, other bytes as a space.
SPACE, LINE = 0x20, 0x0A
LOWERED = np.full(256, SPACE, np.uint8)
for _first, _last, _step in ((0x30, 0x39, 0), (0x41, 0x5A, 0x20), (0x61, 0x7A, 0), (0x80, 0xFF, 0)):
    LOWERED[_first : _last + 1] = np.arange(_first, _last + 1) + _step


class Words:
    """Texts as one buffer of words with a space on both sides, a line feed before each text.

    ``starts``: where each word starts in ``data``; ``first``: the number of each text's first word, and of all words.
    """

    def __init__(self, texts: list[bytes]):
        gap = b"\0\0\0"  # ends the word before, then the line feed and the space that every text begins with
        raw = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        gaps = np.concatenate([[0], np.cumsum(lengths + 3)])
        data = LOWERED[raw]
        keep = data != SPACE
        keep[1:] |= keep[:-1].copy()
        keep[gaps + 1] = keep[gaps + 2] = True
        data[gaps + 1] = LINE
        self.data = data[keep]
        inside = self.data > SPACE
        self.starts = np.flatnonzero(inside[1:] & ~inside[:-1]) + 1
        lines = np.flatnonzero(self.data == LINE)
        self.first = np.searchsorted(self.starts, lines)

    def windows(self, text: int, window: int) -> Iterator[tuple[int, bytes]]:
        """The windows of a text with their numbers of words."""
        first, last = self.first[text], self.first[text + 1]
        size = min(window, last - first)
        for i in range(first, last - size + 1) if size else ():
            # The byte after a word is its space; the next word, or text, starts behind that.
            end = self.starts[i + size] if i + size < last else self._end(text)
            yield int(size), self.data[self.starts[i] - 1 : end].tobytes()

    def _end(self, text: int) -> int:
        last = self.starts[self.first[text + 1] - 1]
        return int(last + np.argmax(self.data[last:] == SPACE) + 1)


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as a number; ``data`` is padded by eight bytes."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


class Search:
    """Wu-Manber tables of strings of the same number of words."""

    def __init__(self, strings: list[bytes], words: int):
        self.words, self.strings = words, sorted(strings)
        self.number = {s: i for i, s in enumerate(self.strings)}
        self.least = min(map(len, self.strings))
        self.longest = max(map(len, self.strings))
        self.block = min(8, max(1, self.least // 2))
        self.mask = np.uint64((1 << 8 * self.block) - 1)
        data = np.frombuffer(b"".join(self.strings) + bytes(8), np.uint8)
        starts = np.cumsum([0, *map(len, self.strings[:-1])])
        eights, self.last = _eights(data), self.least - self.block
        self.shift = np.full(1 << TABLE_BITS, self.last + 1, np.int64)
        for place in range(self.last + 1):
            self.shift[self._hash(eights[starts + place])] = self.last - place
        chosen = self._bucket(eights[starts], eights[starts + self.last])
        order = np.argsort(chosen, kind="stable")  # keeps the strings of a bucket in order
        self.buckets, first = np.unique(chosen[order], return_index=True)
        self.held = [[self.strings[i] for i in part] for part in np.split(order, first[1:])]

    def _hash(self, eights: np.ndarray) -> np.ndarray:
        return ((eights & self.mask) * MIX >> np.uint64(64 - TABLE_BITS)).astype(np.int64)

    def _bucket(self, prefix: np.ndarray, suffix: np.ndarray) -> np.ndarray:
        return (suffix & self.mask) * MIX ^ (prefix & self.mask)

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the strings start in ``data``, and the number of the string there."""
        last = len(data) - self.least  # the last place where one can start
        padded = np.concatenate([data, np.zeros(8, np.uint8)])
        eights = _eights(padded)
        at = np.arange(0, max(0, last + 1), LANE)
        ends = np.minimum(at + LANE, last + 1)
        hits = []
        while len(at):
            shift = self.shift[self._hash(eights[at + self.last])]
            zero = shift == 0
            if zero.any():
                hits.append(at[zero])
            at = at + np.maximum(shift, 1)
            on = at < ends
            at, ends = at[on], ends[on]
        hits = np.sort(np.concatenate(hits)) if hits else np.zeros(0, np.int64)
        keys = self._bucket(eights[hits], eights[hits + self.last])
        buckets = np.minimum(np.searchsorted(self.buckets, keys), len(self.buckets) - 1)
        right = self.buckets[buckets] == keys
        places, found, raw = [], [], data.tobytes() if right.any() else b""
        for place, bucket in zip(hits[right].tolist(), buckets[right].tolist()):
            held, text = self.held[bucket], raw[place : place + self.longest]
            i = bisect_right(held, text) - 1  # of strings of as many words only this one can be a prefix of the text
            if i >= 0 and text.startswith(held[i]):
                places.append(place)
                found.append(self.number[held[i]])
        return np.array(places, np.int64), np.array(found, np.int64)


class Benchmark:
    """The searches for all windows of some items, and the items of each window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        words, owners = Words([text for _, text in items]), defaultdict(set)
        for i, (item, _) in enumerate(items):
            for found in words.windows(i, window):
                owners[found].add(item)
        by_size = defaultdict(list)
        for size, string in owners:
            by_size[size].append(string)
        self.searches = [Search(strings, size) for size, strings in sorted(by_size.items())]
        self.owners = [[owners[s.words, string] - {None} for string in s.strings] for s in self.searches]

    def judge(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict[int, list[tuple[int, int]]], dict[int, list[str]]]:
        """Per text its words and those that are hit; per text that is hit the runs of these words and the items."""
        words = Words(texts)
        edges, items = np.zeros(len(words.starts) + 1, np.int64), defaultdict(set)
        for search, owners in zip(self.searches, self.owners):
            places, strings = search.occurrences(words.data)
            first = np.searchsorted(words.starts, places + 1)
            edges += np.bincount(first, minlength=len(edges))
            edges -= np.bincount(first + search.words, minlength=len(edges))
            owned = np.searchsorted(words.first, first, "right") - 1
            for text, string in set(zip(owned.tolist(), strings.tolist())):
                items[text] |= owners[string]
        hit = np.cumsum(edges[:-1]) > 0
        upto = np.concatenate([[0], np.cumsum(hit)])
        n_hit = np.diff(upto[words.first])
        runs = {}
        for text in np.flatnonzero(n_hit).tolist():
            turns = np.flatnonzero(np.diff(hit[words.first[text] : words.first[text + 1]].astype(np.int8), prepend=0, append=0))
            runs[text] = list(zip(turns[::2].tolist(), (turns[1::2] - 1).tolist()))
        return np.diff(words.first), n_hit, runs, {text: sorted(found) for text, found in items.items()}


class _Held:
    """Items on their way to the workers; equal to itself only, so that a worker builds its tables once."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.token, self.items, self.window = uuid.uuid4().hex, items, window

    def __hash__(self) -> int:
        return hash(self.token)

    def __eq__(self, other: object) -> bool:
        return isinstance(other, _Held) and other.token == self.token


@lru_cache(maxsize=1)
def _built(held: _Held) -> Benchmark:
    return Benchmark(held.items, held.window)


def _scan(rows: DataFrame, held: _Held) -> DataFrame:
    kept = [(f.name, to_arrow_type(f.dataType)) for f in rows.schema if f.name != "_text"]
    runs_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))
    added = [("n_words", pa.int64()), ("n_hit", pa.int64()), ("spans", runs_type), ("items", pa.list_(pa.string()))]
    target, names, place = pa.schema([*kept, *added]), rows.columns, rows.columns.index("_text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        benchmark = _built(held)
        for batch in sliced(batches, place):
            texts = [text or b"" for text in batch.column(place).to_pylist()]
            n_words, n_hit, runs, items = benchmark.judge(texts)
            spans = [[{"first": a, "last": b} for a, b in runs.get(i, ())] for i in range(len(texts))]
            columns = [batch.column(i) for i in range(len(names)) if i != place]
            columns += [pa.array(n_words), pa.array(n_hit), pa.array(spans, runs_type)]
            columns.append(pa.array([items.get(i, []) for i in range(len(texts))], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, schema=target)

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "_text")
    shape = "n_words bigint, n_hit bigint, spans array<struct<first: bigint, last: bigint>>, items array<string>"
    return rows.mapInArrow(run, f"{own}, {shape}")


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    item_key: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    at_once: int = ITEMS_AT_ONCE,
) -> DataFrame:
    """``(key, n_words, n_hit, spans, items)`` for every row of ``docs``, repeated ones too.

    Words are runs of ASCII letters, digits and characters beyond ASCII; A-Z count as a-z; a NULL text has none.
    A word is hit if it lies in an occurrence of ``window`` consecutive words of an item; an item of fewer words
    is one window, one without words is none. ``spans`` are the runs of hit words (numbers from 0, both
    included); ``items`` the ids of the items with an occurrence, as text, sorted. Equal items count by their
    ids; an item without an id hits words but is not named.

    Items are sent to the tasks ``at_once`` bytes of text at a time. If there are more, the documents are
    scanned once for each such part, and the hits of a text are put together.
    """
    items = pick(benchmark, item=item_key, _text=item_text).where("_text IS NOT NULL").select(
        F.col("item").cast("string"), F.col("_text").cast("binary").alias("_text")
    ).distinct()
    rows = pick(docs, _key=key, _text=text).withColumn("_text", F.col("_text").cast("binary"))
    total = items.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = max(1, -(-total // at_once))
    if parts > 1:
        items = stored(items.withColumn("part", F.pmod(F.xxhash64("item", "_text"), F.lit(parts))), "items")
        rows = rows.withColumn("_sha", F.sha2("_text", 256))

    def scan(part: int) -> DataFrame:
        own = items.where(F.col("part") == part) if parts > 1 else items
        return _scan(rows, _Held([(r.item, bytes(r._text)) for r in own.toLocalIterator()], window))

    found = scan(0)
    if parts > 1:
        found = stored(found, "scan")
        # Rows with the same text have the same hits; only texts that are hit are put together.
        hits = [stored(f.where("n_hit > 0").select("_sha", "spans", "items").distinct(), "scan") for f in map(scan, range(1, parts))]
        hits.append(found.where("n_hit > 0").select("_sha", "spans", "items").distinct())
        every = hits[0]
        for more in hits[1:]:
            every = every.unionByName(more)
        joined = every.groupBy("_sha").agg(
            _merged(F.flatten(F.collect_list("spans"))).alias("spans"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
        joined = joined.withColumn("n_hit", F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["last"] - s["first"] + 1))
        found = found.select("_key", "n_words", "_sha").join(joined, "_sha", "left").select(
            "_key", "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
            F.coalesce("spans", F.expr("CAST(array() AS array<struct<first: bigint, last: bigint>>)")).alias("spans"),
            F.coalesce("items", F.expr("CAST(array() AS array<string>)")).alias("items"),
        )
    return found.withColumnRenamed("_key", key)


def _merged(spans: Column) -> Column:
    """Spans sorted, those that overlap or touch made one."""
    none = F.expr("CAST(array() AS array<struct<first: bigint, last: bigint>>)")

    def add(done, span):
        last = F.try_element_at(done, F.lit(-1))
        joined = F.struct(last["first"].alias("first"), F.greatest(last["last"], span["last"]).alias("last"))
        before = F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))
        touches = F.coalesce(last["last"] + 1 >= span["first"], F.lit(False))
        return F.when(touches, F.concat(before, F.array(joined))).otherwise(F.concat(done, F.array(span)))

    return F.aggregate(F.array_sort(spans), none, add)
