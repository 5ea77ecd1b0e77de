"""Phrase collocations by stripes.

A stripe belongs to a prefix and counts the words that follow it; round n counts the words after prefixes of n words.
Each task counts a bounded number of words and emits their stripes. Merging the stripes of a prefix elementwise yields
at once the counts of its extensions, the prefix's own total and its greatest extension, which may subsume it.

A phrase is frequent only if the phrases without its first and without its last word are. Tasks therefore count
only what may be frequent, by a bitset of the hashes of the round before, whose size is bounded; all other words count
as one, so that totals stay whole. A phrase that passes by chance is counted and found to be rare: nothing is lost.

The stripe of the empty prefix, and those of prefixes with a thousandth of all words, which are a thousand at most,
are split by the hash of the next word, so that no task merges a very common prefix alone.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tierspark.llm.common import pick, sliced, stored

LEAST, LONGEST, TOP, SUBSUMED = 10, 3, 2000, 50
UNKNOWN = "und"
# Words that a task counts before it emits stripes, the parts of a large stripe, and the share that makes it large.
AT_ONCE, PARTS, LARGE = 1 << 21, 256, 1000
# Rows and bytes of stripes that are merged at once.
ROWS, BYTES = 1 << 15, 8 << 20
# Bits per frequent phrase in the bitset, and the most bits of it (32 MB) however many there are.
BITS_EACH, MOST_BITS = 16, 1 << 28
# Parts in which the first phrases of a language are found before they meet.
SALT = 64

# Bytes as words are cut at them: fixed values.
WORD, BLANK, CUT = 0, 1, 2
KIND = np.zeros(256, np.uint8)
KIND[list(b" \t")] = BLANK
KIND[list(b".,;:!?\n\x0b\x0c\r")] = CUT
LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32


class Words:
    """The words of texts: their bytes in a row, their lengths, and whether each is the last of its piece."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        kind = KIND[raw]
        inside = kind == WORD
        turns = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0))
        starts, ends = turns[::2], turns[1::2]
        self.data, self.lengths = LOWERED[raw[inside]], ends - starts
        pieces = np.searchsorted(np.flatnonzero(kind == CUT), starts)
        self.last = np.diff(pieces, append=-1) != 0


def _strings(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(lengths) + 1, np.int64)
    np.cumsum(lengths, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(lengths), [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def _joined(strings: pa.Array, runs: np.ndarray) -> pa.Array:
    """Neighbouring strings joined, each followed by a space: one text per run, from the number of its first string on."""
    spaced = pc.binary_join_element_wise(strings, pa.scalar(b"", pa.large_binary()), pa.scalar(b" ", pa.large_binary()))
    offsets = np.frombuffer(spaced.buffers()[1], np.int64, len(strings) + 1, spaced.offset * 8)
    ends = np.append(runs, len(strings))
    return pa.Array.from_buffers(pa.large_binary(), len(runs), [None, pa.py_buffer(offsets[ends].copy()), spaced.buffers()[2]])


class Bitset:
    """Bits by the hash of a phrase, from the rows of :func:`_bitset`."""

    def __init__(self, rows: list[tuple[int, bytes]], bits: int):
        self.bits, self.held = bits, np.zeros(max(8, bits // 8), np.uint8)
        for number, raw in rows:
            part = self.held[number * 4096 : (number + 1) * 4096]
            part[:] = np.frombuffer(raw, np.uint8)[: len(part)]

    def has(self, hashes: np.ndarray) -> np.ndarray:
        at = hashes & np.uint64(self.bits - 1)
        return (self.held[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _hash_column(size: int) -> Column:
    """The hash of a phrase of ``size`` words, as :func:`_hashes` has it."""
    words, value = F.split("phrase", " "), F.xxhash64("lang")
    for place in range(size):
        turned = F.shiftleft(value, 7).bitwiseXOR(F.shiftrightunsigned(value, 57))
        value = turned.bitwiseXOR(F.xxhash64(F.get(words, F.lit(place))))
    return value


def _hashes(lang: str, words: list[np.ndarray]) -> np.ndarray:
    value = np.full(len(words[0]), xxhash.xxh64_intdigest(lang.encode(), 42), np.uint64)
    for word in words:
        value = (value << np.uint64(7)) ^ (value >> np.uint64(57)) ^ word
    return value


def stripes_of(lang: str, words: list[Words], size: int, frequent: Bitset | None, large: np.ndarray) -> pa.RecordBatch:
    """The stripes of all prefixes of ``size`` words: ``(lang, prefix, part, nexts, counts)``.

    ``nexts`` are words, each followed by a space. Without ``frequent`` only the empty prefix counts; with it, only prefixes in
    it, and the empty word stands for the end of a piece and for words that end no phrase in it. ``large`` are
    the hashes of prefixes whose stripes are split.
    """
    coded = _strings(np.concatenate([w.data for w in words]), np.concatenate([w.lengths for w in words])).dictionary_encode()
    ids, ends = coded.indices.to_numpy().astype(np.int64), np.concatenate([w.last for w in words])
    vocabulary, n = pa.concat_arrays([coded.dictionary, pa.array([b""], pa.large_binary())]), len(coded.dictionary)
    hashes = np.array([xxhash.xxh64_intdigest(word, 42) for word in vocabulary.to_pylist()], np.uint64)
    parts = (hashes >> np.uint64(32)).astype(np.int64) % PARTS
    if frequent is None:
        prefix, following, names, split = np.zeros(len(ids), np.int64), ids, pa.array([""]), np.ones(1, bool)
    else:
        inside = np.ones(len(ids) - size + 1, bool)  # words that start a phrase within their piece
        for i in range(size - 1):
            inside &= ~ends[i : i + len(inside)]
        good = np.zeros(len(ids) + 1, bool)
        starts = np.flatnonzero(inside)
        good[starts] = frequent.has(_hashes(lang, [hashes[ids[starts + i]] for i in range(size)]))
        starts = starts[good[starts]]
        goes_on = good[starts + 1] & ~ends[starts + size - 1]
        following = np.where(goes_on, ids[np.minimum(starts + size, len(ids) - 1)], n)
        # Prefixes by number: pairs of the number of the prefix one word shorter and the next word.
        prefix = np.zeros(len(starts), np.int64)
        for i in range(size):
            _, first, prefix = np.unique(prefix * n + ids[starts + i], return_index=True, return_inverse=True)
        chosen = [ids[starts[first] + i] for i in range(size)]
        split = np.isin(_hashes(lang, [hashes[own] for own in chosen]), large)
        names = pc.binary_join_element_wise(*[vocabulary.take(pa.array(own)) for own in chosen], pa.scalar(b" ", pa.large_binary()))
        names = names.cast(pa.large_string()).cast(pa.string())
    groups = prefix * PARTS + np.where(split[prefix], parts[following], 0)
    keys, counts = np.unique(groups * (n + 1) + following, return_counts=True)
    groups, nexts = keys // (n + 1), keys % (n + 1)
    runs = np.flatnonzero(np.diff(groups, prepend=-1))
    edges = (np.append(runs, len(keys)) * 8).astype(np.int64)
    packed = pa.Array.from_buffers(pa.large_binary(), len(runs), [None, pa.py_buffer(edges), pa.py_buffer(counts.astype("<i8"))])
    columns = [pa.array([lang] * len(runs), pa.string()), names.take(pa.array(groups[runs] // PARTS))]
    columns += [pa.array((groups[runs] % PARTS).astype(np.int32)), _joined(vocabulary.take(pa.array(nexts)), runs).cast(pa.binary())]
    return pa.RecordBatch.from_arrays([*columns, packed.cast(pa.binary())], ["lang", "prefix", "part", "nexts", "counts"])


def _stripes(rows: DataFrame, size: int, frequent: Bitset | None, large: np.ndarray) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[Words]] = {}
        count = 0
        for batch in sliced(batches, 0):
            texts = np.array(batch.column(0).to_pylist(), object)
            langs = np.array(batch.column(1).to_pylist(), object)
            for lang in dict.fromkeys(langs.tolist()):
                words = Words(texts[langs == lang].tolist())
                if len(words.lengths):
                    held.setdefault(lang, []).append(words)
                    count += len(words.lengths)
            if count >= AT_ONCE:
                for lang, words in held.items():
                    yield stripes_of(lang, words, size, frequent, large)
                held, count = {}, 0
        for lang, words in held.items():
            yield stripes_of(lang, words, size, frequent, large)

    return rows.mapInArrow(run, "lang string, prefix string, part int, nexts binary, counts binary")


def _merged(stripes: DataFrame, least: int) -> DataFrame:
    """Stripes of the same prefix and part merged: ``(lang, prefix, next, n)``.

    ``n`` is a merged stripe's total where ``next`` is NULL, else the count of an extension that has ``least``.
    Rows of a stripe come one after the other, and are merged as they come; what is held is one merged stripe.
    """
    target = pa.schema([("lang", pa.string()), ("prefix", pa.string()), ("next", pa.string()), ("n", pa.int64())])
    keys = ["lang", "prefix", "part"]

    def merge(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Of rows in order: the first row of each stripe, and by stripe and word the counts."""
        same = np.ones(table.num_rows - 1, bool)
        for name in keys:
            column = table[name].combine_chunks()
            same &= pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False)
        stripe = np.append(0, np.cumsum(~same))
        nexts, counts = table["nexts"].combine_chunks(), table["counts"].combine_chunks()
        sizes = pc.binary_length(counts).to_numpy().astype(np.int64) // 8
        data = np.frombuffer(b"".join(nexts.to_pylist()), np.uint8)
        space = data == 0x20
        lengths = np.diff(np.flatnonzero(space), prepend=-1) - 1
        coded = _strings(data[~space], lengths).dictionary_encode()
        n = max(1, len(coded.dictionary))
        found, places = np.unique(np.repeat(stripe, sizes) * n + coded.indices.to_numpy(), return_inverse=True)
        sums = np.zeros(len(found), np.int64)
        np.add.at(sums, places, np.frombuffer(b"".join(counts.to_pylist()), "<i8"))
        return np.flatnonzero(np.append(True, ~same)), found // n, sums, coded.dictionary.take(pa.array(found % n))

    def result(table: pa.Table, first: np.ndarray, stripe: np.ndarray, sums: np.ndarray, nexts: pa.Array) -> pa.RecordBatch:
        totals = np.zeros(len(first), np.int64)
        np.add.at(totals, stripe, sums)
        ended = pc.equal(pc.binary_length(nexts), 0).to_numpy(zero_copy_only=False)
        large = np.flatnonzero((sums >= least) & ~ended)
        rows = pa.array(np.concatenate([first, first[stripe[large]]]))
        words = nexts.take(pa.array(large)).cast(pa.large_string()).cast(pa.string())
        columns = [table["lang"].combine_chunks().take(rows), table["prefix"].combine_chunks().take(rows)]
        columns += [pa.concat_arrays([pa.nulls(len(first), pa.string()), words]), pa.array(np.concatenate([totals, sums[large]]))]
        return pa.RecordBatch.from_arrays(columns, schema=target)

    def one_row(table: pa.Table, sums: np.ndarray, nexts: pa.Array) -> pa.Table:
        joined = _joined(nexts, np.zeros(1, np.int64)).cast(pa.binary())
        columns = [table[name].slice(0, 1) for name in keys] + [joined, pa.array([sums.astype("<i8").tobytes()], pa.binary())]
        return pa.table(columns, names=table.column_names)

    def gathered(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.Table]:
        held, rows, size = [], 0, 0
        for batch in batches:
            held.append(batch)
            rows, size = rows + len(batch), size + batch.nbytes
            if rows >= ROWS or size >= BYTES:
                yield pa.Table.from_batches(held)
                held, rows, size = [], 0, 0
        if held:
            yield pa.Table.from_batches(held)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for table in gathered(batches):
            table = table if held is None else pa.concat_tables([held, table])
            first, stripe, sums, nexts = merge(table)
            open_from = int(np.searchsorted(stripe, len(first) - 1))  # the last stripe may go on
            held = one_row(table.slice(int(first[-1])), sums[open_from:], nexts[open_from:])
            if len(first) > 1:
                yield result(table, first[:-1], stripe[:open_from], sums[:open_from], nexts[:open_from])
        if held is not None:
            yield result(held, *merge(held))

    ordered = stripes.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, "lang string, prefix string, next string, n bigint")


def _bitset(phrases: DataFrame, size: int) -> Bitset:
    """The hashes of frequent phrases as bits: a power of two, bounded by :data:`MOST_BITS`."""
    wanted = phrases.count() * BITS_EACH
    bits = min(MOST_BITS, 1 << max(15, (wanted - 1).bit_length()))
    at = _hash_column(size).bitwiseAND(F.lit(bits - 1))
    rows = phrases.select(F.shiftright(at, 15).alias("part"), at.bitwiseAND(F.lit((1 << 15) - 1)).alias("bit"))
    found = rows.groupBy("part").agg(F.bitmap_construct_agg("bit").alias("bits"))
    return Bitset([(r.part, bytes(r.bits)) for r in found.toLocalIterator()], bits)


def _large(phrases: DataFrame, size: int, total: int) -> np.ndarray:
    """The hashes of the phrases with a thousandth of all words; there are a thousand at most."""
    found = phrases.where(F.col("a") * LARGE >= F.lit(total)).select(_hash_column(size).alias("hash"))
    return np.array([r.hash for r in found.collect()], np.int64).view(np.uint64)


def collocations(
    docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP, subsumed: int = SUBSUMED
) -> DataFrame:
    """``(lang, rank, phrase, a, l, r, n, score)``: each language's first ``top`` collocations.

    Texts are cut into pieces at .,;:!? and line ends, pieces into words at spaces and tabs; A-Z count as a-z. NULL is
    the empty text, and a NULL language ``und``. Candidates are phrases of 2 to ``longest`` words that
    occur ``least`` times (``a``). The score of a cut is floor(1000000 a a / (l r)) for the counts of both parts; the
    lowest cut counts, ties to the shortest first part. A candidate inside a longer one with
    at least ``subsumed`` percent of its occurrences is left out. ``n`` are all words of the language.
    Counts are exact below 10^15.
    """
    rows = pick(docs, _text=text, _lang=lang).select(
        F.coalesce("_text", F.lit("")).cast("binary").alias("_text"), F.coalesce("_lang", F.lit(UNKNOWN)).alias("_lang")
    )
    merged = stored(_merged(_stripes(rows, 0, None, np.zeros(0, np.uint64)), least), "stripes")
    totals = stored(merged.where("next IS NULL").groupBy("lang").agg(F.sum("n").alias("n")), "totals")
    total = totals.agg(F.sum("n")).first()[0] or 0
    extensions, counts = merged.where("next IS NOT NULL").select("lang", F.col("next").alias("phrase"), F.col("n").alias("a")), []
    for size in range(1, longest):
        stripes = _stripes(rows, size, _bitset(extensions, size), _large(extensions, size, total))
        merged = stored(_merged(stripes, least), "stripes")
        prefixes = merged.where("next IS NULL").groupBy("lang", F.col("prefix").alias("phrase")).agg(F.sum("n").alias("a"))
        counts.append(prefixes.where(F.col("a") >= least).withColumn("size", F.lit(size)))
        extensions = merged.where("next IS NOT NULL").select("lang", F.concat_ws(" ", "prefix", "next").alias("phrase"), F.col("n").alias("a"))
    known = extensions.withColumn("size", F.lit(longest))
    for more in counts:
        known = known.unionByName(more)
    return _first(_scored(stored(known, "phrases"), subsumed), top).join(totals, "lang").select(
        "lang", "rank", "phrase", "a", "l", "r", "n", "score"
    )


def _scored(counts: DataFrame, subsumed: int) -> DataFrame:
    """Candidates that no longer one subsumes, with their lowest cut."""
    split = F.split("phrase", " ")
    candidates = counts.where("size > 1")
    cut = candidates.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("size") - 1))).select(
        "lang", "phrase", "a", "k",
        F.array_join(F.slice(split, F.lit(1), F.col("k")), " ").alias("head"),
        F.array_join(F.slice(split, F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("rest"),
    )
    left = counts.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l"))
    right = counts.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r"))
    wide = lambda c: F.col(c).cast("decimal(16,0)")
    square = (wide("a") * wide("a")).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")
    scored = cut.join(left, ["lang", "head"]).join(right, ["lang", "rest"])
    scored = scored.withColumn("_square", square).withColumn("_product", (wide("l") * wide("r")).cast("decimal(38,0)"))
    scored = scored.withColumn("score", F.expr("CAST(_square div _product AS bigint)"))
    lowest = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("_cut"))
    # What a phrase's extensions to the right and to the left reach at most. Any longer one occurs less often.
    shorter = [F.array_join(F.slice(split, F.lit(start), F.col("size") - 1), " ") for start in (1, 2)]
    inside = candidates.where("size > 2").select("lang", "a", F.explode(F.array(*shorter)).alias("phrase"))
    greatest = inside.groupBy("lang", "phrase").agg(F.max("a").alias("_longer"))
    kept = lowest.join(greatest, ["lang", "phrase"], "left").where(
        F.col("_longer").isNull() | (F.col("_longer") * 100 < F.col("a") * subsumed)
    )
    return kept.select("lang", "phrase", "a", "_cut.l", "_cut.r", "_cut.score")


def _first(scored: DataFrame, top: int) -> DataFrame:
    """Each language's first rows; parts of a language are cut to as many before they meet."""
    best = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = scored.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALT)))
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*best))).where(F.col("rank") <= top)
    ranked = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*best)).cast("bigint"))
    return ranked.where(F.col("rank") <= top)
