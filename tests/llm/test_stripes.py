"""Collocations against plain counting, with stripes that are cut small."""

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from tierspark.llm import stripes

SCHEMA = "doc_id bigint, text string, lang string, TEXT string, prefix string, n string"


def plain(rows, least=10, longest=3, top=2000, subsumed=50):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang, own = lang if lang is not None else "und", counts.setdefault(lang if lang is not None else "und", Counter())
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in range(1, longest + 1):
                own.update(tuple(words[i : i + size]) for i in range(len(words) - size + 1))
    found = []
    for lang, own in counts.items():
        scored = []
        for phrase, a in own.items():
            if len(phrase) == 1 or a < least:
                continue
            if any(
                100 * b >= subsumed * a
                for other, b in own.items()
                if b >= least and len(other) > len(phrase) and any(other[i : i + len(phrase)] == phrase for i in range(len(other) - len(phrase) + 1))
            ):
                continue
            score, _, l, r = min((1_000_000 * a * a // (own[phrase[:k]] * own[phrase[k:]]), k, own[phrase[:k]], own[phrase[k:]]) for k in range(1, len(phrase)))
            scored.append((-score, -a, " ".join(phrase).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def mined(spark, rows, **options):
    df = spark.createDataFrame([(i, t, g, "x", "y", "z") for i, (t, g) in enumerate(rows)], SCHEMA)
    found = stripes.collocations(df, **options)
    assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    return sorted(tuple(r) for r in found.collect())


def texts(seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "ñé", "a-b", "...x", "東京", "…", *(f"w{i}" for i in range(30))]
    marks = [" "] * 12 + ["\t", "  ", ", ", ".", "!?", "\n", "\r\n", " ", "\x0b", "\x00"]
    rows = []
    for _ in range(60):
        n = rng.choice([0, 1, 2, 3, 50, 400])
        rows.append(("".join(rng.choice(vocabulary[: rng.choice([3, 8, 38])]) + rng.choice(marks) for _ in range(n)), rng.choice(["en", "en", "en", "fr", None, ""])))
    return rows + [(None, "en"), ("", "de"), (" \t ", "de"), ("the of " * 20_000, "en"), ("New York City. " * 12, "en"), ("x y z " * 9, "en")]


@pytest.mark.parametrize("seed,longest", [(1, 3), (2, 3), (3, 2), (4, 4)])
def test_equals_plain_counting(spark, monkeypatch, seed, longest):
    """NULLs, empty and long texts, repeated rows, ties, clashing names; stripes cut, split and merged many times."""
    for name, value in (("AT_ONCE", 500), ("PARTS", 3), ("LARGE", 20), ("ROWS", 7)):
        monkeypatch.setattr(stripes, name, value)
    assert mined(spark, texts(seed), longest=longest) == plain(texts(seed), longest=longest)


def test_few_bits_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(stripes, "MOST_BITS", 8)
    assert mined(spark, texts(5), top=7) == plain(texts(5), top=7)


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, None)]) == []


def test_products_beyond_64_bits(spark):
    """Scores are whole-number divisions of products with up to 38 digits."""
    rows = [("en", "a b", 10**14, 2), ("en", "a", 10**14 + 7, 1), ("en", "b", 3 * 10**14 + 1, 1)]
    found = stripes._scored(spark.createDataFrame(rows, "lang string, phrase string, a bigint, size int"), 50).first()
    assert found.score == 10**6 * 10**28 // ((10**14 + 7) * (3 * 10**14 + 1))


def test_stripes_hold_totals():
    """A stripe counts each occurrence of its prefix, whatever follows."""
    words = [stripes.Words(["a b a c. a b".encode()])]
    batch = stripes.stripes_of("en", words, 0, None, stripes.np.zeros(0, "u8"))
    totals = Counter()
    for row in pa.Table.from_batches([batch]).to_pylist():
        for word, count in zip(row["nexts"].split(b" ")[:-1], stripes.np.frombuffer(row["counts"], "<i8")):
            totals[word.decode()] += int(count)
    assert totals == {"a": 3, "b": 2, "c": 1}
