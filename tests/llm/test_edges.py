"""NULLs, empty and long texts, ties, repeated rows, empty tables and clashing column names."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest

from tierspark.llm import bitpack, bpe_trie, crf_pii, golomb_dedup, nbsvm, packing, simhash, url_rules, warc
from tierspark.llm.packing import OpenBins

SCHEMA = "doc_id bigint, text string, TEXT string, fp string"
ROWS = [
    (1, None, "x", "y"), (2, "", "x", "y"), (3, "one two  three", "x", "y"), (4, "one two three", "x", "y"),
    (4, "one two three", "x", "y"), (None, "alone", "x", "y"), (5, "word " * 30_000, "x", "y"),
]
WORD = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


OPERATORS = {
    "dedup": golomb_dedup.exact_duplicates,
    "simhash": simhash.near_duplicates,
    "pii": crf_pii.find,
    "bpe": lambda d: bpe_trie.digests(d, WORD),
    "ids": lambda d: bitpack.round_trip(d, WORD, 2),
    "score": lambda d: nbsvm.score(d, nbsvm.fit([], np.zeros(0, bool))),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_answer_per_row(docs, name):
    assert OPERATORS[name](docs).count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_empty_table(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_of_equal_texts(docs):
    rows = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in golomb_dedup.exact_duplicates(docs).collect()}
    assert (1, 1, 2, True) in rows and (2, 1, 2, False) in rows
    assert (3, 3, 3, True) in rows and (4, 3, 3, False) in rows and (None, None, 1, True) in rows


def test_golomb_round_trip():
    values = np.unique(np.random.default_rng(1).integers(0, 1 << 58, 5000, dtype=np.uint64))
    for part in (values, values[:1], values[:0]):
        assert np.array_equal(golomb_dedup.from_golomb(golomb_dedup.golomb(part, 0, 1 << 58), 0), part)


@pytest.mark.parametrize("width", [1, 7, 16, 17, 32])
def test_bits_round_trip(width):
    ids = np.random.default_rng(2).integers(0, 1 << width, 10_001, dtype=np.uint32)
    payload, offsets = bitpack.packed(ids, width)
    row = {"width": width, "block": bitpack.BLOCK, "offsets": offsets, "payload": payload, "n_ids": len(ids)}
    assert np.array_equal(bitpack.read_ids(row, 0, len(ids)), ids)
    assert np.array_equal(bitpack.read_ids(row, 5000, 9000), ids[5000:9000])


def test_best_bin_is_the_fullest_that_fits():
    bins = OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0)]


def test_pieces_of_long_documents(docs):
    rows = packing.pack_documents(docs, WORD).collect()
    assert sum(r.length for r in rows) == 30_001 + 3 * 4 + 2 + 2 and max(r.length for r in rows) == 2048


def test_urls(spark):
    urls = spark.createDataFrame([(1, None), (2, "x"), (3, "http://A.example.ORG"), (4, "http://adult-x.com/a")], "page_id int, url string")
    got = [tuple(r) for r in url_rules.judge(urls, [url_rules.PlaceRule("org/", "allow")], [url_rules.PatternRule("^adult-x^")]).collect()]
    assert got == [
        (1, "", "", None, "allow", None), (2, "", "", None, "allow", None),
        (3, "a.example.org", "", None, "allow", None), (4, "adult-x.com", "/a", None, "block", "^adult-x^"),
    ]


def test_warc_files_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a/", "<p>one</p><p>two &amp; three</p>"), (2, None, None)], "page_id int, url string, html string")
    records = warc.derivatives(warc.responses(pages))
    warc.write_warc(records, str(tmp_path / "w"))
    read = {r.headers["WARC-Record-ID"]: r.block for r in warc.read_warc(spark, str(tmp_path / "w")).collect()}
    assert read == {f"<{r.record_id}>": r.block for r in records.collect()}


def test_tags_do_not_depend_on_the_batch():
    texts = ["call (415) 555-0199 now", "plain words only", "", 'token = "ffc3105535f423f352535e4ac53b5fefe076ac6d"']
    tagger = crf_pii.tagger()
    together, offsets = tagger.tags(pa.array(texts))
    for i, text in enumerate(texts):
        alone, _ = tagger.tags(pa.array([text]))
        assert together[offsets[i] : offsets[i + 1]].tolist() == alone.tolist()
