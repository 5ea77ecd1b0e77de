"""The pipeline, stage by stage, against plain Python over a small corpus with copies, junk, NULLs and repeated rows."""

import hashlib
import re
import zlib

import public_tokenizers
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_contracts import brute_fingerprint, check_sequences, plain_spans
from tierspark.llm import crf_pii, nbsvm
from tierspark.llm.common import table

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i % 97} and more{i % 13}" for i in range(400))
NAMES = ["doc_id", "text", "lang", "source", "n_chars"]


def corpus():
    rows = [tuple(r[n] for n in NAMES) for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()]
    some = [r for r in rows if r[1] and len(r[1]) > 400][:12]
    extra = [(5000 + i, r[1].replace(" ", "  ", 3), "en", "copy", 1) for i, r in enumerate(some)]
    extra += [(-5 - i, r[1] + " end", "en", "near", 1) for i, r in enumerate(some)]
    extra += [some[0], some[0], (some[1][0], some[2][1], "en", "reused id", 3)]
    extra += [(None, some[3][1], "en", "lost id", 1), (None, some[3][1], "en", "lost id", 1), (None, LONG, None, None, None)]
    extra += [(7001, None, "en", "x", None), (7002, "", "en", "x", 0), (7003, " \t\n", "en", "x", 3), (7004, LONG, "en", "x", 1)]
    extra += [(7005, f" write to eve.adams@post.example.com or +1 (415) 555-0199. {LONG} tail", "en", "x", 1)]
    return rows + extra


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("corpus")
    columns = list(zip(*corpus()))
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=NAMES), path / "documents.parquet")
    pq.write_table(pq.read_table(f"{SF}/labels.parquet"), path / "labels.parquet")
    return str(path)


def key_of(row):
    return (row[0] is None, row[0] or 0, hashlib.sha256((row[1] or "").encode()).digest())


def plain_quality(rows, model):
    features = nbsvm.Features()
    return [r for r in rows if model.score(next(iter(features.of(pa.array([r[1]], pa.string()))))) >= 0.3]


def first_of_groups(rows, group_of):
    best = {}
    for row, group in zip(rows, group_of):
        best[group] = min(best.get(group, row), row, key=key_of)
    return list(best.values())


def plain_exact(rows):
    return first_of_groups(rows, [re.sub("[\x20\x09-\x0d]+", " ", r[1] or "") for r in rows])


def plain_near(rows):
    prints = [brute_fingerprint(r[1] or "") for r in rows]
    root = list(range(len(rows)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[top(i)] = top(j)
    return first_of_groups(rows, [top(i) for i in range(len(rows))])


def plain_pii(rows):
    done = []
    for key, text, *rest, n_chars in rows:
        if text is not None:
            (_, base, spans), = crf_pii._spans(pa.array([text]), crf_pii.LABELLED)
            assert [(k, a, b) for a, b, k in base] == plain_spans(text) and set(base) <= set(spans)
            text = crf_pii.masked(text, spans)
        done.append((key, text, *rest, None if text is None else len(text)))
    return done


def bag(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def test_every_stage_and_the_whole(spark, folder):
    docs, want = table(spark, folder, "documents"), corpus()
    model = nbsvm.train(docs, table(spark, folder, "labels"))
    plain = [lambda rows: plain_quality(rows, model), plain_exact, plain_near, plain_pii]
    assert [name for name, _ in corpus_pipeline.STAGES][2] == "SimHash near-dedup"
    for (name, stage), brute in zip(corpus_pipeline.STAGES, plain):
        found, want = stage(spark, docs, folder), brute(want)
        assert found.columns == NAMES
        docs = spark.createDataFrame(found.collect(), docs.schema)
        assert bag(docs.collect()) == bag(want), name
    assert any(r[3] == "copy" for r in corpus()) and 5 < len(want) < len(corpus())

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = []
    for key, text, *_ in want:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            pieces.append((key, piece, start, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))))
    rows = [r.asDict() for r in corpus_pipeline.run(spark, folder).collect()]
    assert bag((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == bag(pieces)
    assert check_sequences(rows) <= 1.1 * -(-sum(p[3] for p in pieces) // 2048) + 1


@pytest.mark.parametrize("number", range(4))
def test_clashing_names_and_empty_tables(spark, folder, number):
    name, stage = corpus_pipeline.STAGES[number]
    docs = table(spark, folder, "documents").limit(30)
    clashing = docs.toDF("doc_id", "text", "TEXT", "Doc_Id", "n_chars")
    assert stage(spark, clashing, folder).columns == clashing.columns
    assert stage(spark, clashing, folder).count() == stage(spark, docs, folder).count()
    assert stage(spark, docs.limit(0), folder).count() == 0
