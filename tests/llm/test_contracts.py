"""The registered queries against brute force on the smallest tables."""

import hashlib
import re
import zlib

import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from tokenizers import Tokenizer

import __spark_entry__ as contract
from checks.compare import difference, expected
from tierspark.llm.oracles import ORACLES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def rows_of(spark, name, key="doc_id"):
    return {row[key]: row.asDict() for row in contract.queries()[name](spark, SF).collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    df = contract.queries()[name](spark, SF)
    assert difference(df.columns, df.collect(), *expected(SF, ORACLES[name])) is None


def test_bpe(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = rows_of(spark, "op4_bpe")
    assert len(found) == len(documents)
    for doc in documents:
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids
        decoded = tokenizer.decode(ids, skip_special_tokens=False)
        assert found[doc["doc_id"]] == {
            "doc_id": doc["doc_id"],
            "n_tokens": len(ids),
            "ids_sha256": hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(),
            "decoded_sha256": hashlib.sha256(decoded.encode()).hexdigest(),
        }


def check_sequences(rows, capacity=2048):
    places = {}
    for row in rows:
        places.setdefault(row["sequence_id"], []).append((row["offset"], row["length"]))
    for parts in places.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(places)


def test_packing(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    rows = [row.asDict() for row in contract.queries()["op5_packing"](spark, SF).collect()]
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want, total = {}, 0
    for doc in documents:
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [0]
        total += len(ids)
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            raw = b"".join(i.to_bytes(4, "little") for i in part)
            want[doc["doc_id"], piece] = (start, len(part), zlib.crc32(raw))
    assert got == want and len(rows) == len(want)
    assert check_sequences(rows) <= 1.1 * -(-total // 2048) + 1


def test_token_ids(spark, documents):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found, at = rows_of(spark, "op7_token_ids"), 0
    for doc in sorted(documents, key=lambda d: d["doc_id"]):
        ids = tokenizer.encode(doc["text"] or "", add_special_tokens=False).ids + [2]
        raw = b"".join(i.to_bytes(4, "little") for i in ids)
        want = {"doc_id": doc["doc_id"], "start": at, "n_tokens": len(ids), "ids_crc32": zlib.crc32(raw)}
        assert found[doc["doc_id"]] == want
        at += len(ids)


def test_quality_held_out(spark):
    found = rows_of(spark, "op6_quality")
    labels = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{SF}/labels.parquet").to_pylist()}
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in found.values())
    assert all(r["held_out"] == (zlib.crc32(str(k).encode()) % 5 == 0) for k, r in found.items())
    held = [k for k, r in found.items() if r["held_out"] and k in labels]
    assert sum(found[k]["predicted"] == labels[k] for k in held) >= 0.8 * len(held)


PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    def luhn(digits):
        return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0

    spans = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m[0])
            good = {
                "email": True,
                "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else None,
                "card": 12 <= len(digits) <= 19 and luhn(digits) if digits else False,
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                spans.append((m.start(), list(PLAIN).index(kind), m.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(spans)]


def test_pii(spark, documents):
    found = rows_of(spark, "op8_pii")
    for doc in documents:
        base = [f"{k}:{a}:{b}" for k, a, b in plain_spans(doc["text"] or "")]
        row = found[doc["doc_id"]]
        assert row["base_sha256"] == hashlib.sha256(",".join(base).encode()).hexdigest()
        assert set(base) <= set(row["spans"].split(",")) or not base
        assert [row[f"n_{k}"] for k in PLAIN] == [sum(b.startswith(k + ":") for b in base) for k in PLAIN]


def brute_fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, documents):
    found = rows_of(spark, "op9_simhash")
    prints = {d["doc_id"]: brute_fingerprint(d["text"] or "") for d in documents}
    root = {k: k for k in prints}

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in prints:
        for b in prints:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    for k, fp in prints.items():
        assert found[k] == {"doc_id": k, "fingerprint": f"{fp:016x}", "component_id": top(k)}
