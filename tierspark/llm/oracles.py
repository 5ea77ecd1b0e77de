"""The expected results of those queries that SQL can express."""

from __future__ import annotations

import html
import html.entities

from tierspark.llm.queries import PATTERNS, PLACES
from tierspark.llm.warc import LINES, TAGS, UNSEEN

TOP_K = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
"""

EXACT_DEDUP = """
WITH texts AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS t FROM documents),
grouped AS (
  SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size, t FROM texts)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM grouped
"""


def _url_rules() -> str:
    fits = " ".join(
        f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.rule}'"
        for r in sorted(PLACES, key=lambda r: -len(r.rule))
    )
    verdicts = " ".join(f"WHEN '{r.rule}' THEN '{r.verdict}'" for r in PLACES)
    patterns = " ".join(
        f"WHEN regexp_matches(lower(url), '{p.expression.pattern}') THEN '{p.verdict}'" for p in PATTERNS
    )
    return f"""
WITH cut AS (
  SELECT page_id, url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, url, regexp_extract(rest, '^[^/?#]*') AS raw,
         regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path FROM cut),
ruled AS (SELECT page_id, url, lower(raw) AS host, path, CASE {fits} END AS rule FROM (SELECT *, lower(raw) AS host FROM parts))
SELECT page_id, host, path, rule, CASE rule {verdicts} ELSE CASE {patterns} ELSE 'allow' END END AS verdict FROM ruled
"""


def _references() -> tuple[str, str]:
    """Python's table of character references as SQL values: by name, and numbers that do not stand for themselves."""
    quoted = lambda text: "'" + text.replace("'", "''") + "'"
    named = ", ".join(f"({quoted(name)}, {quoted(chars)})" for name, chars in html.entities.html5.items())
    numbers = [*range(0xA0), *range(0xFDD0, 0xFDF0), *(plane + last for plane in range(0, 0x110000, 0x10000) for last in (0xFFFE, 0xFFFF))]
    odd = [(n, html.unescape(f"&#{n};")) for n in numbers if html.unescape(f"&#{n};") != chr(n)]
    return named, ", ".join(f"({n}, {quoted(chars)})" for n, chars in odd)


def _warc() -> str:
    text = "payload"
    for pattern in UNSEEN:
        text = f"regexp_replace({text}, '{pattern}', '', 'g')"
    text = f"regexp_replace(regexp_replace({text}, '{LINES}', chr(10), 'g'), '{TAGS}', '', 'g')"
    clean = "regexp_replace(t, '[ \\t\\r\\f\\x0B\\x{A0}]+', ' ', 'g')"
    clean = f"regexp_replace(regexp_replace({clean}, ' ?\\n[ \\n]*', chr(10), 'g'), '^[ \\n]+|[ \\n]+$', '', 'g')"
    token = "&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\\t\\n\\f <&#;]{1,32};?)|[^&]+|&"
    uid = lambda e: f"'urn:uuid:' || regexp_replace(md5({e}), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\\1-\\2-\\3-\\4-\\5')"
    end = "chr(13) || chr(10)"
    named, odd = _references()
    return f"""
WITH named(name, chars) AS (VALUES {named}),
odd(n, chars) AS (VALUES {odd}),
source AS (SELECT page_id, coalesce(url, '') AS target_uri, coalesce(html, '') AS payload FROM pages),
responses AS (
  SELECT *, row_number() OVER () AS number, 'sha256:' || sha256(payload) AS payload_digest,
         {uid("'response|' || page_id::VARCHAR || '|' || target_uri || '|sha256:' || sha256(payload)")} AS refers_to FROM source),
cut AS (SELECT number, regexp_extract_all({text}, '{token}') AS tokens FROM responses),
placed AS (SELECT number, unnest(tokens) AS token, generate_subscripts(tokens, 1) AS place FROM cut),
distinct_tokens AS (SELECT DISTINCT token FROM placed WHERE starts_with(token, '&') AND token <> '&'),
digits AS (
  SELECT token, regexp_matches(token, '^&#[xX]') AS hex, ltrim(regexp_replace(token, '^&#[xX]?|;$', '', 'g'), '0') AS d
  FROM distinct_tokens WHERE starts_with(token, '&#')),
numbers AS (
  SELECT token, CASE WHEN length(d) > 9 THEN 9999999 WHEN d = '' THEN 0 WHEN hex THEN ('0x' || d)::BIGINT ELSE d::BIGINT END AS n FROM digits),
prefixes AS (
  SELECT token, unnest(range(2, length(token))) AS size FROM distinct_tokens WHERE NOT starts_with(token, '&#')),
resolved AS (
  SELECT token, coalesce(chars, CASE WHEN n > 1114111 OR n BETWEEN 55296 AND 57343 THEN chr(65533) ELSE chr(n::INTEGER) END) AS chars
  FROM numbers LEFT JOIN odd USING (n)
  UNION ALL
  SELECT token, arg_max(chars || substr(token, size + 2), size) FROM prefixes JOIN named ON name = substr(token, 2, size) GROUP BY token),
joined AS (
  SELECT number, string_agg(coalesce(chars, token), '' ORDER BY place) AS t FROM placed LEFT JOIN resolved USING (token) GROUP BY number),
texts AS (SELECT r.*, coalesce({clean}, '') AS body FROM responses r LEFT JOIN joined USING (number)),
records AS (
  SELECT page_id, 'metadata' AS record_type, refers_to, target_uri, payload_digest, 'application/warc-fields' AS content_type,
         {uid("'metadata|' || refers_to")} AS record_id, {uid("'conversion|' || refers_to")} AS concurrent_to,
         'source-record: ' || refers_to || {end} || 'source-digest: ' || payload_digest || {end}
         || 'source-header: HTTP/1.1 200 OK' || {end} || 'source-header: Content-Type: text/html; charset=utf-8' || {end}
         || 'source-header: Content-Length: ' || strlen(payload)::VARCHAR || {end}
         || 'text-length: ' || strlen(body)::VARCHAR || {end} AS block
  FROM texts
  UNION ALL
  SELECT page_id, 'conversion', refers_to, target_uri, payload_digest, 'text/plain; charset=utf-8',
         {uid("'conversion|' || refers_to")}, {uid("'metadata|' || refers_to")}, body
  FROM texts)
SELECT page_id, record_type, record_id, refers_to, concurrent_to, target_uri, '1970-01-01T00:00:00Z' AS date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, payload_digest, 'sha256:' || sha256(block) AS block_digest, block
FROM records
"""


_LETTERS = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

DECONTAMINATION = f"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {_LETTERS}), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS words FROM benchmark),
cut AS (
  SELECT item_id, words, least(10, len(words)) AS size, unnest(range(1, len(words) - least(10, len(words)) + 2)) AS pos
  FROM items WHERE len(words) > 0),
windows AS (SELECT DISTINCT item_id, size, list_slice(words, pos, pos + size - 1) AS w FROM cut),
places AS (
  SELECT rid, words, size, unnest(range(1, len(words) - size + 2)) AS pos
  FROM docs, (SELECT DISTINCT size FROM windows) WHERE len(words) >= size),
met AS (
  SELECT DISTINCT rid, item_id, pos, size FROM (SELECT rid, size, pos, list_slice(words, pos, pos + size - 1) AS w FROM places)
  JOIN windows USING (size, w)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(pos, pos + size)) AS p FROM met) GROUP BY rid),
named AS (
  SELECT rid, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS items
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item_id FROM met WHERE item_id IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

HARD_NEGATIVES = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT anchor_id, positive_id, positive_score, n.vec_id AS negative_id, n.score AS negative_score,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY n.score DESC, n.vec_id) AS INTEGER) AS rank
FROM positives JOIN scored n USING (anchor_id)
WHERE NOT n.same AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""

COLLOCATIONS = f"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
         unnest(string_split_regex(translate(coalesce(text, ''), {_LETTERS}), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
worded AS (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM pieces),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM worded),
grams AS (
  SELECT lang, 1 AS size, w[i] AS phrase FROM places
  UNION ALL SELECT lang, 2, w[i] || ' ' || w[i + 1] FROM places WHERE i < len(w)
  UNION ALL SELECT lang, 3, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FROM places WHERE i + 1 < len(w)),
f AS MATERIALIZED (SELECT lang, size, phrase, count(*) AS a FROM grams GROUP BY ALL),
totals AS (SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM f WHERE size = 1 GROUP BY lang),
candidates AS MATERIALIZED (SELECT *, string_split(phrase, ' ') AS w FROM f WHERE size > 1 AND a >= 10),
split AS (
  SELECT lang, phrase, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
  FROM (SELECT *, unnest(range(1, size)) AS k FROM candidates)),
cuts AS (
  SELECT c.lang, c.phrase, c.a, k, l.a AS l, r.a AS r, CAST(1000000::HUGEINT * c.a * c.a // (l.a::HUGEINT * r.a) AS BIGINT) AS score
  FROM split c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = rest),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
longer AS (
  SELECT lang, phrase, max(a) AS a FROM (
    SELECT lang, array_to_string(w[1:2], ' ') AS phrase, a FROM candidates WHERE size = 3
    UNION ALL SELECT lang, array_to_string(w[2:3], ' '), a FROM candidates WHERE size = 3) GROUP BY ALL),
kept AS (
  SELECT o.* FROM lowest o LEFT JOIN longer USING (lang, phrase) WHERE longer.a IS NULL OR 100 * longer.a < 50 * o.a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN totals USING (lang) QUALIFY rank <= 2000
"""

ORACLES: dict[str, str] = {
    "op1_top_k": TOP_K,
    "op2_exact_dedup": EXACT_DEDUP,
    "op3_url_rules": _url_rules(),
    "op10_warc": _warc(),
    "op11_decontamination": DECONTAMINATION,
    "op12_hard_negatives": HARD_NEGATIVES,
    "op13_collocations": COLLOCATIONS,
}
