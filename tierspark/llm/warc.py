"""WARC derivatives: linked metadata and plain-text conversion records of response records.

Everything but character references is native expressions; a record is a row until :func:`write_warc` lays it into files. Records
keep the response's identifier (``WARC-Refers-To``), address, date, HTTP header lines and payload digest.
Identifiers of derivatives follow from the response's, so a job that runs again makes the same records.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tierspark.llm.common import pick

VERSION = "WARC/1.1"
END = "\r\n"
NO_DATE = "1970-01-01T00:00:00Z"

# What is taken out of a page, and what parts of it stand on lines of their own.
UNSEEN = (
    r"(?s)<!--.*?-->",
    r"(?is)<script\b[^>]*>.*?</script\s*>",
    r"(?is)<style\b[^>]*>.*?</style\s*>",
)
LINES = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|footer|h[1-6]|head|header|hr|html|li|main|nav|ol"
    r"|p|pre|section|table|tbody|td|tfoot|th|thead|title|tr|ul)\b[^>]*>"
)
TAGS = r"<[^>]*>"


def with_text(rows: DataFrame, html: str, text: str) -> DataFrame:
    """``rows`` with the text of the page instead of the page.

    Markup is removed, block elements stand on lines of their own, and all character references of HTML are
    resolved, each once; no-break spaces count as spaces.
    """
    seen = F.col(html)
    for pattern in UNSEEN:
        seen = F.regexp_replace(seen, pattern, "")
    seen = F.regexp_replace(F.regexp_replace(seen, LINES, "\n"), TAGS, "")
    rows = rows.withColumn(text, seen).drop(html)
    place = rows.columns.index(text)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            resolved = [value and unescape(value) for value in batch.column(place).to_pylist()]
            yield batch.set_column(place, text, pa.array(resolved, pa.string()))

    spaced = F.regexp_replace(text, r"[ \t\r\f\x0B\u00A0]+", " ")
    lines = F.regexp_replace(F.regexp_replace(spaced, r" ?\n[ \n]*", "\n"), r"^[ \n]+|[ \n]+$", "")
    return rows.mapInArrow(run, rows.schema).withColumn(text, lines)


def digest(data: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(data, 256))


def record_id(*parts: Column) -> Column:
    """A repeatable record identifier from the MD5 of its parts."""
    return F.concat(
        F.lit("urn:uuid:"),
        F.regexp_replace(F.md5(F.concat_ws("|", *parts)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"),
    )


def responses(pages: DataFrame, date: str = NO_DATE, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Response records of fetched pages: ``(key, record_id, target_uri, date, http_headers, payload, payload_digest)``.

    A NULL page is an empty payload and a NULL address an empty one. Repeated rows are one response each, of
    the same identifier.
    """
    empty = F.lit("")
    rows = pick(pages, **{key: key, "_url": url, "_html": html}).select(
        key, F.coalesce("_url", empty).alias("target_uri"), F.coalesce("_html", empty).alias("payload")
    )
    return rows.withColumn("payload_digest", digest(F.col("payload"))).select(
        key,
        record_id(F.lit("response"), F.coalesce(F.col(key).cast("string"), empty), "target_uri", "payload_digest").alias("record_id"),
        "target_uri",
        F.lit(date).alias("date"),
        F.concat(
            F.lit("HTTP/1.1 200 OK" + END + "Content-Type: text/html; charset=utf-8" + END + "Content-Length: "),
            F.octet_length("payload").cast("string"),
        ).alias("http_headers"),
        "payload",
        "payload_digest",
    )


def derivatives(responses: DataFrame, key: str = "page_id") -> DataFrame:
    """Two records per response: its metadata, and its plain text.

    Columns: ``key, record_type, record_id, refers_to, concurrent_to, target_uri, date, content_type,
    content_length, payload_digest`` (of the source), ``block_digest, block``. No row is moved.
    """
    text = with_text(responses, "payload", "_text")
    lines = F.concat_ws(
        END,
        F.concat(F.lit("source-record: "), F.col("record_id")),
        F.concat(F.lit("source-digest: "), F.col("payload_digest")),
        F.regexp_replace(F.col("http_headers"), "(?m)^", "source-header: "),
        F.concat(F.lit("text-length: "), F.octet_length("_text").cast("string")),
        F.lit(""),
    )
    made = text.select(
        key,
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        "payload_digest",
        F.explode(
            F.array(
                F.struct(
                    F.lit("metadata").alias("record_type"),
                    record_id(F.lit("metadata"), F.col("record_id")).alias("record_id"),
                    record_id(F.lit("conversion"), F.col("record_id")).alias("concurrent_to"),
                    F.lit("application/warc-fields").alias("content_type"),
                    lines.alias("block"),
                ),
                F.struct(
                    F.lit("conversion").alias("record_type"),
                    record_id(F.lit("conversion"), F.col("record_id")).alias("record_id"),
                    record_id(F.lit("metadata"), F.col("record_id")).alias("concurrent_to"),
                    F.lit("text/plain; charset=utf-8").alias("content_type"),
                    F.col("_text").alias("block"),
                ),
            )
        ).alias("r"),
    )
    return made.select(
        key,
        "r.record_type",
        "r.record_id",
        "refers_to",
        "r.concurrent_to",
        "target_uri",
        "date",
        "r.content_type",
        F.octet_length("r.block").cast("bigint").alias("content_length"),
        "payload_digest",
        digest(F.col("r.block")).alias("block_digest"),
        "r.block",
    )


def warc_text(records: DataFrame) -> Column:
    """A derivative record in the form of a WARC file, up to the two line ends that close it."""
    one_line = lambda c: F.regexp_replace(F.col(c), "[\r\n]+", " ")
    fields = [
        ("WARC-Type", F.col("record_type")),
        ("WARC-Record-ID", F.concat(F.lit("<"), F.col("record_id"), F.lit(">"))),
        ("WARC-Date", F.col("date")),
        ("WARC-Target-URI", one_line("target_uri")),
        ("WARC-Refers-To", F.concat(F.lit("<"), F.col("refers_to"), F.lit(">"))),
        ("WARC-Concurrent-To", F.concat(F.lit("<"), F.col("concurrent_to"), F.lit(">"))),
        ("WARC-Payload-Digest", F.col("payload_digest")),
        ("WARC-Block-Digest", F.col("block_digest")),
        ("Content-Type", F.col("content_type")),
        ("Content-Length", F.col("content_length").cast("string")),
    ]
    head = [F.concat(F.lit(f"{name}: "), value) for name, value in fields]
    return F.concat_ws(END, F.lit(VERSION), *head, F.lit(""), F.col("block"))


def write_warc(records: DataFrame, folder: str) -> None:
    """WARC files, one per task, uncompressed: Spark's text files with a record's end as their line end."""
    records.select(warc_text(records).alias("value")).write.mode("overwrite").option("lineSep", END * 2).text(folder)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """``(headers, block)`` of the records in files of :func:`write_warc`; blocks hold no carriage return but in header lines."""
    raw = spark.read.option("lineSep", VERSION + END).text(folder).where(F.length("value") > 0)
    body = F.regexp_replace("value", "\r\n\r\n$", "")
    at = F.expr("locate('\r\n\r\n', _body)")
    return (
        raw.select(body.alias("_body"))
        .select(F.col("_body"), at.alias("_at"))
        .select(
            F.str_to_map(F.substring("_body", F.lit(1), F.col("_at") - 1), F.lit(END), F.lit(": ")).alias("headers"),
            F.substring("_body", F.col("_at") + 4, F.length("_body")).alias("block"),
        )
    )
