"""The corpus pipeline: good documents, once each, without personal data, packed into training sequences."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tierspark.llm import crf_pii, golomb_dedup, nbsvm, packing, simhash
from tierspark.llm.common import stored, table
from tierspark.llm.survivors import one_of_each

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from labelled ones among them."""
    return nbsvm.keep_good(docs, nbsvm.train(docs, table(spark, sf_dir, "labels")))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the smallest doc_id."""

    def judge(rows: DataFrame) -> DataFrame:
        return golomb_dedup.exact_duplicates(rows, "_key", "_text").withColumnRenamed("keep_id", "_first")

    return one_of_each(docs, judge)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents whose SimHash fingerprints are linked by 3 bits the one with the smallest doc_id."""

    def judge(rows: DataFrame) -> DataFrame:
        return simhash.near_duplicates(rows, "_key", "_text").withColumnRenamed("component_id", "_first")

    return one_of_each(docs, judge)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data masked."""
    return crf_pii.redact(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces and their places in sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=0)


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", quality),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", near_dedup),
    ("PII", pii),
    ("best-fit packing", pack),
]

# Classifier, SimHash fingerprints, random field and tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, over ``documents``; each writes what it keeps to the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.lower().replace(" ", "-"))
    return docs
