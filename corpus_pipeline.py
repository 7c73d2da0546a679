"""Corpus pipeline: identify languages, drop near duplicates, cut benchmark passages, redact personal data, tokenise.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept; all but the
last return the columns of ``documents``.  ``run`` writes every stage's result to the shared
checkpoint folder and reads it back for the next one.

Defined cases: a null or empty text has no letters and goes in the first stage; a stage given such a text hands it
on; texts of any length are taken whole; rows that repeat a doc_id are one document to the second stage and rows
of their own to the others; rows without doc_id are no one's duplicates; further columns are handed on, whatever
they are called, by all stages but the last; an empty table gives an empty result of every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from runlens.llm import bpe, decontaminate, langid, neardup, pii
from runlens.llm._common import prepare, table, written
from runlens.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language the byte network identifies; trained on the labelled part of the input."""
    prepare(spark)
    return langid.keep_identified(docs, langid.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near duplicates (five-word shingles, similarity 0.8 or more)."""
    prepare(spark)
    return neardup.keep_one(docs, neardup.Rule(words=5, percent=80))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut the merged spans of benchmark windows out of the texts."""
    return decontaminate.remove_passages(docs, table(spark, sf_dir, "benchmark"), window=10)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data by the name of its kind."""
    prepare(spark)
    return pii.redacted(docs)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, with digests of the ids and of the bytes decoded from them."""
    prepare(spark)
    return bpe.round_trip(docs, tokenizer_path("byte_bpe_50k.tiktoken"), with_ids=True)


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", cut_benchmark),
    ("personal_data", redact_personal_data),
    ("byte_bpe", tokenise),
]

#: No SQL: the stages are a trained network, sketches, an index, a scored graph and a tokenizer; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
