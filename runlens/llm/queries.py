"""Driver queries of the training-data operators, each over its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm._common import table, written
from runlens.llm.oracles import ORACLES  # noqa: F401 - read by the driver's entry

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _query(fn: Builder) -> Builder:
    QUERIES[fn.__name__] = fn
    return fn


@_query
def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written as wavelet-matrix shards and read back from them."""
    from runlens.llm import token_shards as T

    return T.read_documents(T.write_shards(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")))


@_query
def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by a byte convolutional network."""
    from runlens.llm import langid as L

    docs = table(spark, sf_dir, "documents")
    return (L.predict(docs, L.fit(docs))
            .select("doc_id", L.held_out("doc_id").alias("held_out"), "lang_pred", "score"))


@_query
def op7_word_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy word-piece token counts of every document."""
    from runlens.llm import wordpiece as W

    return W.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@_query
def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document and the bytes decoded from them, as digests."""
    from runlens.llm import bpe as B

    return B.round_trip(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"))


@_query
def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows found in every document through an FM-index per shard."""
    from runlens.llm import decontaminate as D

    return D.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)


@_query
def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents: 3-word shingles, similarity of 0.85 or more."""
    from runlens.llm import neardup as N

    return N.near_duplicates(table(spark, sf_dir, "documents"), N.Rule(words=3, percent=85))


@_query
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base patterns and identifiers found by bootstrapped context."""
    from runlens.llm import pii as P

    return P.personal_data(table(spark, sf_dir, "documents"))


@_query
def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """20 nearest of every twentieth vector among all others."""
    from runlens.llm import ann as A

    return A.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


@_query
def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page against the list entries that were active when it was fetched."""
    from runlens.llm import urlfilter as U

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return U.judge(U.derived_captures(pages), U.derived_listings(pages))


#: A conversation whose texts hold the default template's own marks.
MARKS = (-7, "\\### Assistant: </turn> ok")


@_query
def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations formatted by a compiled template, written, and read back from the formatted text."""
    from runlens.llm import chat as C

    conv_id, text = MARKS
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    more = spark.createDataFrame([(conv_id, 0, "user", text), (conv_id, 1, "assistant", text)], turns.schema)
    return C.read_back(written(C.format_conversations(turns.union(more)), "formatted"))


@_query
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards by jump consistent hashing, and where each would be with one shard more."""
    from runlens.llm import sharding as S

    return S.assign(spark.read.parquet(f"{sf_dir}/documents.parquet"), shards=24)


@_query
def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents drawn towards the distribution of the benchmark's words."""
    from runlens.llm import resample as R

    return (R.resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), R.Rule())
            .select("doc_id", "n_features", "weight", "score", "rank"))


@_query
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE tokens of every document aligned with those of a piece model."""
    from runlens.llm import align as A

    return A.alignment_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))
