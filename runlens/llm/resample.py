"""Importance resampling towards a target distribution, with segment deduplication.

Features are the runs of 1 to ``words`` consecutive words of a text, hashed into buckets.  Texts are cut
at line feeds into lines; the features of every *distinct* line are counted once, and a line's counts are
multiplied by its occurrences in the corpus.  Runs that cross a line end belong to no line; each text adds
them separately (with runs of one word there are none).  Bucket counts of corpus and target give a gain
per bucket; a distinct line's gain is summed once as well, and a document's weight is put together from
its lines by a join on the lines' digests, so that the texts move once, as distinct lines.

The draw adds Gumbel noise, made from a hash of doc_id, to the weight and takes the highest scores, which
is sampling without replacement in proportion to exp(weight / 1000).

A line with a third of all occurrences is combined in front of the first shuffle, and is one key of the
second, whose join Spark may split.  Ranks are numbered in ranges, by many tasks.

Defined cases: null and empty texts have no words, no features and weight 0; a text of any length is cut
at its line feeds (a line without end is one row); rows that repeat are drawn row by row; a null doc_id
hashes as the empty string and comes last among equal scores, equal (score, doc_id) are ordered by
n_features; an empty table gives no rows and an empty target has no counts; other columns of the tables
are not read, so that their names cannot clash.  Documents are read from files (or ``written`` first).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import prepare, text_slices, written
from runlens.llm._number import numbered

#: Bytes of a word as they are, A-Z in lower case, any other byte a blank.
_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256))
_CACHED, _CACHED_BYTES = 1 << 18, 64       # features whose buckets a worker remembers, and their longest


@dataclass(frozen=True)
class Rule:
    """Features, draw and noise; the table of bucket gains (``buckets`` numbers) goes to every task."""

    words: int = 1              # longest run
    buckets: int = 10_000
    percent: int = 10           # of the eligible documents that are drawn
    least_words: int = 20       # of an eligible document
    seed: str = "2024"


class Buckets(dict):
    """Bucket of a feature (bytes), remembered for short features."""

    def __init__(self, n: int):
        self.n = n

    def __missing__(self, feature: bytes) -> int:
        bucket = zlib.crc32(feature) % self.n
        if len(feature) <= _CACHED_BYTES:
            if len(self) >= _CACHED:
                self.clear()
            self[feature] = bucket
        return bucket


def words_of(text: str) -> list[bytes]:
    """Words of a text: runs of digits, letters a-z (A-Z in lower case) and anything beyond ASCII."""
    return text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()


def runs_inside(words: list[bytes], longest: int) -> list[bytes]:
    """All runs of 1 to ``longest`` consecutive words of one line."""
    out = list(words)
    for k in range(2, longest + 1):
        out += map(b" ".join, zip(*(words[i:] for i in range(k))))
    return out


def runs_across(lines: list[list[bytes]], longest: int) -> list[bytes]:
    """The runs of 2 to ``longest`` words of a text that cross a line end."""
    words = [w for line in lines for w in line]
    out, at = [], 0
    for line in lines[:-1]:
        if line:
            at += len(line)
            # Runs that begin in this line: the others that cross this end began, and were counted, in an earlier one.
            for start in range(max(at - len(line), at - longest + 1), at):
                out += (b" ".join(words[start:end]) for end in range(at + 1, min(start + longest, len(words)) + 1))
    return out


def _lines(text: Column) -> Column:
    return F.split(text, "\n")


def _key(line: Column) -> Column:
    """16 bytes that stand for a line (the first half of its sha256)."""
    return F.unhex(F.substring(F.sha2(line, 256), 1, 32))


def _lists(lists: list[list[int]]) -> pa.Array:
    cut = np.cumsum([0, *map(len, lists)])
    return pa.ListArray.from_arrays(pa.array(cut, type=pa.int32()), pa.array([x for own in lists for x in own], type=pa.int32()))


def distinct_lines(texts: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """line_key, times (occurrences in all texts), n_words and buckets of every distinct line that holds a word; written."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(rule.buckets)
        for part in text_slices(batches, "line", 1 << 20):
            words = [words_of(line) for line in part.column("line").to_pylist()]
            features = words if rule.words == 1 else [runs_inside(w, rule.words) for w in words]
            yield pa.RecordBatch.from_arrays(
                [part.column("line_key"), part.column("times"), pa.array(list(map(len, words)), type=pa.int64()),
                 _lists([list(map(bucket_of.__getitem__, own)) for own in features])],
                names=["line_key", "times", "n_words", "buckets"])

    lines = (texts.select(F.explode(_lines(F.col("text"))).alias("line")).where(F.col("line") != "")
             .groupBy("line").agg(F.count("*").alias("times")))
    return written(lines.select(_key(F.col("line")).alias("line_key"), "times", "line")
                   .mapInArrow(run, "line_key binary, times long, n_words long, buckets array<int>").where("n_words > 0"), "distinct-lines")


def _crossing(texts: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, row_key and the buckets of the runs that cross a line end, for every text that has any."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket_of = Buckets(rule.buckets)
        for part in text_slices(batches, limit=1 << 20):
            found = [[bucket_of[f] for f in runs_across(list(map(words_of, (text or "").split("\n"))), rule.words)]
                     for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("row_key"), _lists(found)],
                                             names=["doc_id", "row_key", "crossing"])

    return (texts.select("doc_id", "row_key", "text").mapInArrow(run, "doc_id long, row_key long, crossing array<int>")
            .where(F.size("crossing") > 0))


def bucket_counts(texts: DataFrame, lines: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """bucket, n: features of all texts by bucket, from their distinct lines and, added to them, the runs across lines."""
    counts = lines.select("times", F.explode("buckets").alias("bucket")).groupBy("bucket").agg(F.sum("times").alias("n"))
    if rule.words > 1:
        keyed = texts.select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("row_key"), "text")
        across = _crossing(keyed, rule).select(F.explode("crossing").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
        counts = counts.unionByName(across).groupBy("bucket").agg(F.sum("n").alias("n"))
    return counts


def bucket_gains(corpus: DataFrame, target: DataFrame, rule: Rule = Rule()) -> list[int]:
    """Gain of every bucket from the two tables of bucket counts (``buckets`` rows each at most come to the driver)."""
    def totals(counts: DataFrame) -> Column:
        return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("double")).scalar()

    spark = corpus.sparkSession
    every = (spark.range(rule.buckets).select(F.col("id").cast("int").alias("bucket"))
             .join(corpus.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left")
             .select("bucket", F.coalesce("s", F.lit(0)).cast("double").alias("s"), F.coalesce("t", F.lit(0)).cast("double").alias("t"),
                     totals(corpus).alias("all_s"), totals(target).alias("all_t")))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + rule.buckets)) / ((F.col("s") + 1) * (F.col("all_t") + rule.buckets))
    rows = every.select("bucket", F.floor(F.lit(1000) * F.log(ratio)).alias("gain")).collect()
    return [r.gain for r in sorted(rows)]


def _gain_sum(buckets: Column, gains: list[int]) -> Column:
    table = F.split(F.lit(",".join(map(str, gains))), ",").cast("array<bigint>")        # folded to a constant
    return F.aggregate(buckets, F.lit(0).cast("long"), lambda total, b: total + F.get(table, b))


def weights(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_words, n_features and weight of every document against the texts of ``target``.  Runs jobs."""
    prepare(docs.sparkSession)
    texts, wanted = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), target.select("text")
    lines, wanted_lines = distinct_lines(texts, rule), distinct_lines(wanted, rule)
    gains = bucket_gains(bucket_counts(texts, lines, rule), bucket_counts(wanted, wanted_lines, rule), rule)
    known = lines.select("line_key", "n_words", F.size("buckets").cast("long").alias("n_features"), _gain_sum(F.col("buckets"), gains).alias("gain"))
    rows = texts.withColumn("row_key", F.monotonically_increasing_id())      # rows may repeat a doc_id
    keys = F.transform(F.filter(_lines(F.col("text")), lambda line: line != ""), _key)
    none = F.array(F.unhex(F.lpad(F.hex("row_key"), 16, "0")))               # 8 bytes: meets no line, and no two texts share it
    parts = (rows.select("doc_id", "row_key", F.explode(F.when(F.size(keys) > 0, keys).otherwise(none)).alias("line_key"))
             .join(known, "line_key", "left").select("doc_id", "row_key", "n_words", "n_features", "gain"))
    if rule.words > 1:
        parts = parts.unionByName(_crossing(rows, rule).select(
            "doc_id", "row_key", F.lit(0).cast("long").alias("n_words"), F.size("crossing").cast("long").alias("n_features"),
            _gain_sum(F.col("crossing"), gains).alias("gain")))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    sums = parts.groupBy("row_key", "doc_id").agg(total("n_words"), total("n_features"), total("gain"))
    floored = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(0)
    return sums.select("doc_id", "n_words", "n_features", floored.cast("long").alias("weight"))


def noise(doc_id: Column, seed: str) -> Column:
    """floor(1000 * Gumbel noise) of a document, from a hash of seed and doc_id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resample(docs: DataFrame, target: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null: not drawn) of every document.  Runs jobs."""
    scored = written(weights(docs, target, rule).withColumn("score", F.col("weight") + noise(F.col("doc_id"), rule.seed))
                     .withColumn("eligible", F.col("n_words") >= rule.least_words), "scored")
    eligible = scored.where("eligible").count()
    quota = eligible * rule.percent // 100
    placed = numbered(scored, ["eligible"], [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], "place")
    rank = F.when(F.col("eligible") & (F.col("place") < quota), F.col("place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
