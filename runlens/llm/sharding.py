"""Shards by jump consistent hashing, in DataFrame functions only.

A document's shard depends on its doc_id and the number of shards alone: the 64-bit key (the first
half of the md5 of the decimal doc_id) drives a linear congruential generator, and every value of it
says to which shard the document would jump next as shards are appended one by one.  The last jump
below the number of shards is the answer, so no ring or table is kept, about one document in n + 1 moves
when shard n is appended, and none moves between the older shards.

Column expressions do the arithmetic: the generator's product modulo 2^64 is put together from 32-bit
halves, since Spark's long arithmetic raises on overflow.  A key jumps about ln(n) times; the first
``STEPS`` jumps are a fixed fold, and a key that needs more is carried on in a second one.

Slots number the rows of a shard without gaps in the order of (key, size, checksum); a shard, or one
doc_id with a third of all rows, is numbered by many tasks.

Defined cases: a null doc_id has the key of the empty string; a null text has no bytes (size 8,
checksum 0) and so has an empty one; texts of any length count whole; rows that repeat get slots of
their own; an empty table gives no rows; other columns of the documents, whatever their names, stay in
the struct ``row`` of ``assign``.  Documents are read from files (or passed through ``written`` first).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.llm._number import numbered
from runlens.operators._plan import let

_FACTOR = 2862933555777941757       # the generator of the published algorithm
_LOW, _HIGH = _FACTOR & 0xFFFFFFFF, _FACTOR >> 32
_MASK = 0xFFFFFFFF
STEPS = 64
ROW_BYTES = 8                       # of a document besides its text


def key_of(doc_id: Column) -> Column:
    """The 64-bit key of a document as struct (hi, lo) of unsigned halves."""
    digest = F.md5(F.coalesce(doc_id.cast("string"), F.lit("")))
    half = lambda at: F.conv(F.substring(digest, at, 8), 16, 10).cast("long")
    return F.struct(half(1).alias("hi"), half(9).alias("lo"))


def _product(x: Column, factor: int) -> tuple[Column, Column]:
    """x * factor for 32-bit numbers as (a, b): a + b * 2^16 with a, b below 2^48."""
    return x * F.lit(factor & 0xFFFF).cast("long"), x * F.lit(factor >> 16).cast("long")


def _low_part(x: Column, factor: int) -> Column:
    """A number below 2^50 that equals x * factor modulo 2^32."""
    a, b = _product(x, factor)
    return a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16)


def _next(hi: Column, lo: Column) -> tuple[Column, Column]:
    """Halves of (hi * 2^32 + lo) * FACTOR + 1 modulo 2^64."""
    mask = F.lit(_MASK)
    a, b = _product(lo, _LOW)
    low = a + F.shiftleft(b.bitwiseAND(F.lit(0xFFFF)), 16) + 1
    high = F.shiftright(low, 32) + F.shiftright(b, 16) + _low_part(hi, _LOW) + _low_part(lo, _HIGH)
    return high.bitwiseAND(mask), low.bitwiseAND(mask)


def _jumped(state: Column, shards: int) -> Column:
    """One step: to the next shard below ``shards``, or no change."""
    to = F.floor((state["at"] + 1) * (F.lit(2147483648.0) / (F.shiftright(state["hi"], 1) + 1)))
    hi, lo = _next(state["hi"], state["lo"])
    return let(to, lambda j: F.when(j < shards, F.struct(hi.alias("hi"), lo.alias("lo"), j.alias("at"), state["at"].alias("from")))
               .otherwise(state))


def jump(key: Column, shards: int) -> Column:
    """struct (at: shard of ``shards``, from: the shard it jumped from last, -1 for shard 0) of a key (hi, lo)."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    start = F.struct(key["hi"].alias("hi"), key["lo"].alias("lo"), F.lit(-1).cast("long").alias("at"), F.lit(-1).cast("long").alias("from"))
    step = lambda state, _: _jumped(state, shards)
    found = F.aggregate(F.sequence(F.lit(1), F.lit(min(shards, STEPS))), start, step)
    if shards > STEPS:
        rest = F.sequence(F.lit(STEPS + 1), F.lit(shards))
        more = lambda s: (s["at"] + 1) * (F.lit(2147483648.0) / (F.shiftright(s["hi"], 1) + 1)) < shards
        found = let(found, lambda s: F.when(more(s), F.aggregate(rest, s, step)).otherwise(s))
    return F.struct(found["at"].alias("at"), found["from"].alias("from"))


def shard_of(doc_id: Column, shards: int) -> Column:
    """Shard (from 0) of a document."""
    return jump(key_of(doc_id), shards)["at"].cast("int")


def assign(docs: DataFrame, shards: int = 24, rows: bool = False) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard (with one shard more) of every document.

    ``rows`` adds the whole document as struct ``row``; without it texts do not move.  Runs a job.
    """
    text = F.col("text")
    size = F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if rows else []
    keyed = docs.select("doc_id", size.alias("size"), F.crc32(F.coalesce(text, F.lit(""))).alias("text_crc32"),
                        key_of(F.col("doc_id")).alias("key"), *whole)
    # The jumps below n are those below n + 1, but perhaps the last one, which then leads to shard n.
    jumped = keyed.withColumn("to", jump(F.col("key"), shards + 1))
    placed = jumped.select("doc_id", "size", "text_crc32", "key", F.col("to.at").cast("int").alias("grown_shard"),
                           F.when(F.col("to.at") == shards, F.col("to.from")).otherwise(F.col("to.at")).cast("int").alias("shard"),
                           *(["row"] if rows else []))
    out = numbered(placed, ["shard"], [F.col("key.hi"), F.col("key.lo"), F.col("size"), F.col("text_crc32")], "slot")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard", *(["row"] if rows else []))


def write_shards(docs: DataFrame, path: str, shards: int = 24) -> None:
    """Write the documents as a table partitioned by shard, rows as (slot, row)."""
    assign(docs, shards, rows=True).select("shard", "slot", "row").write.partitionBy("shard").parquet(path)


def read_shard(spark: SparkSession, path: str, shard: int) -> DataFrame:
    """The documents of one written shard in slot order (other shards are not opened)."""
    return spark.read.parquet(path).where(F.col("shard") == shard).orderBy("slot").select("row.*")


def growth(assigned: DataFrame) -> DataFrame:
    """What one more shard takes from each shard: shard, n_rows, n_bytes, moved_rows, moved_bytes."""
    moves = F.col("grown_shard") != F.col("shard")
    return assigned.groupBy("shard").agg(
        F.count("*").alias("n_rows"), F.sum("size").alias("n_bytes"), F.count_if(moves).alias("moved_rows"),
        F.sum(F.when(moves, F.col("size")).otherwise(0)).alias("moved_bytes"))
