"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import checkpoint_dir, ship_package

#: Text taken from an Arrow batch at a time, so that a task's Python memory does not follow the batch size.
SLICE_BYTES = 4 << 20

#: Rows in an Arrow batch sent to Python; Spark's default of 10,000 whole texts is a lot of memory for one task.
BATCH_ROWS = 2000


def bounded_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to ``BATCH_ROWS`` (a smaller value that is set already stays)."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def prepare(spark: SparkSession) -> None:
    """What every operator with Python tasks needs: the package on the executors and bounded batches."""
    ship_package(spark)
    bounded_batches(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint folder and read it back.

    Cuts lineage with files that every executor sees: a lost executor costs a
    re-read, not a recomputation.  The folder stays as long as the result may
    be read; the cluster's clean-up of ``spark.checkpoint.dir`` removes it.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Bits of an id filter; its table has at most a 64th as many rows, whatever the number of ids.
FILTER_BITS = 1 << 24


class IdFilter:
    """A bitmap over hashed ids that sorts rows into "surely not among them" and "perhaps", without a shuffle.

    The bitmap is a table of at most FILTER_BITS / 64 words, so its broadcast is bounded however many
    ids there are; with very many ids it only lets more rows pass as "perhaps".
    """

    def __init__(self, ids: DataFrame, column: str):
        place = self._place(F.col(column))
        self._words = (ids.where(F.col(column).isNotNull()).select(F.shiftright(place, 6).alias("_word"), self._bit(place).alias("_bit"))
                       .groupBy("_word").agg(F.bit_or("_bit").alias("_bits")))

    @staticmethod
    def _place(c: Column) -> Column:
        return F.pmod(F.xxhash64(c.cast("string")), F.lit(FILTER_BITS))      # ids of any integer type hash alike

    @staticmethod
    def _bit(place: Column) -> Column:
        return F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))

    def split(self, df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
        """(rows whose id is surely not among the ids, or null; the other rows)."""
        place = self._place(F.col(column))
        marked = (df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.shiftright(place, 6).alias("_word"),
                            F.when(F.col(column).isNotNull(), self._bit(place)).alias("_bit"))
                  .join(F.broadcast(self._words), "_word", "left"))
        inside = F.coalesce(F.col("_bits").bitwiseAND(F.col("_bit")) != 0, F.lit(False))
        return marked.where(~inside).select("_row.*"), marked.where(inside).select("_row.*")


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text",
                limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches into row slices holding about ``limit`` bytes of text (one row at least)."""
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i, size in enumerate(sizes.tolist()):
            if held and held + size > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += size + 1
        yield batch.slice(start)


def rows_batch(rows: dict[str, list], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(rows[f.name], type=f.type) for f in schema], schema=schema)
