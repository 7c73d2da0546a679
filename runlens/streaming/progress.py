"""Progress counting as a stream (ST1).

The reference counts one tick per finished job in a listener process.  Here
finished-job records arriving as files are a Structured Streaming source; a
complete-mode count per status is kept in the checkpointed state store, and
each micro-batch overwrites a small result table in the shared checkpoint
folder.  Restarting with the same checkpoint only reads files that arrived
since (the file source's own "do not redo" log), so the count survives
executor and driver restarts.

``progress_latest`` keeps a row per run instead of a count per status: the last result of a run wins, and
a finished run that arrives again counts once (resume, J4, as a stream).
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from runlens.session import checkpoint_dir


def progress_counts(spark: SparkSession, source_dir: str, schema: StructType | str, status_col: str,
                    out_dir: str | None = None, glob: str | None = None, checkpoint: str | None = None,
                    file_format: str = "parquet") -> DataFrame:
    """Run the progress stream once over everything available (``availableNow``) and return the counts.

    The counts are kept beside the checkpoint unless ``out_dir`` says where, so a restart with the same
    checkpoint goes on from them, also when no file has arrived since.  A source that never had a file
    gives no rows.  Runs the stream at the time of the call.
    """
    base = checkpoint_dir(spark).rstrip("/")
    checkpoint = checkpoint or f"{base}/runlens-progress/{uuid.uuid4().hex[:12]}/checkpoint"
    out_dir = out_dir or f"{checkpoint.rstrip('/')}-counts"
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    counts = reader.load(source_dir).groupBy(F.col(status_col).alias("status")).agg(
        F.count(F.lit(1)).alias("finished"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(out_dir)

    q = (counts.writeStream.outputMode("complete").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    # The stream's own schema; a folder that no batch has written yet is made, so that it reads as empty.
    spark.createDataFrame([], counts.schema).write.mode("append").parquet(out_dir)
    return spark.read.schema(counts.schema).parquet(out_dir)


def progress_latest(spark: SparkSession, source_dir: str, schema: StructType | str, key: str, order: list[str],
                    out_dir: str | None = None, glob: str | None = None, checkpoint: str | None = None,
                    file_format: str = "parquet") -> DataFrame:
    """The last result of every run over everything that has arrived (``availableNow``): one row per ``key``.

    The last result is the row with the greatest ``order`` columns (of rows that agree in them, the greatest
    by its other columns; NULL comes first), in whatever portion it arrived, so late and repeated rows change nothing.  Keyed state
    holds a row per run, aggregated in front of the shuffle, so a run with most of the rows is no hot key.
    A batch writes the runs it changed into a folder of its own number and replaces that folder when
    it is run again after a failure.  A NULL key is a run like any other; a source without files gives no rows.
    Columns are ``key``, ``order`` and the others in this order.  Runs the stream at the time of the call.
    """
    base = checkpoint_dir(spark).rstrip("/")
    checkpoint = checkpoint or f"{base}/runlens-progress/{uuid.uuid4().hex[:12]}/checkpoint"
    out_dir = (out_dir or f"{checkpoint.rstrip('/')}-latest").rstrip("/")
    reader = spark.readStream.format(file_format).schema(schema)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    arrived = reader.load(source_dir)
    fields = [*order, *[c for c in arrived.columns if c != key and c not in order]]
    latest = arrived.groupBy(key).agg(F.max(F.struct(*fields)).alias("_last"))

    def publish(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out_dir}/batch={batch_id}")

    q = (latest.writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    # A folder that no batch has written yet reads as empty.
    spark.createDataFrame([], latest.schema).write.mode("append").parquet(f"{out_dir}/batch=-1")
    changes = spark.read.schema(latest.schema).parquet(out_dir)
    return changes.groupBy(key).agg(F.max("_last").alias("_last")).select(key, "_last.*")


def latest_counts(latest: DataFrame, status_col: str) -> DataFrame:
    """Runs per status, every run counted once."""
    return latest.groupBy(F.col(status_col).alias("status")).agg(F.count(F.lit(1)).alias("finished"))
