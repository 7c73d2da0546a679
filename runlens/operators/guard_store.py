"""The coverage guard over stored inputs (Q2, J2, J4): bucketed by run once, joined without a shuffle every time.

A guard is run again and again over one experiment (resume, another threshold, another report).  Its
inputs are reduced to one row per key, the pre-coverage of its repository is put beside every candidate,
and all three tables are bucketed and sorted by run with one number of buckets.  Joins of such tables
read bucket beside bucket, so the plan of ``stored_guard_rows`` has no exchange.

Defined cases: a NULL run finds nothing and keeps its row; candidates that repeat a run give a row each;
empty inputs give empty tables; columns that ``guard_rows`` does not use are not stored.  Only the
candidates may repeat a run, and they pass through their bucket's task as a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators.coverage import decided_rows, lookups

_USED = ("has_result", "test_success", "has_patch", "patch_error")


def store_guard_inputs(candidates: DataFrame, stored: DataFrame, coverage_after: DataFrame, pre_cov: DataFrame, prefix: str,
                       location: str, buckets: int | None = None, run_col: str = "run_id", repo_col: str = "repo",
                       pre_order: str | None = None) -> None:
    """Store the inputs of ``guard_rows`` as tables ``<prefix>_candidates``, ``_earlier`` and ``_after`` below ``location``.

    ``buckets`` is the number of tasks of every later guard (the shuffle partitions, if not given).
    """
    spark = candidates.sparkSession
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    earlier, after, known = lookups(stored, coverage_after, pre_cov, run_col, repo_col, pre_order)
    wanted = candidates.select(run_col, repo_col, *[c for c in _USED if c in candidates.columns])
    tables = {"candidates": wanted.join(known, F.col(repo_col) == F.col("_key"), "left").drop("_key"), "earlier": earlier, "after": after}
    for name, rows in tables.items():
        # Dealt out as the buckets are, so that a bucket is one sorted file.
        (rows.repartition(n, run_col).write.bucketBy(n, run_col).sortBy(run_col).mode("overwrite")
         .option("path", f"{location.rstrip('/')}/{name}").saveAsTable(f"{prefix}_{name}"))


def stored_guard_rows(spark: SparkSession, prefix: str, run_col: str = "run_id", repo_col: str = "repo") -> DataFrame:
    """``guard_rows`` of stored inputs; merge joins of equal buckets, no shuffle and nothing broadcast."""
    j = spark.table(f"{prefix}_candidates")
    for name in ("earlier", "after"):
        j = j.join(spark.table(f"{prefix}_{name}").hint("merge"), run_col, "left")
    return decided_rows(j, run_col, repo_col)
