"""Run-level operators: funnel (A1), status counts (A2), the semi join for
manifest filtering (J1), first-N (L1), summary projection (P6).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Funnel stage names (in report order) and job status names.
FUNNEL_STAGES = ["run_job", "compile", "test", "overall"]
JOB_STATUSES = ["SUCCESS", "FAIL", "SKIP"]


def funnel(runs: DataFrame, result_col: str = "has_result",
           build_col: str = "build_success", test_col: str = "test_success") -> DataFrame:
    """A1: four-stage funnel as long-form rows (stage, started, succeeded).

    One global aggregate (partial per task + a single-row final merge), then
    ``stack`` turns the four counters into four rows. NULL success counts as
    failure; ``test`` success is counted without requiring build success.
    """
    has = F.col(result_col)
    agg = runs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(has).alias("ran"),
        F.count_if(has & F.col(build_col)).alias("build_ok"),
        F.count_if(has & F.col(test_col)).alias("test_ok"),
    )
    started_succeeded = [("n", "ran"), ("ran", "build_ok"), ("build_ok", "test_ok"), ("n", "test_ok")]
    args = ", ".join(f"'{st}', {a}, {b}" for st, (a, b) in zip(FUNNEL_STAGES, started_succeeded))
    return agg.select(F.expr(f"stack(4, {args}) as (stage, started, succeeded)"))


def result_stats(results: DataFrame, status_col: str = "status") -> DataFrame:
    """A2: one row of counts per job status, zero for absent statuses."""
    s = F.col(status_col)
    return results.agg(*[F.count_if(s == name).alias(name.lower()) for name in JOB_STATUSES])


def with_results(manifest: DataFrame, results: DataFrame, key: str = "repo_name",
                 result_key: str | None = None) -> DataFrame:
    """Keep manifest items that have a result (left semi join).

    Only the key column of the results is read; Spark broadcasts it when
    its measured size is under ``autoBroadcastJoinThreshold`` and otherwise
    runs a shuffled semi join, so no unchecked broadcast is forced here.
    """
    rk = result_key or key
    keys = results.select(F.col(rk).alias(key))
    return manifest.join(keys, key, "left_semi")


def first_n(df: DataFrame, n: int, order_col: str = "ordinal") -> DataFrame:
    """L1: first ``n`` items in manifest order when n > 0, else all (TakeOrderedAndProject)."""
    if n is None or n <= 0:
        return df
    return df.orderBy(order_col).limit(n)


def summary_projection(runs: DataFrame, result_col: str = "migration_result") -> DataFrame:
    """Drop the bulky ``build_log`` from the nested result before storing a summary."""
    return runs.withColumn(result_col, F.col(result_col).dropFields("build_log"))


def experiment_data(artifacts: DataFrame, log_headers: DataFrame | None = None,
                    features: DataFrame | None = None, key: str = "repo") -> DataFrame:
    """J3 (with S3): one row per repository of an experiment, each part optional.

    ``artifacts`` (one row per result folder) drives the rows; agent-log header
    rows and repository features are attached with left equi-joins, so
    features of repositories without a result folder are dropped and missing
    parts are NULL.  Steps stay in their own table (``parse_agent_logs``),
    joined on the same key when needed, so no repository is collected into one row.
    """
    out = artifacts
    if log_headers is not None:
        out = out.join(log_headers, key, "left")
    if features is not None:
        out = out.join(features, key, "left")
    return out
