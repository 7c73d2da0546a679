"""Build verdicts (F10, F4, F8, A3) over build logs held as *lines*.

A build log read with ``spark.read.text`` arrives as one row per line, so a
multi-GB log is split across many tasks.  The verdict is an aggregate per run
of per-line predicates: ``bool_or`` of the markers and ``try_sum`` of the
counters.  Both are algebraic, so Spark runs a partial aggregate before the
shuffle and one heavy run only ever sends one partial row per map task.

The whole-text form of the same verdict is ``runlens.functions.maven.build_verdict``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import maven as M


def verdict_inputs(lines: DataFrame, run_col: str = "run_id", kind_col: str = "kind",
                   line_col: str = "line") -> DataFrame:
    """Per-run marker flags and counter sums from (run, kind, line) rows.

    ``kind`` is ``'compile'`` for the compile-only log and ``'test'`` for the
    test log.  Lines of the same log may arrive in any order: every flag is an
    OR and every counter a sum, exactly like substring tests and ``findall``
    over the joined text (markers never span a line break).
    """
    # One row per counter match (explode_outer keeps lines without a match):
    # flags are ORs, so repeating a line per match leaves them unchanged, and
    # the numbers are summed by plain compiled aggregates.
    x = lines.select(run_col, kind_col, line_col, F.explode_outer(
        F.regexp_extract_all(F.col(line_col), F.lit(M.TEST_COUNTER_RE), F.lit(0))).alias("_m"))
    line = F.col(line_col)
    is_c = F.col(kind_col) == "compile"
    is_t = F.col(kind_col) == "test"
    aggs = [
        F.bool_or(is_c & M.compile_failed(line)).alias("c_fail"),
        F.bool_or(is_t & line.contains(M.BUILD_SUCCESS)).alias("t_succ"),
        F.bool_or(is_t & line.contains(M.BUILD_FAILURE)).alias("t_fail"),
        F.bool_or(is_t & line.contains(M.FATAL_TAG)).alias("t_fatal"),
        F.bool_or(is_t & line.rlike(M.COMPILER_FAILURE_RE)).alias("t_cfail"),
        F.count(F.when(is_t, F.col("_m"))).alias("t_matches"),
    ]
    for i, name in enumerate(M.TEST_COUNTER_FIELDS, start=1):
        v = F.regexp_extract(F.col("_m"), M.TEST_COUNTER_RE, i).try_cast("bigint")
        aggs.append(F.try_sum(F.when(is_t, v)).alias(f"t_{name}"))
    return x.groupBy(run_col).agg(*aggs)


def attach_verdict(runs: DataFrame, inputs: DataFrame, run_col: str = "run_id",
                   build_only_col: str | None = "build_only") -> DataFrame:
    """Left-join per-run flags onto ``runs`` and derive the verdict columns.

    A run without any line has empty logs: it compiles, and its test outcome
    and counters are NULL.
    """
    j = runs.join(inputs, run_col, "left")
    b_only = F.coalesce(F.col(build_only_col), F.lit(False)) if build_only_col else F.lit(False)
    failed = F.coalesce(F.col("c_fail"), F.lit(False))
    tested = ~failed & ~b_only
    outcome = (F.when(F.col("t_succ"), F.lit(True))
               .when(F.col("t_fail") | F.col("t_fatal"), F.lit(False))
               .otherwise(F.lit(None).cast("boolean")))
    has_counts = tested & (F.coalesce(F.col("t_matches"), F.lit(0)) > 0)
    # One projection (not a chain of withColumn calls, each of which re-analyses the plan).
    return j.select(
        *runs.columns,
        (~failed).alias("build_success"),
        F.when(tested, outcome).alias("test_success"),
        F.when(tested, F.coalesce(F.col("t_cfail"), F.lit(False))).alias("test_log_compile_failure"),
        *[F.when(has_counts, F.col(f"t_{n}")).alias(n) for n in M.TEST_COUNTER_FIELDS])

