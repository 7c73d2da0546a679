"""Coverage reports (S6, A4, A5, Q4) and the coverage guard.

Reports are rows ``(run_id, path, xml)``.  Each report is screened and summed
in its own row (map-only); the per-run total is a ``groupBy`` with partial
aggregation, so a run with thousands of module reports sends one partial row
per task to the shuffle.  The guard is a chain of equi-joins on the run key
and a ``CASE`` cascade; no Python runs per row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import xml as X
from runlens.operators._plan import evaluate_once
from runlens.session import ship_package

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Report discovery glob **/target/site/jacoco*/jacoco.xml as a path regex.
REPORT_PATH_RE = "(^|/)target/site/jacoco[^/]*/jacoco\\.xml$"
# Guard threshold: a change must be strictly greater than this to pass.
COV_DECREASE_FLOOR = -0.05
# Error texts of guard FAIL rows.
ERR_NO_COVERAGE = "Failed calculating coverage"
ERR_EMPTY_RESULT = "'NoneType' object is not subscriptable"
ERR_ZERO_BEFORE = "float division by zero"
ERR_PATCH_PREFIX = "Failed applying patch: "
# ---------------------------------------------------------------------------


def discover_reports(files: DataFrame, path_col: str = "path") -> DataFrame:
    """Keep coverage reports by path (``**/target/site/jacoco*/jacoco.xml``)."""
    return files.filter(F.col(path_col).rlike(REPORT_PATH_RE))


def report_counters(reports: DataFrame, xml_col: str = "xml") -> DataFrame:
    """A4: per report, LINE/METHOD missed+covered sums over all depths; ``valid`` flag.

    ``xml_col`` is text or (better, as files have it) binary.  Reports that are malformed, badly encoded
    or hold a counter that is no 64-bit integer get ``valid = false`` and NULL counters: the reference
    skips bad reports and goes on.

    In two stages: a pattern proves most reports regular, and column functions count those; the parser in
    Python workers is handed the texts of the others only (NULL stands for a regular one).
    """
    ship_package(reports.sparkSession)
    others = [x for x in reports.columns if x != xml_col]
    screened = reports.withColumn("_regular", X.regular_report(xml_col))
    counted = screened.select(*others, "_regular", F.when(F.col("_regular"), X.regular_counters(xml_col)).alias("_sums"),
                              F.when(~F.col("_regular"), F.col(xml_col)).alias("_doubtful"))
    # Regular reports are counted, and their texts dropped, before rows wait for the Python workers.
    asked = X.coverage_counters(F.when(~F.col("_regular"), F.col("_doubtful")))
    staged = evaluate_once(evaluate_once(counted).withColumn("_c", asked).drop("_doubtful"))
    names = ("line_missed", "line_covered", "method_missed", "method_covered")
    valid = F.col("_regular") | F.coalesce(F.col("_c.message") == X.WELL_FORMED_MSG, F.lit(False))
    return staged.select(*others, valid.alias("valid"), *[F.coalesce(f"_sums.{f}", f"_c.{f}").alias(f) for f in names])


def _summary(missed, covered, prefix: str):
    total = missed + covered
    pct = F.when(total > 0, covered / total * 100).otherwise(F.lit(0.0))
    return [missed.alias(f"{prefix}_missed"), covered.alias(f"{prefix}_covered"),
            total.alias(f"{prefix}_total"), pct.alias(f"{prefix}_percent")]


def coverage_per_run(counters: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A5/Q4: sum valid reports per run; total and percent (0.0 when total is 0).

    Runs whose reports are all invalid get no row (the reference returns None).
    """
    v = counters.filter("valid")
    agg = v.groupBy(run_col).agg(*[F.sum(c).alias(c) for c in
                                   ("line_missed", "line_covered", "method_missed", "method_covered")])
    return agg.select(run_col, *_summary(F.col("line_missed"), F.col("line_covered"), "line"),
                      *_summary(F.col("method_missed"), F.col("method_covered"), "method"))


def coverage_long(per_run: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Long form (run, counter_type, missed, covered, total, percent)."""
    return per_run.select(run_col, F.expr(
        "stack(2, 'LINE', line_missed, line_covered, line_total, line_percent, "
        "'METHOD', method_missed, method_covered, method_total, method_percent) "
        "as (counter_type, missed, covered, total, percent)"))


def coverage_change(before, after):
    """(change, pass).  ``after / before - 1``; zero before -> NULL; NaN never passes."""
    change = F.try_divide(after, F.when(before != 0, before)) - 1
    passed = (~F.isnan(change)) & (change > F.lit(COV_DECREASE_FLOOR))
    return change, passed


def stored_results(stored: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Earlier guard rows that carry a result (a FAIL or a SKIP without result does not), one per run.

    Of repeated runs the greatest row by its values is taken, so the choice does not depend on row order.
    """
    has = stored.where(F.col("cov_guard_pass").isNotNull())
    return (has.groupBy(run_col).agg(F.max(F.struct(*_RESULT)).alias("_r"))
            .select(run_col, *[F.col(f"_r.{c}").alias(c) for c in _RESULT]))


_RESULT = ("cov_before", "cov_after", "cov_percent_change", "cov_guard_pass")


def guard_rows(candidates: DataFrame, stored: DataFrame, coverage_after: DataFrame, pre_cov: DataFrame,
               run_col: str = "run_id", repo_col: str = "repo", pre_order: str | None = None) -> DataFrame:
    """Q2 per-repo rows: status FAIL/SKIP/SUCCESS, error and the coverage result.

    ``candidates``: manifest items that have a result directory (J1 output) with
    ``has_result``, ``test_success``, ``has_patch`` and, if there is one, ``patch_error``
    (why the patch could not be applied).  ``stored``: earlier guard rows as
    ``write_guard_report`` stores them; a candidate whose stored row carries a result comes back as SKIP
    with it (J4/U1), any other stored row is ignored and its run is done again.
    ``coverage_after``: Q4 per run.  ``pre_cov``: (repo, percent_before), looked up with a left join (J2)
    so a missing key is a FAIL row, never a dropped row; a key that repeats has its last row by
    ``pre_order`` (its greatest value if no order is named).
    """
    earlier, after, known = lookups(stored, coverage_after, pre_cov, run_col, repo_col, pre_order)
    return decided_rows(candidates.join(earlier, run_col, "left").join(after, run_col, "left")
                        .join(known, F.col(repo_col) == F.col("_key"), "left"), run_col, repo_col)


def lookups(stored: DataFrame, coverage_after: DataFrame, pre_cov: DataFrame, run_col: str, repo_col: str,
            pre_order: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the guard looks up, one row per key: (run, _stored), (run, _after) and (_key: repo, _before, _known)."""
    known = pre_cov.groupBy(F.col(repo_col).alias("_key")).agg(
        (F.max_by("percent_before", pre_order) if pre_order else F.max("percent_before")).alias("_before"), F.lit(True).alias("_known"))
    earlier = stored_results(stored, run_col).select(run_col, F.struct(*_RESULT).alias("_stored"))
    return earlier, coverage_after.select(run_col, F.col("line_percent").alias("_after")), known


def decided_rows(j: DataFrame, run_col: str, repo_col: str) -> DataFrame:
    """Guard rows of candidates that carry what was looked up for them (``_stored``, ``_after``, ``_before``, ``_known``)."""
    before, after = F.col("_before"), F.col("_after")
    patch_error = F.col("patch_error") if "patch_error" in j.columns else F.lit(None).cast("string")
    change, passed = coverage_change(before, after)
    none = F.lit(None).cast("string")
    # In the order in which the work is done: the first that applies decides.
    outcomes = [
        (F.col("_stored").isNotNull(), "SKIP", none),
        (~F.col("has_result"), "FAIL", F.lit(ERR_EMPTY_RESULT)),
        (~F.coalesce(F.col("test_success"), F.lit(False)), "SKIP", none),
        (~F.col("has_patch"), "FAIL", none),
        (patch_error.isNotNull(), "FAIL", F.concat(F.lit(ERR_PATCH_PREFIX), patch_error)),
        (after.isNull(), "FAIL", F.lit(ERR_NO_COVERAGE)),
        (F.col("_known").isNull(), "FAIL", F.concat(F.lit("'"), F.col(repo_col), F.lit("'"))),
        (before == 0, "FAIL", F.lit(ERR_ZERO_BEFORE)),
    ]
    decided = F.lit(None).cast("struct<status: string, error: string>")
    for holds, status, error in reversed(outcomes):
        decided = F.when(holds, F.struct(F.lit(status).alias("status"), error.alias("error"))).otherwise(decided)
    fresh = F.struct(before.alias("cov_before"), after.alias("cov_after"), change.alias("cov_percent_change"),
                     passed.alias("cov_guard_pass"))
    rows = j.select(run_col, repo_col, decided.alias("_d"), F.when(F.col("_stored").isNotNull(), F.col("_stored"))
                    .when(decided.isNull(), fresh).alias("_r"))
    return rows.select(run_col, repo_col, F.coalesce("_d.status", F.lit("SUCCESS")).alias("status"), F.col("_d.error").alias("error"),
                       *[F.col(f"_r.{c}").alias(c) for c in _RESULT])


def guard_summary(rows: DataFrame) -> DataFrame:
    """Pass rate over rows that carry a result (SUCCESS and restored SKIP), 0 if none; FAIL count."""
    has = F.col("cov_guard_pass").isNotNull()
    agg = rows.agg(F.count_if(has & F.col("cov_guard_pass")).alias("passed"),
                   F.count_if(has).alias("total"),
                   F.count_if(F.col("status") == "FAIL").alias("job_fails"))
    rate = F.when(F.col("total") > 0, F.col("passed") / F.col("total")).otherwise(F.lit(0.0))
    return agg.select("passed", "total", rate.alias("cov_guard_pass_rate"), "job_fails")
