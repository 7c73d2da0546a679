"""Column functions over Maven console text (build logs, step logs).

All functions return Columns built from Spark built-ins (``contains``,
``rlike``, ``regexp_extract_all``, higher-order ``aggregate``), so they run
inside whole-stage code generation and need no Python worker.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Maven status codes, in enum order (code, name):
STATUS_NAMES = [
    (0, "NO_MAVEN"),
    (1, "COMPILE_ERROR"),
    (2, "TESTS_STARTED"),
    (3, "SUCCESS"),
    (4, "DEPENDENCY_ERROR"),
    (5, "UNKNOWN_ERROR"),
    (6, "UNKNOWN"),
    (7, "GOAL_ERROR"),
    (8, "PLUGIN_RESOLVE_ERROR"),
    (9, "INVALID_POM"),
    (10, "SKIPPED_TESTS"),
]
# Status cascade: checked top to bottom, first hit wins (a missing
# "Scanning for projects" marker means NO_MAVEN before anything else).
MAVEN_SCAN_MARKER = "Scanning for projects"
STATUS_CASCADE = [
    (("Non-parseable POM", "Malformed POM"), 9),
    (("COMPILATION ERROR",), 1),
    (("Could not resolve dependencies for project",), 4),
    (("Tests are skipped.",), 10),
    (("BUILD SUCCESS",), 3),
    (("Tests run",), 2),
    (("one of its dependencies could not be resolved",), 8),
    (("Failed to execute goal",), 7),
    (("BUILD FAILURE",), 5),
]
STATUS_FALLBACK = 6
# Build verdict markers and patterns.
BUILD_SUCCESS = "BUILD SUCCESS"
BUILD_FAILURE = "BUILD FAILURE"
FATAL_TAG = "[FATAL]"
COMPILER_FAILURE_RE = r"Failed to execute goal org\.apache\.maven\.plugins:maven-compiler-plugin:[^:]+:compile"
TEST_COUNTER_RE = r"Tests run:\s*(\d+),\s*Failures:\s*(\d+),\s*Errors:\s*(\d+),\s*Skipped:\s*(\d+)"
# ---------------------------------------------------------------------------

TEST_COUNTER_FIELDS = ("tests_run", "failures", "errors", "skipped")


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def maven_status_code(log) -> Column:
    """11-way ordered substring cascade on a step's execution log."""
    log = _col(log)
    expr = F.when(~log.contains(MAVEN_SCAN_MARKER), F.lit(0))
    for markers, code in STATUS_CASCADE:
        cond = log.contains(markers[0])
        for m in markers[1:]:
            cond = cond | log.contains(m)
        expr = expr.when(cond, F.lit(code))
    return expr.otherwise(F.lit(STATUS_FALLBACK))


def status_name(code) -> Column:
    """Status code -> enum name (a CASE over the 11 fixed names)."""
    code = _col(code)
    expr = None
    for c, name in STATUS_NAMES:
        expr = F.when(code == c, F.lit(name)) if expr is None else expr.when(code == c, F.lit(name))
    return expr


def compile_failed(log) -> Column:
    """F8 (+ the two markers of the compile step): True if the compile log failed."""
    log = _col(log)
    return log.rlike(COMPILER_FAILURE_RE) | log.contains(FATAL_TAG) | log.contains(BUILD_FAILURE)


def overall_success(log) -> Column:
    """SUCCESS marker -> true; FAILURE -> false; [FATAL] -> false; else NULL."""
    log = _col(log)
    return (F.when(log.contains(BUILD_SUCCESS), F.lit(True))
            .when(log.contains(BUILD_FAILURE), F.lit(False))
            .when(log.contains(FATAL_TAG), F.lit(False))
            .otherwise(F.lit(None).cast("boolean")))


def test_counters(log) -> Column:
    """A3: sum of all ``Tests run: …`` matches in a log; NULL when none match.

    Every match counts (surefire prints per-class lines and a total line, and
    both are summed, as the reference does).  Sums are bigint with ``try_*``
    arithmetic, so an oversized number gives NULL instead of failing the job.
    For logs held as lines, ``runlens.operators.buildlog`` sums matches with
    plain aggregates instead.
    """
    from runlens.operators._plan import let

    def sums(found: Column) -> Column:
        fields = []
        for i, name in enumerate(TEST_COUNTER_FIELDS, start=1):
            total = F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, x: F.try_add(
                acc, F.regexp_extract(x, TEST_COUNTER_RE, i).try_cast("bigint")))
            fields.append(total.alias(name))
        return F.when(F.size(found) > 0, F.struct(*fields))

    # One pass over the log; the numbers are read from the short matches.
    return let(F.regexp_extract_all(_col(log), F.lit(TEST_COUNTER_RE), F.lit(0)), sums)


def build_verdict(compile_log, test_log, build_only=None) -> Column:
    """verdict struct from (compile log, test log, build_only).

    compile failure / [FATAL] / BUILD FAILURE in the compile log -> (false, NULL, NULL);
    build-only -> (true, NULL, NULL); otherwise (true, F4(test log), A3(test log)).
    ``test_log_compile_failure`` flags the case the reference asserts against.
    """
    compile_log = _col(compile_log)
    test_log = _col(test_log)
    b_only = F.lit(False) if build_only is None else F.coalesce(_col(build_only), F.lit(False))
    failed = compile_failed(compile_log)
    tested = ~failed & ~b_only
    return F.struct(
        (~failed).alias("build_success"),
        F.when(tested, overall_success(test_log)).alias("test_success"),
        F.when(tested, test_counters(test_log)).alias("test_results"),
        F.when(tested, test_log.rlike(COMPILER_FAILURE_RE)).alias("test_log_compile_failure"),
    )
