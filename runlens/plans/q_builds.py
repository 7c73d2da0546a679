"""Driver queries for build verdicts and the run funnel (Q1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import maven as M
from runlens.operators import buildlog, runs
from runlens.plans import bridges as B
from runlens.plans.catalog import register

# Expected verdicts, computed from order/lineitem columns (never from the text).
_RUNS_SQL = """
  SELECT o_orderkey AS k,
         'own' || CAST(o_custkey % 97 AS VARCHAR) || '/r_' || CAST(o_orderkey AS VARCHAR) AS repo,
         o_orderkey % 11 <> 0 AS has_result,
         o_orderkey % 13 = 0 AS build_only,
         o_orderkey % 7 IN (0, 1, 2) AS cfail
  FROM orders"""
_TEST_OK_SQL = """CASE WHEN has_result AND NOT cfail AND NOT build_only THEN
      CASE WHEN k % 5 IN (2, 3, 4) THEN TRUE WHEN k % 5 = 0 THEN FALSE
           WHEN k % 2 = 0 THEN FALSE END END"""


def verdicts(spark, sf_dir):
    """Per-run verdict from the B1 runs and build-log lines."""
    r = B.b1_runs(spark, sf_dir)
    v = buildlog.attach_verdict(r, buildlog.verdict_inputs(B.b1_log_lines(spark, sf_dir)))
    has = F.col("has_result")
    cols = ["build_success", "test_success", *M.TEST_COUNTER_FIELDS]
    return v.select("run_id", "repo", "has_result", *[F.when(has, F.col(c)).alias(c) for c in cols])


@register("build_verdict", oracle=f"""
WITH r AS ({_RUNS_SQL}),
li AS (SELECT l_orderkey AS k, SUM(CAST(l_quantity AS BIGINT)) AS tr, SUM(l_linenumber) AS fl,
              SUM(l_partkey % 3) AS sk
       FROM lineitem GROUP BY l_orderkey),
v AS (SELECT r.k, repo, has_result, cfail, build_only, tr, fl, sk,
             has_result AND NOT cfail AND NOT build_only AS tested
      FROM r LEFT JOIN li ON r.k = li.k)
SELECT k AS run_id, repo, has_result,
       CASE WHEN has_result THEN NOT cfail END AS build_success,
       {_TEST_OK_SQL} AS test_success,
       CAST(CASE WHEN tested THEN tr END AS BIGINT) AS tests_run,
       CAST(CASE WHEN tested THEN fl END AS BIGINT) AS failures,
       CAST(CASE WHEN tested AND tr IS NOT NULL THEN 0 END AS BIGINT) AS errors,
       CAST(CASE WHEN tested THEN sk END AS BIGINT) AS skipped
FROM v""")
def q_build_verdict(spark, sf_dir):
    return verdicts(spark, sf_dir)


@register("funnel", oracle=f"""
WITH r AS ({_RUNS_SQL}),
v AS (SELECT has_result, has_result AND NOT cfail AS bok, {_TEST_OK_SQL} AS tok FROM r)
SELECT 'run_job' AS stage, CAST(COUNT(*) AS BIGINT) AS started, CAST(COUNT_IF(has_result) AS BIGINT) AS succeeded FROM v
UNION ALL SELECT 'compile', CAST(COUNT_IF(has_result) AS BIGINT), CAST(COUNT_IF(bok) AS BIGINT) FROM v
UNION ALL SELECT 'test', CAST(COUNT_IF(bok) AS BIGINT), CAST(COUNT_IF(tok) AS BIGINT) FROM v
UNION ALL SELECT 'overall', CAST(COUNT(*) AS BIGINT), CAST(COUNT_IF(tok) AS BIGINT) FROM v""")
def q_funnel(spark, sf_dir):
    return runs.funnel(verdicts(spark, sf_dir))


@register("test_counters_text", oracle="""
SELECT l_orderkey AS run_id, l_linenumber AS line_no, l_partkey AS part_id,
       TRUE AS test_success,
       FALSE AS compile_failed,
       CAST(CASE WHEN l_partkey % 4 <> 0 THEN 2 * CAST(l_quantity AS BIGINT) END AS BIGINT) AS tests_run,
       CAST(CASE WHEN l_partkey % 4 <> 0 THEN l_linenumber END AS BIGINT) AS failures,
       CAST(CASE WHEN l_partkey % 4 <> 0 THEN l_linenumber END AS BIGINT) AS errors,
       CAST(CASE WHEN l_partkey % 4 <> 0 THEN l_partkey % 3 END AS BIGINT) AS skipped
FROM lineitem""")
def q_test_counters_text(spark, sf_dir):
    """Whole-text form of F4/F8/A3 (one log per lineitem row, summed over all matches)."""
    t = B.b1_test_texts(spark, sf_dir)
    # The counter struct is computed once and then expanded (not once per field).
    staged = t.select("run_id", "line_no", "part_id",
                      M.overall_success("log").alias("test_success"),
                      M.compile_failed("log").alias("compile_failed"),
                      M.test_counters("log").alias("_c"))
    return staged.select("run_id", "line_no", "part_id", "test_success", "compile_failed",
                         *[F.col(f"_c.{n}").alias(n) for n in M.TEST_COUNTER_FIELDS])


@register("result_stats", oracle=f"""
WITH r AS ({_RUNS_SQL}),
s AS (SELECT CASE WHEN NOT has_result THEN 'FAIL' WHEN {_TEST_OK_SQL} THEN 'SUCCESS' ELSE 'SKIP' END AS status FROM r)
SELECT CAST(COUNT_IF(status = 'SUCCESS') AS BIGINT) AS success, CAST(COUNT_IF(status = 'FAIL') AS BIGINT) AS fail,
       CAST(COUNT_IF(status = 'SKIP') AS BIGINT) AS skip FROM s""")
def q_result_stats(spark, sf_dir):
    """A2 over job statuses: no result -> FAIL, tests passed -> SUCCESS, else SKIP."""
    v = verdicts(spark, sf_dir)
    st = (F.when(~F.col("has_result"), "FAIL")
          .when(F.col("test_success"), "SUCCESS").otherwise("SKIP"))
    return runs.result_stats(v.select(st.alias("status")))


def b1_verdict_texts(spark, sf_dir):
    """Whole compile and test logs per lineitem row (row-local), for the text form of F10.

    compile log by (k + ln) % 7: 0 compiler-plugin failure, 1 [FATAL], 2 BUILD FAILURE, else success;
    test log: a per-class and a total surefire line, a marker by (k + ln) % 5 (0 failure, 1 none,
    2 both, else success), and a compiler-plugin failure line when (k + ln) % 9 = 0; build-only when
    l_partkey % 13 = 0.
    """
    li = B.table(spark, sf_dir, "lineitem")
    k, ln, pk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey")
    q = F.col("l_quantity").cast("bigint").cast("string")
    h = k + ln
    fail_line = F.lit("[ERROR] Failed to execute goal org.apache.maven.plugins:maven-compiler-plugin:3.11.0:compile "
                      "(default-compile) on project x: Compilation failure")
    compile_log = F.concat_ws(
        "\n", F.lit("[INFO] Scanning for projects..."),
        F.when(h % 7 == 0, fail_line).when(h % 7 == 1, F.lit("[FATAL] Non-resolvable parent POM"))
        .when(h % 7 == 2, F.lit("[INFO] BUILD FAILURE")).otherwise(F.lit("[INFO] BUILD SUCCESS")))
    marker = (F.when(h % 5 == 0, F.lit("[INFO] BUILD FAILURE")).when(h % 5 == 1, F.lit("[INFO] done"))
              .when(h % 5 == 2, F.lit("[INFO] BUILD SUCCESS\n[ERROR] BUILD FAILURE"))
              .otherwise(F.lit("[INFO] BUILD SUCCESS")))
    test_log = F.concat_ws(
        "\n",
        F.concat(F.lit("Tests run: "), q, F.lit(", Failures: "), ln.cast("string"), F.lit(", Errors: 0, Skipped: "),
                 (pk % 3).cast("string")),
        F.concat(F.lit("Tests run: "), q, F.lit(", Failures: 0, Errors: "), ln.cast("string"), F.lit(", Skipped: 0")),
        marker, F.when(h % 9 == 0, fail_line))
    return li.select(k.alias("run_id"), ln.alias("line_no"), pk.alias("part_id"),
                     compile_log.alias("compile_log"), test_log.alias("test_log"), (pk % 13 == 0).alias("build_only"))


@register("build_verdict_text", oracle="""
WITH r AS (SELECT l_orderkey AS run_id, l_linenumber AS line_no, l_partkey AS part_id,
                  CAST(l_quantity AS BIGINT) AS q, (l_orderkey + l_linenumber) AS h,
                  (l_orderkey + l_linenumber) % 7 IN (0, 1, 2) AS cfail, l_partkey % 13 = 0 AS build_only
           FROM lineitem),
v AS (SELECT *, NOT cfail AND NOT build_only AS tested FROM r)
SELECT run_id, line_no, part_id, NOT cfail AS build_success,
       CASE WHEN tested THEN CASE WHEN h % 5 IN (2, 3, 4) THEN TRUE WHEN h % 5 = 0 THEN FALSE END END AS test_success,
       CASE WHEN tested THEN 2 * q END AS tests_run,
       CAST(CASE WHEN tested THEN line_no END AS BIGINT) AS failures,
       CAST(CASE WHEN tested THEN line_no END AS BIGINT) AS errors,
       CAST(CASE WHEN tested THEN part_id % 3 END AS BIGINT) AS skipped,
       CASE WHEN tested THEN h % 9 = 0 END AS test_log_compile_failure
FROM v""")
def q_build_verdict_text(spark, sf_dir):
    """F10 on whole compile/test log texts (one pair per lineitem row)."""
    from runlens.operators._plan import evaluate_once
    t = b1_verdict_texts(spark, sf_dir)
    # The verdict struct is computed once per row, then its fields are read.
    staged = evaluate_once(t.select("run_id", "line_no", "part_id",
                                    M.build_verdict("compile_log", "test_log", "build_only").alias("v")))
    return staged.select("run_id", "line_no", "part_id", F.col("v.build_success").alias("build_success"),
                         F.col("v.test_success").alias("test_success"),
                         *[F.col(f"v.test_results.{n}").alias(n) for n in M.TEST_COUNTER_FIELDS],
                         F.col("v.test_log_compile_failure").alias("test_log_compile_failure"))

