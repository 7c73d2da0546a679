"""Driver queries for coverage reports (Q4) and the coverage guard (Q2).

Bridge B4: one JaCoCo-style report per lineitem row (run = order):
LINE counters (missed = l_linenumber, covered = l_quantity) at method, class
and report level; METHOD counters (missed = l_linenumber % 2, covered = 1) at
method level and (missed = l_suppkey % 3, covered = l_quantity) at package
level.  DOCTYPE with an external DTD when (k + ln) % 3 = 0; cut short
(malformed) when (k + ln) % 17 = 0; written outside ``target/site/jacoco*``
(not discovered) when l_partkey % 7 = 0.  A byte that is no UTF-8 when (k + ln) % 31 = 0; a counter
beyond 64 bits when (k + ln) % 37 = 0.  Reports are bytes, as files are.

Guard inputs from orders: result directory unless k % 19 = 0; stored guard
row when k % 23 = 0, with a result unless k % 2 = 0 (a stored FAIL), also for runs without result
directory, and stored twice when k % 46 = 23; no patch when k % 29 = 0; a patch that does not apply when
k % 31 = 0; pre-coverage by k % 6: 0 -> 0.0, 1 -> missing row, 2 -> NaN, else 40 + k % 50, after an older
row of the same key.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import text as T
from runlens.operators import coverage as C
from runlens.plans import bridges as B
from runlens.plans.catalog import oracle_of, register
from runlens.plans.q_builds import _RUNS_SQL, _TEST_OK_SQL, verdicts


def b4_reports(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    k, ln, q = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_quantity").cast("bigint")
    pk, sk = F.col("l_partkey"), F.col("l_suppkey")

    def s(c):
        return c.cast("string")

    def counter(t, missed, covered):
        return F.concat(F.lit(f'<counter type="{t}" missed="'), s(missed), F.lit('" covered="'), s(covered),
                        F.lit('"/>'))

    doctype = F.when((k + ln) % 3 == 0, F.lit(
        '<!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd">')).otherwise(F.lit(""))
    xml = F.when(F.col("_cut"), F.expr("substring(_x, 1, length(_x) - 12)")).otherwise(F.col("_x"))
    site = F.when(pk % 7 == 0, F.lit("/target/site/coverage/jacoco.xml")).when(
        pk % 2 == 0, F.lit("/target/site/jacoco-aggregate/jacoco.xml")).otherwise(F.lit("/target/site/jacoco/jacoco.xml"))
    path = F.concat(F.lit("r_"), s(k), F.lit("/m"), s(ln), F.lit("_"), s(pk), site)
    base = li.select(k.alias("run_id"), path.alias("path"), ((k + ln) % 17 == 0).alias("_cut"), ((k + ln) % 31 == 0).alias("_bad"),
                     _xml_expr(k, ln, q, pk, sk, doctype, counter).alias("_x"))
    raw = xml.cast("binary")
    broken = F.concat(F.substring(F.col("_x"), 1, 60).cast("binary"), F.unhex(F.lit("FF")), F.expr("substring(_x, 61)").cast("binary"))
    return base.select("run_id", "path", F.when(F.col("_bad"), broken).otherwise(raw).alias("xml"))


def _xml_expr(k, ln, q, pk, sk, doctype, counter):
    def s(c):
        return c.cast("string")
    return F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'), doctype,
        F.lit('<report name="r'), s(k), F.lit('"><sessioninfo id="s" start="1" dump="2"/>'),
        F.lit('<package name="p'), s(pk), F.lit('"><class name="A" sourcefilename="A.java">'),
        F.lit('<method name="run" desc="()V" line="1">'), counter("INSTRUCTION", F.lit(3), F.lit(4)),
        counter("LINE", ln, q), counter("METHOD", ln % 2, F.lit(1)), F.lit("</method>"),
        counter("LINE", ln, q), F.lit("</class>"), counter("METHOD", sk % 3, q), F.lit("</package>"),
        F.when((k + ln) % 37 == 0, counter("LINE", F.lit("9223372036854775807"), F.lit(1))).otherwise(F.lit("")),
        counter("LINE", ln, q), F.lit("</report>"))


def coverage_after(spark, sf_dir):
    reports = C.discover_reports(b4_reports(spark, sf_dir))
    return C.coverage_per_run(C.report_counters(reports))


_REPORTS_SQL = """
  SELECT l_orderkey AS k, l_linenumber AS ln, CAST(l_quantity AS BIGINT) AS q, l_partkey AS pk, l_suppkey AS sk,
         (l_orderkey + l_linenumber) % 17 <> 0 AND (l_orderkey + l_linenumber) % 31 <> 0
           AND (l_orderkey + l_linenumber) % 37 <> 0 AS valid, l_partkey % 7 <> 0 AS found
  FROM lineitem"""
_PER_RUN_SQL = f"""
  SELECT k AS run_id, SUM(3 * ln) AS lm, SUM(3 * q) AS lc, SUM(ln % 2 + sk % 3) AS mm, SUM(1 + q) AS mc
  FROM ({_REPORTS_SQL}) r WHERE valid AND found GROUP BY k"""


@register("coverage_report", oracle=f"""
SELECT k AS run_id, valid,
       CAST(CASE WHEN valid THEN 3 * ln END AS BIGINT) AS line_missed,
       CAST(CASE WHEN valid THEN 3 * q END AS BIGINT) AS line_covered,
       CAST(CASE WHEN valid THEN ln % 2 + sk % 3 END AS BIGINT) AS method_missed,
       CAST(CASE WHEN valid THEN 1 + q END AS BIGINT) AS method_covered
FROM ({_REPORTS_SQL}) r WHERE found""")
def q_coverage_report(spark, sf_dir):
    """S6 + A4: discovered reports and their counters (malformed -> valid = false)."""
    r = C.report_counters(C.discover_reports(b4_reports(spark, sf_dir)))
    return r.select("run_id", "valid", "line_missed", "line_covered", "method_missed", "method_covered")


@register("coverage_files", oracle="""
SELECT s_suppkey AS run_id, CAST(i AS INTEGER) AS module, (s_suppkey + i) % 17 <> 0 AS valid,
       CAST(CASE WHEN (s_suppkey + i) % 17 <> 0 THEN i + 2 END AS BIGINT) AS line_missed,
       CAST(CASE WHEN (s_suppkey + i) % 17 <> 0 THEN s_suppkey + 3 END AS BIGINT) AS line_covered,
       CAST(CASE WHEN (s_suppkey + i) % 17 <> 0 THEN 1 END AS BIGINT) AS method_missed,
       CAST(CASE WHEN (s_suppkey + i) % 17 <> 0 THEN i END AS BIGINT) AS method_covered
FROM supplier, range(2) t(i)""")
def q_coverage_files(spark, sf_dir):
    """S6 from files: per supplier a workspace with reports of two modules, one outside the searched places and a report that
    is cut short here and there; written, discovered while listing, read and counted.  Writes its files at the time of the call."""
    from runlens.sources import files as S
    s, i = F.col("s_suppkey"), F.col("i")
    site = F.element_at(F.array(*map(F.lit, ("site/jacoco", "site/jacoco-aggregate", "site/coverage", "classes/jacoco"))), i + 1)
    rel = F.concat(F.lit("r_"), s.cast("string"), F.lit("/m"), i.cast("string"), F.lit("/target/"), site, F.lit("/jacoco.xml"))
    xml = F.concat(F.lit('<!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd"><report name="r"><counter type="LINE" missed="'),
                   i.cast("string"), F.lit('" covered="'), s.cast("string"),
                   F.lit('"/><package name="p"><counter type="METHOD" missed="1" covered="'), i.cast("string"),
                   F.lit('"/><counter type="LINE" missed="2" covered="3"/></package>'),
                   F.when((s + i) % 17 != 0, F.lit("</report>")).otherwise(F.lit("")))
    files = B.table(spark, sf_dir, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("i"))
    root = B.files_written(files.select(rel.alias("rel"), xml.alias("content")), "coverage")
    r = C.report_counters(S.scan_coverage_reports(spark, root))
    return r.select(F.regexp_extract("path", "/r_([0-9]+)/", 1).cast("bigint").alias("run_id"),
                    F.regexp_extract("path", "/m([0-9]+)/", 1).cast("int").alias("module"),
                    "valid", "line_missed", "line_covered", "method_missed", "method_covered")


@register("coverage_repo", oracle=f"""
WITH p AS ({_PER_RUN_SQL})
SELECT run_id, 'LINE' AS counter_type, CAST(lm AS BIGINT) AS missed, CAST(lc AS BIGINT) AS covered,
       CAST(lm + lc AS BIGINT) AS total, CASE WHEN lm + lc > 0 THEN lc / (lm + lc) * 100 ELSE 0.0 END AS percent FROM p
UNION ALL
SELECT run_id, 'METHOD', CAST(mm AS BIGINT), CAST(mc AS BIGINT), CAST(mm + mc AS BIGINT),
       CASE WHEN mm + mc > 0 THEN mc / (mm + mc) * 100 ELSE 0.0 END FROM p""")
def q_coverage_repo(spark, sf_dir):
    """Q4/A5 in long form: one row per (run, counter type)."""
    return C.coverage_long(coverage_after(spark, sf_dir))


def guard_inputs(spark, sf_dir):
    v = verdicts(spark, sf_dir)
    k = F.col("run_id")
    manifest = v.select("run_id", "repo", "has_result", "test_success", (k % 29 != 0).alias("has_patch"),
                        F.when(k % 31 == 0, F.concat(F.lit("patch does not apply: "), k.cast("string"))).alias("patch_error"))
    results_dirs = B.b1_runs(spark, sf_dir).where(k % 19 != 0).select("run_id")
    from runlens.operators import runs
    candidates = runs.with_results(manifest, results_dirs, key="run_id")
    o = B.table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    repo = F.concat(F.lit("own"), (F.col("o_custkey") % 97).cast("string"), F.lit("/r_"), ok.cast("string"))
    before, after = F.lit(50.0), F.lit(45.0) + (ok % 10).cast("double")
    change, passed = C.coverage_change(before, after)
    has = ok % 2 != 0
    stored = (o.where(ok % 23 == 0).select(
        ok.alias("run_id"), repo.alias("repo"), F.when(has, "SUCCESS").otherwise("FAIL").alias("status"),
        F.when(~has, "gone wrong").alias("error"), F.when(has, before).alias("cov_before"), F.when(has, after).alias("cov_after"),
        F.when(has, change).alias("cov_percent_change"), F.when(has, passed).alias("cov_guard_pass"),
        F.explode(F.sequence(F.lit(0), (ok % 46 == 23).cast("int"))).alias("_copy")).drop("_copy"))
    pct = (F.when(ok % 6 == 0, F.lit(0.0)).when(ok % 6 == 2, F.lit(float("nan")))
           .otherwise((F.lit(40) + ok % 50).cast("double")))
    # The CSV holds directory-style keys, an older row in front of the one that counts; recover them (F3) before the lookup.
    rows = F.array(F.struct(F.lit(0).alias("nth"), F.lit(99.0).alias("percent_before")), F.struct(F.lit(1).alias("nth"), pct.alias("percent_before")))
    pre_csv = o.filter(ok % 6 != 1).select(T.safe_key(repo).alias("repo_dir"), F.inline(rows))
    pre_cov = pre_csv.select(T.recover_key("repo_dir").alias("repo"), "nth", "percent_before")
    return candidates, stored, coverage_after(spark, sf_dir), pre_cov


def guard(spark, sf_dir):
    return C.guard_rows(*guard_inputs(spark, sf_dir), pre_order="nth")


_GUARD_SQL = f"""
WITH r AS ({_RUNS_SQL}),
v AS (SELECT k, repo, has_result, {_TEST_OK_SQL} AS test_success, k % 29 <> 0 AS has_patch,
             k % 23 = 0 AND k % 2 <> 0 AS stored, k % 31 = 0 AS bad_patch FROM r WHERE k % 19 <> 0),
a AS ({_PER_RUN_SQL}),
pre AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 6 = 0 THEN 0.0 WHEN o_orderkey % 6 = 2 THEN 'NaN'::DOUBLE
                                     ELSE CAST(40 + o_orderkey % 50 AS DOUBLE) END AS before
        FROM orders WHERE o_orderkey % 6 <> 1),
j AS (SELECT v.*, CASE WHEN a.run_id IS NOT NULL THEN CASE WHEN lm + lc > 0 THEN lc / (lm + lc) * 100 ELSE 0.0 END END AS after,
             pre.before, pre.k IS NOT NULL AS known
      FROM v LEFT JOIN a ON a.run_id = v.k LEFT JOIN pre ON pre.k = v.k),
s AS (SELECT *, CASE WHEN stored THEN 'SKIP' WHEN NOT has_result THEN 'FAIL'
                     WHEN test_success IS NOT TRUE THEN 'SKIP' WHEN NOT has_patch OR bad_patch THEN 'FAIL'
                     WHEN after IS NULL THEN 'FAIL' WHEN NOT known THEN 'FAIL' WHEN before = 0 THEN 'FAIL'
                     ELSE 'SUCCESS' END AS status FROM j),
g AS (SELECT k AS run_id, repo, status,
             CASE WHEN stored THEN NULL WHEN NOT has_result THEN '{C.ERR_EMPTY_RESULT.replace("'", "''")}'
                  WHEN test_success IS NOT TRUE THEN NULL WHEN NOT has_patch THEN NULL
                  WHEN bad_patch THEN '{C.ERR_PATCH_PREFIX}patch does not apply: ' || CAST(k AS VARCHAR)
                  WHEN after IS NULL THEN '{C.ERR_NO_COVERAGE}' WHEN NOT known THEN '''' || repo || ''''
                  WHEN before = 0 THEN '{C.ERR_ZERO_BEFORE}' END AS error,
             CAST(CASE WHEN stored THEN 50.0 WHEN status = 'SUCCESS' THEN before END AS DOUBLE) AS cov_before,
             CAST(CASE WHEN stored THEN 45.0 + k % 10 WHEN status = 'SUCCESS' THEN after END AS DOUBLE) AS cov_after
      FROM s),
c AS (SELECT *, CASE WHEN cov_before IS NOT NULL THEN cov_after / cov_before - 1 END AS cov_percent_change FROM g)
"""


@register("guard_rows", oracle=_GUARD_SQL + """
SELECT run_id, repo, status, error, CAST(cov_before AS DOUBLE) AS cov_before, CAST(cov_after AS DOUBLE) AS cov_after,
       cov_percent_change,
       CASE WHEN cov_before IS NOT NULL THEN NOT isnan(cov_percent_change) AND cov_percent_change > -0.05 END
         AS cov_guard_pass
FROM c""")
def q_guard_rows(spark, sf_dir):
    """Q2 per-repo rows (resume from stored results, coverage after, pre-coverage lookup)."""
    return guard(spark, sf_dir)


@register("guard_summary", oracle=_GUARD_SQL + """,
p AS (SELECT *, CASE WHEN cov_before IS NOT NULL THEN NOT isnan(cov_percent_change) AND cov_percent_change > -0.05 END
         AS pass FROM c)
SELECT CAST(COUNT_IF(pass) AS BIGINT) AS passed, CAST(COUNT(pass) AS BIGINT) AS total,
       CASE WHEN COUNT(pass) > 0 THEN COUNT_IF(pass) / COUNT(pass) ELSE 0.0 END AS cov_guard_pass_rate,
       CAST(COUNT_IF(status = 'FAIL') AS BIGINT) AS job_fails
FROM p""")
def q_guard_summary(spark, sf_dir):
    """A6 over the guard rows."""
    return C.guard_summary(guard(spark, sf_dir))


@register("guard_status_counts", oracle=_GUARD_SQL + """
SELECT CAST(COUNT_IF(status = 'SUCCESS') AS BIGINT) AS success, CAST(COUNT_IF(status = 'FAIL') AS BIGINT) AS fail,
       CAST(COUNT_IF(status = 'SKIP') AS BIGINT) AS skip FROM c""")
def q_guard_status_counts(spark, sf_dir):
    """A2 over guard rows."""
    from runlens.operators import runs
    return runs.result_stats(guard(spark, sf_dir))


@register("guard_written", oracle=_GUARD_SQL + """,
p AS (SELECT *, CASE WHEN cov_before IS NOT NULL THEN NOT isnan(cov_percent_change) AND cov_percent_change > -0.05 END
         AS pass FROM c)
SELECT run_id, repo, status, error, pass AS cov_guard_pass, (SELECT CAST(COUNT_IF(status = 'FAIL') AS BIGINT) FROM p) AS job_fails FROM p""")
def q_guard_written(spark, sf_dir):
    """K3: guard rows and summary stored and read back.  Writes at the time of the call."""
    out = _report_folder(spark)
    _write(guard(spark, sf_dir), out)
    fails = spark.read.schema("job_fails bigint").json(f"{out}/summary")
    return (spark.read.parquet(f"{out}/repo_results").select("run_id", "repo", "status", "error", "cov_guard_pass")
            .withColumn("job_fails", fails.scalar()))


def _report_folder(spark) -> str:
    import uuid

    from runlens.session import checkpoint_dir
    return f"{checkpoint_dir(spark).rstrip('/')}/runlens-io/guard-{uuid.uuid4().hex[:12]}"


def _write(rows, out: str) -> None:
    """The rows are computed once: the summary is counted from what was written of them."""
    from runlens.session import materialize
    from runlens.sources import files as S
    rows = materialize(rows, "guard-report")
    S.write_guard_report(rows, C.guard_summary(rows), out)


@register("guard_resume", oracle=_GUARD_SQL + """
SELECT run_id, repo, CASE WHEN cov_before IS NOT NULL AND cov_percent_change IS NOT NULL THEN 'SKIP' ELSE status END AS status, error,
       CAST(cov_before AS DOUBLE) AS cov_before, CAST(cov_after AS DOUBLE) AS cov_after
FROM c""")
def q_guard_resume(spark, sf_dir):
    """K3 -> S5 -> guard again: rows with a result come back as SKIP with it, all others are done again.

    Writes at the time of the call.
    """
    from runlens.session import materialize
    from runlens.sources import files as S
    candidates, stored, after, pre_cov = guard_inputs(spark, sf_dir)
    # Both guards read these: logs and reports are parsed once.
    candidates, after = materialize(candidates, "guard-candidates"), materialize(after, "guard-after")
    out = _report_folder(spark)
    _write(C.guard_rows(candidates, stored, after, pre_cov, pre_order="nth"), out)
    again = C.guard_rows(candidates, S.read_stored_results(spark, f"{out}/repo_results"), after, pre_cov, pre_order="nth")
    return again.select("run_id", "repo", "status", "error", "cov_before", "cov_after")


@register("guard_stored", oracle=oracle_of("guard_rows"))
def q_guard_stored(spark, sf_dir):
    """Q2 over inputs stored in buckets of runs: the joins need no shuffle.  Writes its tables at the time of the call."""
    import uuid

    from runlens.operators import guard_store as G
    prefix = f"guard_{uuid.uuid4().hex[:12]}"
    G.store_guard_inputs(*guard_inputs(spark, sf_dir), prefix, _report_folder(spark), pre_order="nth")
    return G.stored_guard_rows(spark, prefix)
