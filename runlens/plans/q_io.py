"""Driver queries for file sources/sinks (S1, S4, S5, K1, K5, U2), user functions
and the progress stream (ST1).

Each query writes data that Spark derives from the driver tables into a fresh
folder under the shared checkpoint folder (``spark.checkpoint.dir``), then
reads it back through the source under test, so the work grows with the tables.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from runlens.operators import runs, udf as U
from runlens.plans import bridges as B
from runlens.plans.catalog import oracle_of, register
from runlens.plans.q_builds import verdicts
from runlens.session import checkpoint_dir, materialize
from runlens.sources import files as S
from runlens.streaming.progress import latest_counts, progress_counts, progress_latest


def _scratch(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/runlens-io/{name}-{uuid.uuid4().hex[:12]}"


@register("experiment_paths", oracle="""
SELECT o_orderkey AS run_id, CAST(epoch(date_trunc('second', o_orderdate)) AS BIGINT) AS run_epoch,
       'run' || CAST(o_orderkey AS VARCHAR) AS run_name
FROM orders""")
def q_experiment_paths(spark, sf_dir):
    """K5: experiment folders ``prefix/YYYY-MM-DD/HH-MM-SS-name`` parsed back to (run_ts, run_name)."""
    o = B.table(spark, sf_dir, "orders")
    path = F.concat(F.lit("data/experiments/"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/"),
                    F.date_format("o_orderdate", "HH-mm-ss"), F.lit("-run"), F.col("o_orderkey").cast("string"))
    parsed = o.select(F.col("o_orderkey").alias("run_id"), *S.parse_experiment_path(path))
    return parsed.select("run_id", F.unix_timestamp("run_ts").alias("run_epoch"), "run_name")


_EXPERIMENT_SQL = """'data/experiments/' || strftime(date_trunc('month', o_orderdate), '%Y-%m-') || '0' || CAST(1 + o_orderkey % 3 AS VARCHAR)
  || '/08-30-00-run' || CAST(o_orderkey % 2 AS VARCHAR)"""


@register("experiment_window", oracle=f"""
SELECT o_orderkey AS run_id, {_EXPERIMENT_SQL} AS experiment,
       CAST(date_trunc('month', o_orderdate) AS DATE) + CAST(o_orderkey % 3 AS INTEGER) AS run_date, o_totalprice AS cost
FROM orders WHERE month(o_orderdate) = 3 AND o_orderkey % 2 = 1""")
def q_experiment_window(spark, sf_dir):
    """K5 + S5: runs stored by the date of their experiment; those of the experiments that a table of prompts chooses, where Spark
    opens only the folders of their dates.  Writes its store at the time of the call."""
    o = B.table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    path = F.concat(F.lit("data/experiments/"), F.date_format("o_orderdate", "yyyy-MM-"), F.lit("0"), (k % 3 + 1).cast("string"),
                    F.lit("/08-30-00-run"), (k % 2).cast("string"))
    prompt = F.concat(F.month("o_orderdate").cast("string"), F.lit("-"), (k % 2).cast("string"))
    runs_of = o.select(k.alias("run_id"), path.alias("experiment"), F.col("o_totalprice").alias("cost"))
    out = _scratch(spark, "experiments")
    S.write_experiment_runs(runs_of, out)
    experiments = materialize(o.select(path.alias("experiment"), prompt.alias("prompt")).distinct(), "experiments")
    chosen = S.experiment_window(S.read_experiment_runs(spark, out), experiments.where("prompt = '3-1'"))
    return chosen.select("run_id", "experiment", "run_date", "cost")


# Manifest bridge over customer: full = all; medium = c % 5 = 0; mini = c % 15 = 0;
# tiny = c % 500 = 7 with another commit (so tiny shares no row with full).
def _manifest_yaml(spark, sf_dir, broken=None):
    c = B.table(spark, sf_dir, "customer")
    ck = F.col("c_custkey")
    repo = F.concat(F.lit("own"), F.col("c_nationkey").cast("string"), F.lit("/c"), ck.cast("string"))
    commit = F.substring(F.md5(F.col("c_name")), 1, 12)
    item = F.concat(
        F.lit("- repo_name: "), repo, F.lit("\n  commit: '"), F.col("_commit"), F.lit("'\n  license: "),
        F.col("c_mktsegment"), F.lit("\n  extra_field: ignored\n  repo_features:\n    number_of_lines_of_code: "),
        (ck * 7).cast("string"), F.lit("\n    number_of_modules: "), (ck % 4 + 1).cast("string"),
        F.lit("\n  test_count:\n    tests_run: "), (ck % 50).cast("string"), F.lit("\n    tests_skipped: "),
        (ck % 3).cast("string"), F.lit("\n"),
        # 1,700,000,000 + 3,601 ck seconds after 1970, written two hours ahead of UTC; as text and as a YAML time.
        F.when(ck % 7 != 0, F.concat(F.lit("  commit_date: "), F.when(ck % 2 == 0, F.lit("'")).otherwise(F.lit("")),
                                     F.date_format(F.expr("timestampadd(SECOND, c_custkey * 3601, TIMESTAMP_NTZ'2023-11-15 00:13:20')"), "yyyy-MM-dd'T'HH:mm:ss"),
                                     F.lit("+02:00"), F.when(ck % 2 == 0, F.lit("'")).otherwise(F.lit("")), F.lit("\n"))).otherwise(F.lit("")))
    if broken is not None:
        item = F.when(broken, F.concat(F.lit("- repo_name: [own, "), ck.cast("string"), F.lit("\n  commit: x\n"))).otherwise(item)
    tiers = F.array(
        F.lit("full"), F.when(ck % 5 == 0, F.lit("medium")), F.when(ck % 15 == 0, F.lit("mini")),
        F.when(ck % 500 == 7, F.lit("tiny")))
    rows = c.select("*", commit.alias("_commit"), F.explode(tiers).alias("tier")).filter(F.col("tier").isNotNull())
    rows = rows.withColumn("_commit", F.when(F.col("tier") == "tiny", F.lit("tinyhead")).otherwise(F.col("_commit")))
    return rows.select(item.alias("value"), "tier", (ck / 1000).cast("int").alias("part"), ck.alias("ck"))


def _manifests_written(spark, sf_dir, broken=None) -> str:
    out = _scratch(spark, "manifest")
    # One manifest per tier and thousand of customers, in the order of the keys.
    (_manifest_yaml(spark, sf_dir, broken).repartition("tier", "part").sortWithinPartitions("tier", "part", "ck").drop("ck")
     .write.mode("overwrite").partitionBy("tier", "part").text(out))
    return out


def _manifest_roundtrip(spark, sf_dir):
    return S.with_tier(S.read_manifests(spark, _manifests_written(spark, sf_dir), glob="*.txt"))


_MANIFEST_SQL = """
WITH c AS (SELECT c_custkey AS ck, 'own' || CAST(c_nationkey AS VARCHAR) || '/c' || CAST(c_custkey AS VARCHAR) AS repo_name,
                  substr(md5(c_name), 1, 12) AS commit, c_mktsegment AS license FROM customer),
t AS (SELECT 'full' AS tier, * FROM c
      UNION ALL SELECT 'medium', * FROM c WHERE ck % 5 = 0
      UNION ALL SELECT 'mini', * FROM c WHERE ck % 15 = 0
      UNION ALL SELECT 'tiny', ck, repo_name, 'tinyhead', license FROM c WHERE ck % 500 = 7)"""


@register("manifest_scan", oracle=_MANIFEST_SQL + """
SELECT tier, repo_name, commit, license, CAST(ck * 7 AS BIGINT) AS lines_of_code,
       CAST(ck % 4 + 1 AS BIGINT) AS modules, CAST(ck % 50 AS BIGINT) AS tests_run,
       CAST(ck % 3 AS BIGINT) AS tests_skipped, CAST(NULL AS BIGINT) AS tests_failed,
       row_number() OVER (PARTITION BY tier, ck // 1000 ORDER BY ck) - 1 AS ordinal,
       CASE WHEN ck % 7 <> 0 THEN 1700000000 + ck * 3601 END AS commit_epoch FROM t""")
def q_manifest_scan(spark, sf_dir):
    """YAML manifests (written by Spark per tier) read back into typed rows; extra fields dropped."""
    m = _manifest_roundtrip(spark, sf_dir)
    return m.select("tier", "repo_name", "commit", "license",
                    F.col("repo_features.number_of_lines_of_code").alias("lines_of_code"),
                    F.col("repo_features.number_of_modules").alias("modules"),
                    F.col("test_count.tests_run").alias("tests_run"),
                    F.col("test_count.tests_skipped").alias("tests_skipped"),
                    F.col("test_count.tests_failed").alias("tests_failed"), "ordinal", F.unix_timestamp("commit_date").alias("commit_epoch"))


@register("manifest_items", oracle=_MANIFEST_SQL + """,
r AS (SELECT *, row_number() OVER (PARTITION BY tier, ck // 1000 ORDER BY ck) - 1 AS ordinal, ck % 41 = 0 AS broken FROM t)
SELECT tier, ck // 1000 AS part, ordinal, broken, CASE WHEN NOT broken THEN repo_name END AS repo_name, CASE WHEN NOT broken THEN commit END AS commit,
       CAST(CASE WHEN NOT broken THEN ck * 7 END AS BIGINT) AS lines_of_code, CAST(CASE WHEN NOT broken THEN ck % 50 END AS BIGINT) AS tests_run,
       CASE WHEN NOT broken AND ck % 7 <> 0 THEN 1700000000 + ck * 3601 END AS commit_epoch FROM r""")
def q_manifest_items(spark, sf_dir):
    """S1 item by item: manifests read in splits of 64 KB whose cuts fall inside items; an item that is no YAML is one row."""
    out = _manifests_written(spark, sf_dir, broken=F.col("c_custkey") % 41 == 0)
    m = S.with_tier(S.read_manifest_items(spark, out, glob="*.txt", split_bytes=64 << 10))
    return m.select("tier", F.regexp_extract("source_file", "/part=([0-9]+)/", 1).cast("bigint").alias("part"), "ordinal",
                    F.col("problem").isNotNull().alias("broken"), "repo_name", "commit",
                    F.col("repo_features.number_of_lines_of_code").alias("lines_of_code"), F.col("test_count.tests_run").alias("tests_run"),
                    F.unix_timestamp("commit_date").alias("commit_epoch"))


@register("tier_report", oracle=_MANIFEST_SQL + """
SELECT tier, CAST(COUNT(*) AS BIGINT) AS n_rows,
       CAST(COUNT(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM t f WHERE f.tier = 'full'
                                               AND f.repo_name = t.repo_name AND f.commit = t.commit)) AS BIGINT)
         AS not_in_base
FROM t GROUP BY tier""")
def q_tier_report(spark, sf_dir):
    """Tier sizes and rows not contained in the full tier (anti join)."""
    return S.tier_subset_report(_manifest_roundtrip(spark, sf_dir))


@register("run_records", oracle="""
SELECT o_orderkey AS run_id, 'exp' || CAST(o_orderkey % 3 AS VARCHAR) AS experiment,
       o_orderkey % 11 <> 0 AS run_success,
       CASE WHEN o_orderkey % 11 <> 0 THEN NOT (o_orderkey % 7 IN (0, 1, 2)) END AS build_success,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'run ' || CAST(o_orderkey AS VARCHAR) END AS stdout,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'diff r_' || CAST(o_orderkey AS VARCHAR) || chr(10) END AS diff,
       CASE WHEN o_orderkey % 11 <> 0 THEN 'log ' || CAST(o_orderkey AS VARCHAR) END AS build_log,
       FALSE AS summary_has_log
FROM orders""")
def q_run_records(spark, sf_dir):
    """K1 + S5: run records written as Parquet (ANSI removed, patch newline, build log split off) and read back."""
    v = verdicts(spark, sf_dir)
    k = F.col("run_id").cast("string")
    mr = F.when(F.col("has_result"), F.struct(
        F.struct("build_success", "test_success").alias("build_result"), F.lit("").alias("output"),
        F.concat(F.lit("\u001b[32mrun "), k, F.lit("\u001b[0m")).alias("stdout"),
        F.concat(F.lit("diff r_"), k).alias("diff"), F.concat(F.lit("log "), k).alias("build_log")))
    runs = v.select("run_id", F.concat(F.lit("exp"), (F.col("run_id") % 3).cast("string")).alias("experiment"),
                    F.col("has_result").alias("run_success"), mr.alias("migration_result"))
    out = _scratch(spark, "runs")
    S.write_run_records(runs, out)
    back = S.read_stored_results(spark, out)
    fields = back.schema["migration_result"].dataType.fieldNames()
    return back.select("run_id", "experiment", "run_success",
                       F.col("migration_result.build_result.build_success").alias("build_success"),
                       F.col("migration_result.stdout").alias("stdout"), F.col("migration_result.diff").alias("diff"),
                       "build_log", F.lit("build_log" in fields).alias("summary_has_log"))


@register("run_records_two", oracle="""
SELECT o_orderkey AS run_id, 'exp' || CAST(o_orderkey % 3 AS VARCHAR) AS experiment,
       CASE WHEN o_orderkey % 3 = 1 THEN 'second' ELSE 'first' END AS written
FROM orders WHERE o_orderkey % 3 <> 1 OR o_orderkey % 2 = 0""")
def q_run_records_two(spark, sf_dir):
    """K1 twice: a second write of one experiment replaces it and keeps the others.  Writes at the time of the call."""
    k = F.col("run_id")
    all_runs = B.b1_runs(spark, sf_dir).select("run_id", F.concat(F.lit("exp"), (k % 3).cast("string")).alias("experiment"))
    out = _scratch(spark, "runs-two")

    def records(df, written):
        return df.withColumn("migration_result", F.struct(F.lit(written).alias("output"), F.lit("").alias("stdout"),
                                                          F.lit("").alias("diff"), F.lit("").alias("build_log")))

    S.write_run_records(records(all_runs, "first"), out)
    S.write_run_records(records(all_runs.where((k % 3 == 1) & (k % 2 == 0)), "second"), out)
    return S.read_stored_results(spark, out).select("run_id", "experiment", F.col("migration_result.output").alias("written"))


@register("run_artifacts", oracle="""
SELECT o_orderkey AS run_id, 'exp' || CAST(o_orderkey % 2 AS VARCHAR) AS experiment,
       'own' || CAST(o_custkey % 97 AS VARCHAR) || '/r_' || CAST(o_orderkey AS VARCHAR) AS repo,
       o_orderkey % 13 <> 0 AS has_result_file, o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 AS empty_result,
       CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 11 = 0 THEN NULL WHEN o_orderkey % 7 = 0 THEN 'result.yaml'
            WHEN o_orderkey % 5 = 0 THEN 'stdout.log' END AS broken,
       CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN o_orderkey % 2 = 0 END AS run_success,
       CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 AND o_orderkey % 5 <> 0
            THEN CAST(o_custkey AS BIGINT) END AS tests_run,
       CASE WHEN o_orderkey % 13 <> 0 AND o_orderkey % 11 <> 0 AND o_orderkey % 7 <> 0 THEN CAST(o_custkey AS BIGINT) END AS own_tests_run,
       CASE WHEN o_orderkey % 5 <> 0 THEN 'out' END AS stdout, CASE WHEN o_orderkey % 3 <> 0 THEN 'diff' END AS diff
FROM orders""")
def q_run_artifacts(spark, sf_dir):
    """S2/S3 over artefact rows: complete, without patch, empty, without result file, malformed YAML, a log that is not UTF-8."""
    o = B.table(spark, sf_dir, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    good = F.concat(F.lit("run_success: "), F.when(k % 2 == 0, "true").otherwise("false"),
                    F.lit("\nerror: null\nbuild_result:\n  build_success: true\n  build_time: 1.5\n  test_results:\n    tests_run: "),
                    c.cast("string"), F.lit("\n"))
    yaml = (F.when(k % 13 == 0, F.lit(None)).when(k % 11 == 0, F.lit("")).when(k % 7 == 0, F.concat(F.lit("a: [1, "), c.cast("string")))
            .otherwise(good))
    wide = o.select(
        F.concat(F.lit("exp"), (k % 2).cast("string")).alias("experiment"),
        F.concat(F.lit("own"), (c % 97).cast("string"), F.lit("_r_"), k.cast("string")).alias("repo_dir"),
        F.encode(yaml, "UTF-8").alias("result_yaml"), F.encode(F.lit("log"), "UTF-8").alias("build_log"),
        F.when(k % 5 == 0, F.unhex(F.lit("FF41"))).otherwise(F.encode(F.lit("out"), "UTF-8")).alias("stdout_log"),
        F.when(k % 3 != 0, F.encode(F.lit("diff"), "UTF-8")).alias("diff_patch"))
    got = S.run_artifacts(wide)
    return got.select(F.regexp_extract("repo", "_([0-9]+)$", 1).cast("bigint").alias("run_id"), "experiment", "repo", "has_result_file",
                      "empty_result", F.when(~F.col("empty_result"), F.split("problem", ":")[0]).alias("broken"), "run_success",
                      F.col("migration_result.build_result.test_results.tests_run").alias("tests_run"),
                      F.col("build_result.test_results.tests_run").alias("own_tests_run"), "stdout", "diff")


@register("artifact_folders", oracle="""
SELECT c_custkey AS run_id, 'exp' || CAST(c_custkey % 2 AS VARCHAR) AS experiment,
       '_own' || CAST(c_nationkey AS VARCHAR) || '/r_' || CAST(c_custkey AS VARCHAR) AS repo,
       c_custkey % 13 <> 0 AS has_result_file, c_custkey % 13 <> 0 AND c_custkey % 11 = 0 AS empty_file,
       CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 11 <> 0 THEN CAST(c_custkey AS BIGINT) END AS tests_run,
       CASE WHEN c_custkey % 13 <> 0 THEN CASE WHEN c_custkey % 5 = 0 THEN '' ELSE c_name END END AS stdout,
       CASE WHEN c_custkey % 13 <> 0 AND c_custkey % 3 <> 0 THEN 'diff ' || c_name END AS diff
FROM customer""")
def q_artifact_folders(spark, sf_dir):
    """S2/S3 from folders: two experiments with one folder per customer are written, listed in tasks and read; files are
    missing or empty here and there, some folders hold none of the four.  Writes its files at the time of the call."""
    c = B.table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    yaml = F.when(k % 11 == 0, F.lit("")).otherwise(F.concat(
        F.lit("run_success: true\nbuild_result:\n  build_success: true\n  test_results:\n    tests_run: "), k.cast("string"), F.lit("\n")))
    stdout = F.when(k % 5 == 0, F.lit("")).otherwise(F.col("c_name"))
    none = F.lit(None).cast("string")
    named = {"result.yaml": yaml, "build.log": F.lit("log"), "stdout.log": stdout,
             "diff.patch": F.when(k % 3 != 0, F.concat(F.lit("diff "), F.col("c_name")))}
    parts = F.array(F.struct(F.lit("note.txt").alias("name"), F.when(k % 13 == 0, F.lit("x")).otherwise(none).alias("content")),
                    *[F.struct(F.lit(n).alias("name"), F.when(k % 13 != 0, v).otherwise(none).alias("content")) for n, v in named.items()])
    folder = F.concat(F.lit("exp"), (k % 2).cast("string"), F.lit("/job_results/_own"), F.col("c_nationkey").cast("string"), F.lit("_r_"), k.cast("string"))
    files = c.select(folder.alias("folder"), F.inline(parts)).where("content is not null")
    root = B.files_written(files.select(F.concat_ws("/", "folder", "name").alias("rel"), "content"), "artifacts")
    got = S.scan_run_artifacts(spark, [f"{root}/exp{i}/job_results" for i in (0, 1)])
    # The folder's name begins with "_": the first one is the slash of the recovered key.
    repo = F.regexp_replace("repo_dir", "^(_[^_]*)_", "$1/")
    return got.select(F.regexp_extract("repo_dir", "_([0-9]+)$", 1).cast("bigint").alias("run_id"),
                      F.regexp_extract("experiment", "[^/]*$", 0).alias("experiment"), repo.alias("repo"), "has_result_file",
                      (F.col("has_result_file") & F.col("empty_result")).alias("empty_file"),
                      F.col("build_result.test_results.tests_run").alias("tests_run"), "stdout", "diff")


@register("pre_coverage_csv", oracle="""
SELECT 'own' || CAST(o_custkey % 97 AS VARCHAR) || '/r_' || CAST(o_orderkey AS VARCHAR) AS repo,
       CASE WHEN o_orderkey % 6 = 0 THEN 0.0 WHEN o_orderkey % 6 = 2 THEN 'NaN'::DOUBLE
            ELSE CAST(40 + o_orderkey % 50 AS DOUBLE) END AS percent_before
FROM orders WHERE o_orderkey % 6 <> 1""")
def q_pre_coverage_csv(spark, sf_dir):
    """Pre-coverage CSV read by column name: other columns around it, blank and NA cells, repeated keys (the last row counts)."""
    o = B.table(spark, sf_dir, "orders")
    ok = F.col("o_orderkey")
    repo_dir = F.concat(F.lit("own"), (F.col("o_custkey") % 97).cast("string"), F.lit("_r_"), ok.cast("string"))
    pct = (F.when(ok % 6 == 0, F.lit("0.0")).when(ok % 12 == 2, F.lit("")).when(ok % 6 == 2, F.lit("NA"))
           .otherwise((F.lit(40) + ok % 50).cast("double").cast("string")))
    rows = o.filter(ok % 6 != 1).select(
        ok.alias("idx"), pct.alias("percent_before"), F.lit("n/a").alias("note"), repo_dir.alias("repo"))
    # Two rows of a key stand one after the other in one part file, the wrong one first.
    row = F.struct("idx", "percent_before", "note", "repo")
    wrong = F.struct("idx", F.lit("77.0").alias("percent_before"), "note", "repo")
    both = rows.select(F.inline(F.when(F.col("idx") % 4 == 0, F.array(wrong, row)).otherwise(F.array(row))))
    out = _scratch(spark, "precov")
    both.write.mode("overwrite").option("header", True).option("emptyValue", "").csv(out)
    return S.read_pre_coverage(spark, out)


_EVENT_SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


@register("progress", oracle="""
SELECT event_type AS status, CAST(COUNT(*) AS BIGINT) AS finished FROM events GROUP BY event_type""")
def q_progress(spark, sf_dir):
    """ST1: finished-job counts per status from a file stream (availableNow, checkpointed state)."""
    return progress_counts(spark, sf_dir, _EVENT_SCHEMA, "event_type", glob="events.parquet")


def _portions(spark, sf_dir) -> DataFrame:
    """The last event of every user, from a stream over files that arrive in three portions, with a stop after each."""
    ev = B.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", F.col("event_type").alias("status"))
    source, checkpoint = _scratch(spark, "portions"), _scratch(spark, "portions-state")
    latest = None
    for i in range(3):
        # The events arrive out of order, and the last portion holds a part of the first one again.
        part = ev.where((F.col("event_id") % 3 == i) | (F.lit(i == 2) & (F.col("event_id") % 6 == 0)))
        part.write.mode("append").parquet(source)
        latest = progress_latest(spark, source, ev.schema, "user_id", ["ts", "event_id"], checkpoint=checkpoint)
    return latest


@register("progress_latest", oracle="""
SELECT user_id, max(event_id) AS event_id, max(event_type) AS status
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY user_id""")
def q_progress_latest(spark, sf_dir):
    """ST1 + J4: one row per run with its last result.  Writes files and runs the stream at the time of the call."""
    return _portions(spark, sf_dir).select("user_id", "event_id", "status")


@register("progress_latest_counts", oracle="""
SELECT event_type AS status, count(*) AS finished
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1 GROUP BY event_type""")
def q_progress_latest_counts(spark, sf_dir):
    """ST1 + J4: finished runs by their last status, each once.  Writes files and runs the stream at the time of the call."""
    return latest_counts(_portions(spark, sf_dir), "status")


def _ratio(rec: dict) -> dict:
    k = json.loads(rec["props"])["k"]
    if k % 11 == 3:
        return {"ratio": "no number"}                   # a result of the wrong type is a failure of its row
    return {"ratio": rec["value"] / (k % 7), "big": rec["big"]}


_K = "CAST(json_extract(props, '$.k') AS BIGINT)"


@register("guarded_map", oracle=f"""
WITH e AS (SELECT event_id, value, {_K} AS k,
                  CASE WHEN event_id % 3 <> 0 THEN 9007199254740993 + event_id END AS big FROM events)
SELECT event_id, big AS kept, CASE WHEN k % 11 <> 3 AND k % 7 <> 0 THEN value / (k % 7) END AS ratio,
       CASE WHEN k % 11 <> 3 AND k % 7 <> 0 THEN big END AS big,
       CASE WHEN k % 11 <> 3 AND k % 7 <> 0 THEN 'SUCCESS' ELSE 'FAIL' END AS status,
       CASE WHEN k % 11 = 3 THEN 'wrong type' WHEN k % 7 = 0 THEN 'float division by zero' END AS error
FROM e""")
def q_guarded_map(spark, sf_dir):
    """A Python function per row; exceptions and results of the wrong type become FAIL rows; integers beyond 2^53 beside NULLs stay exact."""
    big = F.when(F.col("event_id") % 3 != 0, F.lit(9007199254740993) + F.col("event_id"))
    ev = B.table(spark, sf_dir, "events").select("event_id", "value", "props", big.alias("big"), big.alias("kept"))
    got = U.guarded_map(ev, _ratio, StructType([StructField("ratio", DoubleType()), StructField("big", LongType())]), keep=["event_id", "kept"])
    return got.withColumn("error", F.when(F.col("error").contains("no number") | F.col("error").contains("convert"), "wrong type").otherwise(F.col("error")))


@register("guarded_map_retry", oracle="""
SELECT event_id, CAST(CASE WHEN event_id % 5 < 3 THEN event_id % 5 + 1 END AS BIGINT) AS tries,
       CASE WHEN event_id % 5 < 3 THEN 'SUCCESS' ELSE 'FAIL' END AS status, CASE WHEN event_id % 5 >= 3 THEN 'try 3' END AS error
FROM events""")
def q_guarded_map_retry(spark, sf_dir):
    """Up to three tries per row."""
    ev = B.table(spark, sf_dir, "events").select("event_id")
    return U.guarded_map(ev, _retried(), StructType([StructField("tries", LongType())]), keep=["event_id"], attempts=3)


def _retried():
    """A function with its own count of tries, fresh for every call of the query."""
    tries: dict[int, int] = {}

    def fn(rec: dict) -> dict:
        n = tries[rec["event_id"]] = tries.get(rec["event_id"], 0) % 3 + 1
        if n <= rec["event_id"] % 5:
            raise RuntimeError(f"try {n}")
        tries.pop(rec["event_id"])
        return {"tries": n}
    return fn


@register("funnel_written", oracle=oracle_of("funnel"))
def q_funnel_written(spark, sf_dir):
    """K2: the funnel stored as JSON and read back.  Writes at the time of the call."""
    out = _scratch(spark, "funnel")
    S.write_funnel(runs.funnel(verdicts(spark, sf_dir)), out)
    return spark.read.schema("stage string, started bigint, succeeded bigint").json(out)


@register("nested_written", oracle="""
SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 11 <> 0 THEN NOT (o_orderkey % 7 IN (0, 1, 2)) END AS build_success FROM orders""")
def q_nested_written(spark, sf_dir):
    """K4: nested job results stored as JSON records and read back.  Writes at the time of the call."""
    v = verdicts(spark, sf_dir)
    out = _scratch(spark, "nested")
    nested = F.when(F.col("has_result"), F.struct(F.struct("build_success", "test_success").alias("build_result")))
    S.write_nested_results(v.select("run_id", nested.alias("migration_result")), out)
    schema = "run_id bigint, migration_result struct<build_result: struct<build_success: boolean, test_success: boolean>>"
    return spark.read.schema(schema).json(out).select("run_id", F.col("migration_result.build_result.build_success").alias("build_success"))
