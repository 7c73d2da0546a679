"""File sources (S1-S7) and sinks (K1-K5) for run artefacts.

Folder scans (``runlens.sources.tree``) give one row per file or per line; no file
is left out for its name or because it is empty.  Small semi-structured files (YAML
manifests, ``result.yaml``) are parsed in Arrow batches; everything after the scan is
DataFrame work over (path, content) rows.  Outputs are Parquet/JSON written by Spark
executors; nothing goes through the driver.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (BooleanType, DoubleType, LongType, StringType, StructField, StructType,
                               TimestampType)

from runlens.functions import text as T
from runlens.operators.runs import summary_projection
from runlens.session import materialize, ship_package
from runlens.sources.tree import child_folders, list_tree, open_root, read_tree, read_tree_lines

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Run artefact file names inside one repository's result directory.
ARTIFACTS = ["result.yaml", "build.log", "stdout.log", "diff.patch"]
# Experiment directory layout: <prefix>/<YYYY-MM-DD>/<HH-MM-SS>-<name>
EXPERIMENT_PATH_RE = "(\\d{4}-\\d{2}-\\d{2})/(\\d{2}-\\d{2}-\\d{2})-([^/]+)/?$"
# ---------------------------------------------------------------------------

_FEATURES = StructType([StructField(n, LongType()) for n in (
    "number_of_external_dependencies", "number_of_java_files", "number_of_lines_of_code",
    "number_of_modules", "number_of_unit_tests")])
_TEST_COUNT = StructType([StructField(n, LongType()) for n in (
    "tests_failed", "tests_run", "tests_skipped", "tests_successful")])
MANIFEST_SCHEMA = StructType([
    StructField("source_file", StringType()), StructField("ordinal", LongType()),
    StructField("repo_name", StringType()), StructField("commit", StringType()),
    StructField("license", StringType()), StructField("repo_features", _FEATURES),
    StructField("test_count", _TEST_COUNT), StructField("commit_date", TimestampType()),
])


def _yaml_loader():
    import yaml
    # libyaml's safe loader when present (same safe subset, C speed).
    return getattr(yaml, "CSafeLoader", yaml.SafeLoader)


def _as_long(v):
    try:
        return None if v is None else int(v)
    except (TypeError, ValueError):
        return None


#: Times as manifests usually have them; the parser for all others takes longer than the item's YAML.
_ISO_TIME = re.compile(r"(1[7-9]|20|21)[0-9]{2}-[0-9]{2}-[0-9]{2}[T ]([01][0-9]|2[0-3]):[0-5][0-9]:[0-5][0-9]([+-](0[0-9]|1[0-4]):[0-5][0-9])?")


def _as_time(v):
    """A time in UTC: ``pd.to_datetime`` of a value, where the usual forms need no guess of their format."""
    try:
        if type(v) is str and _ISO_TIME.fullmatch(v):
            v = datetime.fromisoformat(v)
        if type(v) is datetime and 1700 <= v.year < 2200:
            return pd.Timestamp(v.replace(tzinfo=timezone.utc) if v.tzinfo is None else v.astimezone(timezone.utc))
    except ValueError:
        pass                                # no such day: the message is that of the general parser
    return pd.to_datetime(v, utc=True)


def _item_fields(it: dict) -> dict:
    """The typed fields of one manifest item."""
    feats, tc, cd = it.get("repo_features") or None, it.get("test_count") or None, it.get("commit_date")
    return {"repo_name": it.get("repo_name"), "commit": None if it.get("commit") is None else str(it.get("commit")),
            "license": it.get("license"),
            "repo_features": None if feats is None else {k: _as_long(feats.get(k)) for k in _FEATURES.names},
            "test_count": None if tc is None else {k: _as_long(tc.get(k)) for k in _TEST_COUNT.names},
            "commit_date": None if cd is None else _as_time(cd)}


def _manifest_rows(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml
    cols = [f.name for f in MANIFEST_SCHEMA.fields]
    for pdf in pdfs:
        rows = []
        for path, content in zip(pdf["path"], pdf["content"]):
            items = yaml.load(bytes(content).decode("utf-8"), Loader=_yaml_loader()) or []
            for i, it in enumerate(items):
                rows.append({"source_file": path, "ordinal": i, **_item_fields(it)})
        out = pd.DataFrame(rows, columns=cols)
        # With its zone: Spark takes a time without one for a time of the session's zone.
        yield out.assign(commit_date=pd.to_datetime(out["commit_date"], utc=True))


def read_manifests(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """YAML manifest files (lists of items) -> typed rows with ``ordinal`` (position in its file).

    Each file is one ``binaryFile`` row; ``mapInPandas`` parses a batch of
    files per Arrow batch.  Undeclared fields are dropped by the fixed schema.
    """
    files = read_tree(list_tree(spark, path, f"**/{glob}"), path)
    return files.select("path", "content").mapInPandas(_manifest_rows, MANIFEST_SCHEMA)


def with_tier(manifest: DataFrame) -> DataFrame:
    """Tier name from the manifest file (``<tier>_dataset.yaml``) or its ``tier=<name>`` folder."""
    by_name = F.regexp_extract("source_file", "([a-z]+)_dataset\\.yaml$", 1)
    by_dir = F.regexp_extract("source_file", "/tier=([^/]+)/", 1)
    return manifest.withColumn("tier", F.when(by_name != "", by_name).otherwise(by_dir))


def tier_subset_report(manifest_tiers: DataFrame, base_tier: str = "full",
                       key: tuple[str, ...] = ("repo_name", "commit")) -> DataFrame:
    """Per tier, rows and rows whose key is not in the base tier.

    One scan, no join: rows are first counted per (key, tier), so a key has at
    most one row per tier; per key the tiers (a handful) tell whether the base
    tier holds it; then the counts are summed per tier.  Both aggregates
    combine partially before their shuffle, so a repeated key stays cheap.
    """
    per = manifest_tiers.groupBy(*key, "tier").agg(F.count(F.lit(1)).alias("n"))
    per_key = per.groupBy(*key).agg(F.collect_list(F.struct("tier", "n")).alias("t"))
    flagged = per_key.select(F.exists("t", lambda x: x["tier"] == base_tier).alias("in_base"),
                             F.explode("t").alias("x"))
    return flagged.groupBy(F.col("x.tier").alias("tier")).agg(
        F.sum("x.n").alias("n_rows"),
        F.sum(F.when(~F.col("in_base"), F.col("x.n")).otherwise(F.lit(0))).alias("not_in_base"))


_BUILD = StructType([
    StructField("build_success", BooleanType()), StructField("test_success", BooleanType()),
    StructField("test_results", StructType([StructField(n, LongType()) for n in
                                            ("tests_run", "failures", "errors", "skipped")])),
    StructField("build_time", DoubleType())])
RESULT_SCHEMA = StructType([StructField("run_success", BooleanType()), StructField("error", StringType()),
                            StructField("build_result", _BUILD), StructField("empty", BooleanType()),
                            StructField("problem", StringType())])
_COUNTERS = ("tests_run", "failures", "errors", "skipped")


def _flag(v):
    if v is not None and not isinstance(v, bool):
        raise ValueError(f"not a boolean: {v!r}")
    return v


def _parse_result(text) -> dict:
    import yaml
    out = {"run_success": None, "error": None, "build_result": None, "empty": True, "problem": None}
    try:
        d = None if text is None else yaml.load(bytes(text).decode("utf-8"), Loader=_yaml_loader())
        if d is None:
            return out
        if not isinstance(d, dict):
            raise ValueError("not a mapping")
        br = d.get("build_result")
        if isinstance(br, dict):
            tr = br.get("test_results")
            br = {"build_success": _flag(br.get("build_success")), "test_success": _flag(br.get("test_success")),
                  "test_results": None if not isinstance(tr, dict) else {k: _as_long(tr.get(k)) for k in _COUNTERS},
                  "build_time": None if br.get("build_time") is None else float(br.get("build_time"))}
        else:
            br = None
        error = d.get("error")
        return {"run_success": _flag(d.get("run_success")), "error": None if error is None else str(error),
                "build_result": br, "empty": False, "problem": None}
    except (yaml.YAMLError, ValueError, TypeError, OverflowError) as e:     # this document only, not the scan
        return {**out, "empty": False, "problem": f"result.yaml: {str(e).splitlines()[0]}"}


def _parse_results(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_parse_result(t) for t in texts], columns=RESULT_SCHEMA.names)


ARTIFACT_COLUMNS = ("result_yaml", "build_log", "stdout_log", "diff_patch")
# Folders, and bytes of their files, that a task hands on at a time.
ARTIFACT_BATCH_ROWS = 1000
ARTIFACT_BATCH_BYTES = 8 << 20


def _artifact_batch(rows: list[tuple]):
    import pyarrow as pa
    types = (pa.string(), pa.string(), *[pa.binary()] * len(ARTIFACT_COLUMNS))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=t) for i, t in enumerate(types)],
                                      names=["experiment", "repo_dir", *ARTIFACT_COLUMNS])


def _read_artifacts(batches, roots: list[str]):
    """Record batches of folders (root, repo_dir) with the bytes of their files, many folders to a batch."""
    opened = {root: open_root(root) for root in roots}
    rows, held = [], 0
    for batch in batches:
        for root, repo in zip(batch.column("root").to_pylist(), batch.column("repo_dir").to_pylist()):
            system, base = opened[root]
            found = []
            for name in ARTIFACTS:
                try:
                    with system.open_input_stream(f"{base}/{repo}/{name}") as f:
                        found.append(f.readall())
                except FileNotFoundError:
                    found.append(None)
            rows.append((root.rpartition("/")[0], repo, *found))
            held += sum(len(x) for x in found if x is not None)
            if held >= ARTIFACT_BATCH_BYTES or len(rows) >= ARTIFACT_BATCH_ROWS:
                yield _artifact_batch(rows)
                rows, held = [], 0
    yield _artifact_batch(rows)


def scan_run_artifacts(spark: SparkSession, job_results_dir: str | list[str], compat: bool = False) -> DataFrame:
    """One row per repository folder of one or several ``job_results`` folders; see ``run_artifacts``.

    Tasks list the folders, which are then dealt out; a task reads the (at most four) named files of a folder,
    so the bytes reach their row without a shuffle.  A root that does not exist is an error.
    """
    ship_package(spark)
    roots = [r.rstrip("/") for r in ([job_results_dir] if isinstance(job_results_dir, str) else job_results_dir)]
    todo = child_folders(spark, roots).withColumnRenamed("name", "repo_dir")

    def run(batches):
        return _read_artifacts(batches, roots)

    wide = todo.mapInArrow(
        run, "experiment string, repo_dir string, " + ", ".join(f"{c} binary" for c in ARTIFACT_COLUMNS))
    return run_artifacts(wide, compat)


def run_artifacts(wide: DataFrame, compat: bool = False) -> DataFrame:
    """S2/S3 over rows (experiment, repo_dir, result_yaml, build_log, stdout_log, diff_patch: binary).

    Key from the folder name (F3).  ``result.yaml`` is parsed in Arrow batches; one that cannot be read,
    or a log that is not UTF-8, fails its own row: ``problem`` says why and ``migration_result`` is NULL.
    ``test_results`` are read from inside ``build_result``, where the writer puts them.  Every artefact counts
    by itself: ``build_result``, ``build_log``, ``stdout`` and ``diff`` are there when their own file is there and
    can be read, and ``migration_result`` needs a build result only.  ``compat=True`` reproduces the reference's
    reload, which wants all four files and looks for counters at the top level, so that they are always NULL.
    """
    from runlens.operators._plan import evaluate_once
    ship_package(wide.sparkSession)
    # Made here, not at import, so that workers can import this module without a session.
    parse = F.pandas_udf(_parse_results, RESULT_SCHEMA)
    texts = {c: F.col(c).cast("string") for c in ARTIFACT_COLUMNS[1:]}
    res = evaluate_once(wide.withColumn("_r", parse("result_yaml")))
    bad = F.coalesce(*[F.when(~F.is_valid_utf8(t), F.lit(f"{n}: not UTF-8")) for n, t in
                       zip(ARTIFACTS[1:], texts.values())])
    problem = F.coalesce(F.col("_r.problem"), bad)
    complete = F.col("result_yaml").isNotNull()
    for c in ARTIFACT_COLUMNS[1:] if compat else ():
        complete = complete & F.col(c).isNotNull()
    build = F.struct(F.col("_r.build_result.build_success").alias("build_success"), F.col("_r.build_result.test_success").alias("test_success"),
                     F.col("_r.build_result.test_results").alias("test_results"), F.col("_r.build_result.build_time").alias("build_time"))
    parts = {"build_result": F.when(F.col("_r.problem").isNull() & F.col("_r.build_result").isNotNull(), build),
             **{n: F.when(F.is_valid_utf8(texts[c]), texts[c]) for n, c in zip(("build_log", "stdout", "diff"), ARTIFACT_COLUMNS[1:])}}
    tr = F.lit(None).cast(_BUILD["test_results"].dataType) if compat else F.col("_r.build_result.test_results")
    mr = F.when(complete & problem.isNull() & F.col("_r.build_result").isNotNull(), F.struct(
        F.struct(F.col("_r.build_result.build_success").alias("build_success"),
                 F.col("_r.build_result.test_success").alias("test_success"),
                 tr.alias("test_results"),
                 F.col("_r.build_result.build_time").alias("build_time")).alias("build_result"),
        F.lit("").alias("output"), texts["stdout_log"].alias("stdout"), texts["diff_patch"].alias("diff"),
        texts["build_log"].alias("build_log")))
    return res.select(
        "experiment", "repo_dir", T.recover_key("repo_dir").alias("repo"),
        F.col("result_yaml").isNotNull().alias("has_result_file"), F.col("_r.empty").alias("empty_result"),
        problem.alias("problem"), F.col("_r.run_success").alias("run_success"), F.col("_r.error").alias("error"),
        mr.alias("migration_result"), *[c.alias(n) for n, c in parts.items()])


# Texts that the reference's CSV reader takes for a missing number.
CSV_MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL",
               "NaN", "None", "n/a", "nan", "null")


def read_pre_coverage(spark: SparkSession, path: str) -> DataFrame:
    """Pre-migration coverage CSV: one row per repository, by the file's own header.

    Columns ``repo`` (directory-style keys, recovered with F3) and ``percent_before`` may stand in any
    order among others; a missing one is an error.  Missing numbers are NaN, other text that is no number
    is an error.  A repeated repository has its last row in file order.
    """
    raw = spark.read.option("header", True).csv(path)
    if absent := {"repo", "percent_before"} - set(raw.columns):
        raise ValueError(f"{path} has no column {', '.join(sorted(absent))}")
    text = F.trim("percent_before")
    pct = F.when(text.isNull() | text.isin(*CSV_MISSING), F.lit(float("nan"))).otherwise(text.cast("double"))
    place = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
    rows = raw.select(T.recover_key("repo").alias("repo"), pct.alias("percent_before"), place.alias("_place"))
    return rows.groupBy("repo").agg(F.max_by("percent_before", "_place").alias("percent_before"))


def read_stored_results(spark: SparkSession, path: str) -> DataFrame:
    """Stored guard/run results written by ``write_*`` (Parquet)."""
    return spark.read.parquet(path)


def scan_coverage_reports(spark: SparkSession, root: str) -> DataFrame:
    """Every ``jacoco.xml`` under ``**/target/site/jacoco*/`` as (path, xml: binary)."""
    files = list_tree(spark, root, "**/target/site/jacoco*/jacoco.xml")
    return read_tree(files, root).select("path", F.col("content").alias("xml"))


def list_source_tree(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """S7 without contents: files under ``root/<repo>/...`` as (repo, rel_path, rel, size).

    With ``extensions`` (e.g. the corpus defaults) the corpus rule (P2: no hidden parts, allowed
    extension) is applied to the listing, so other files are never opened.
    """
    from runlens.operators.corpus import code_file_filter
    rel_path = F.regexp_extract("rel", "^[^/]+/(.*)$", 1)
    files = list_tree(spark, root).where(F.col("rel").contains("/"))
    if extensions is not None:
        files = files.where(code_file_filter(rel_path, extensions))
    return files.select(F.regexp_extract("rel", "^([^/]+)/", 1).alias("repo"), rel_path.alias("rel_path"), "rel", "size")


def scan_source_tree(spark: SparkSession, root: str, extensions=None) -> DataFrame:
    """Files under ``root/<repo>/...`` as (repo, rel_path, path, content); ``extensions`` as in ``list_source_tree``."""
    read = read_tree(list_source_tree(spark, root, extensions), root)
    return read.select(F.regexp_extract("rel", "^([^/]+)/", 1).alias("repo"), F.regexp_extract("rel", "^[^/]+/(.*)$", 1).alias("rel_path"),
                       "path", "content")


def _log_lines(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(experiment, repo_dir, pos, line): the two folders above ``job_results`` logs, or above the file, name the run."""
    files = list_tree(spark, root, f"**/{name}")
    lines = read_tree_lines(files, root)
    folders = F.regexp_replace(F.regexp_replace("rel", "/?[^/]*$", ""), "(^|/)job_results/", "$1")
    return lines.select(F.regexp_replace(folders, "/?[^/]*$", "").alias("experiment"),
                        F.regexp_extract(folders, "[^/]*$", 0).alias("repo_dir"), "pos", "line")


def read_build_log_lines(spark: SparkSession, root: str, name: str = "build.log") -> DataFrame:
    """Build logs as lines (experiment, repo_dir, line): a huge log is split across tasks."""
    return _log_lines(spark, root, name).drop("pos")


def read_agent_log_lines(spark: SparkSession, root: str, name: str = "stdout.log") -> DataFrame:
    """Agent logs as lines (experiment, repo_dir, run_id, pos, line) for ``parse_agent_log_lines``.

    ``run_id`` is the folder below ``root`` (experiment and repository), so one repository in two
    experiments is two runs; ``pos`` is the line's byte offset, fixed however the file is split.
    """
    lines = _log_lines(spark, root, name)
    return lines.select("experiment", "repo_dir", F.concat_ws("/", F.nullif("experiment", F.lit("")), "repo_dir").alias("run_id"), "pos", "line")


# ---------------------------------------------------------------- sinks
def write_run_records(runs: DataFrame, out: str, partition_col: str = "experiment") -> None:
    """K1: store run records: ANSI codes removed from stdout (F5), patch ends in '\\n' (F9),
    build log kept in its own column and dropped from the summary struct (P6).

    Replaces the experiments that ``runs`` holds and leaves the others that are stored as they are.
    """
    mr = F.col("migration_result")
    fixed = runs.withColumn("migration_result", F.when(mr.isNotNull(), mr.withField(
        "stdout", T.strip_ansi(mr["stdout"])).withField("diff", T.ensure_trailing_newline(mr["diff"]))))
    stored = summary_projection(fixed.withColumn("build_log", F.col("migration_result.build_log")))
    stored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(out)


def write_funnel(funnel: DataFrame, out: str) -> None:
    """K2: store the funnel (long form) as JSON."""
    funnel.coalesce(1).write.mode("overwrite").json(out)


def write_guard_report(rows: DataFrame, summary: DataFrame, out: str) -> None:
    """K3: per-repo guard rows (Parquet) and the one-row summary (JSON), replacing an earlier report.

    The rows may come from the report that they replace: they are written aside first.
    """
    rows, summary = materialize(rows, "guard-rows"), materialize(summary, "guard-summary")
    rows.write.mode("overwrite").parquet(f"{out.rstrip('/')}/repo_results")
    summary.coalesce(1).write.mode("overwrite").json(f"{out.rstrip('/')}/summary")


def write_nested_results(runs: DataFrame, out: str) -> None:
    """K4: all job results as nested JSON records."""
    runs.write.mode("overwrite").json(out)


def parse_experiment_path(path) -> list:
    """K5: ``…/YYYY-MM-DD/HH-MM-SS-name`` -> run_ts (timestamp), run_name."""
    c = F.col(path) if isinstance(path, str) else path
    d = F.regexp_extract(c, EXPERIMENT_PATH_RE, 1)
    t = F.regexp_extract(c, EXPERIMENT_PATH_RE, 2)
    name = F.regexp_extract(c, EXPERIMENT_PATH_RE, 3)
    ts = F.when(d != "", F.try_to_timestamp(F.concat_ws(" ", d, t), F.lit("yyyy-MM-dd HH-mm-ss")))
    return [ts.alias("run_ts"), F.when(name != "", name).alias("run_name")]


#: Where experiments stand whose path has no date.
NO_DATE = "1970-01-01"


def _run_date(path):
    return F.coalesce(F.try_to_timestamp(F.regexp_extract(path, EXPERIMENT_PATH_RE, 1), F.lit("yyyy-MM-dd")).cast("date"),
                      F.lit(NO_DATE).cast("date")).alias("run_date")


def write_experiment_runs(runs: DataFrame, out: str, path_col: str = "experiment") -> None:
    """K5/K1: store runs by the date in their experiment's path, and by experiment below it.

    Replaces the experiments that ``runs`` holds and leaves the others.  An experiment with most of the
    runs is written by many tasks (Spark rebalances by size).  A path without a date stands under NO_DATE,
    a NULL path is an empty one.
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    placed = runs.withColumn(path_col, path).withColumn("run_date", _run_date(path))
    (placed.hint("rebalance", "run_date", path_col).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_date", path_col).parquet(out))


def read_experiment_runs(spark: SparkSession, out: str, path_col: str = "experiment") -> DataFrame:
    """The runs of a store of ``write_experiment_runs``; conditions on ``run_date`` choose folders."""
    found = spark.read.parquet(out).schema
    # A path is text, also where all of them look like numbers.
    schema = StructType([StructField(f.name, StringType()) if f.name == path_col else f for f in found.fields])
    back = spark.read.schema(schema).parquet(out)
    return back.withColumn(path_col, F.coalesce(path_col, F.lit("")))


def experiment_window(store: DataFrame, experiments: DataFrame, path_col: str = "experiment") -> DataFrame:
    """The stored runs of the experiments in a (filtered) table: each run once, however often its experiment is named.

    The dates follow from the paths, so Spark prunes the store's folders by the dates that the filter leaves,
    when the query runs (dynamic partition pruning, where the table of experiments is small enough for
    Spark to broadcast it; else the same join reads all folders).
    """
    path = F.coalesce(F.col(path_col).cast("string"), F.lit(""))
    chosen = experiments.select(path.alias(path_col), _run_date(path))
    return store.join(chosen, ["run_date", path_col], "left_semi")


# ---------------------------------------------------------------- manifests longer than a task
#: Lines that may stand outside of items; lines that make a file one to be parsed whole: references between
#: items, line breaks other than the line feed, a byte order mark.
_OUTSIDE = "^\\s*(#.*)?$"
_WHOLE = "(^|[\\s\\[{,:-])[&*][^\\s&*]|[\\r\\u0085\\u2028\\u2029\\uFEFF]"
ITEM_SCHEMA = StructType([*MANIFEST_SCHEMA.fields, StructField("problem", StringType())])


def _parsed_items(pdfs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows of pieces (path, ordinal, text): one item each, or a whole file where ``ordinal`` is missing."""
    import yaml
    blank = dict.fromkeys(MANIFEST_SCHEMA.names)
    for pdf in pdfs:
        rows = []
        for path, ordinal, text in zip(pdf["path"], pdf["ordinal"], pdf["text"]):
            whole = pd.isna(ordinal)
            try:
                if "\ufffd" in text:
                    raise ValueError("not UTF-8")
                items = yaml.load(text, Loader=_yaml_loader()) or []
                if not isinstance(items, list):
                    raise ValueError("not a list")
            except (yaml.YAMLError, ValueError) as e:
                rows.append({**blank, "source_file": path, "ordinal": None if whole else int(ordinal), "problem": str(e).splitlines()[0]})
                continue
            for i, item in enumerate(items):
                row = {**blank, "source_file": path, "ordinal": i if whole else int(ordinal), "problem": None}
                try:
                    rows.append({**row, **_item_fields(item)})
                except (AttributeError, TypeError, ValueError, OverflowError) as e:
                    rows.append({**row, "problem": f"not an item: {str(e).splitlines()[0]}"})
        out = pd.DataFrame(rows, columns=ITEM_SCHEMA.names, dtype=object)
        yield out.assign(ordinal=out["ordinal"].astype("Int64"), commit_date=pd.to_datetime(out["commit_date"], utc=True))


def read_manifest_items(spark: SparkSession, path: str, glob: str = "*.yaml", split_bytes: int | None = None) -> DataFrame:
    """S1 for manifests of any length: the rows of ``read_manifests`` and ``problem``, items parsed one by one in many tasks.

    A file is read in splits as lines; an item begins at a line ``- …`` and goes on over the indented lines
    behind it.  A running count over ranges of (file, position) numbers the items, wherever the splits cut.
    An item that cannot be parsed, is no mapping, or holds U+FFFD (which also stands for bytes that are not
    UTF-8) is one row with its ``ordinal`` and ``problem``; the others are not touched.  A file with other lines
    at its left edge, references between items or unusual line breaks is parsed whole; if that fails, it is
    one row without ``ordinal``.  Empty files give no rows.  Text in quotes over several lines must be indented,
    as YAML wants.  One item is one row, so its lines are gathered.  Runs jobs.
    """
    from runlens.operators._plan import running_sum
    from runlens.sources.tree import SPLIT_BYTES
    ship_package(spark)
    files = list_tree(spark, path, f"**/{glob}")
    lines = read_tree_lines(files, path, split_bytes or SPLIT_BYTES)
    starts, inside = F.col("line").rlike("^-(\\s|$)"), F.col("line").rlike("^[ \\t]")
    flagged = lines.withColumn("_d", starts.cast("long"))
    numbered = running_sum(flagged, ["rel"], ["pos"], "_d", "_item", inclusive=True)
    outside = F.col("line").rlike(_OUTSIDE)
    head = (F.col("_item") == 0) & (F.col("line") == "---")
    odd = F.col("line").rlike(_WHOLE) | ~(starts | outside | head | (inside & (F.col("_item") > 0)))
    whole = materialize(numbered.where(odd).select("rel").distinct(), "whole-manifests")
    items = (numbered.where("_item > 0").join(whole, "rel", "left_anti").groupBy("rel", "_item")
             .agg(F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("_lines")))
    root = path.rstrip("/")
    pieces = items.select(F.concat(F.lit(f"{root}/"), "rel").alias("path"), (F.col("_item") - 1).alias("ordinal"),
                          F.concat(F.array_join("_lines.line", "\n"), F.lit("\n")).alias("text"))
    texts = read_tree(whole, path).select("path", F.lit(None).cast("long").alias("ordinal"),
                                          F.expr("try_validate_utf8(cast(content as string))").alias("text"))
    bad = F.coalesce("text", F.lit("\ufffd")).alias("text")
    return pieces.unionByName(texts.select("path", "ordinal", bad)).mapInPandas(_parsed_items, ITEM_SCHEMA)
