"""Bridges: reference-shaped inputs derived from the driver tables.

Every bridge is row-local (a projection, filter, explode or union of the
driver tables): no bridge groups rows into one text, so no key, however hot,
turns into one giant row or one heavy task.  The DuckDB oracles compute the
expected answers from the source columns, never by re-parsing this text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.session import materialize


_TABLES: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table as it is stored, or, if its tasks would be uneven, copied once per application into a file per task slot.

    A small driver table is a single Parquet row group, which only one task can read.  The copy in the shared
    checkpoint folder has a row group per slot, so the bridges' row-local work spreads without a shuffle
    in any query.  A larger table has row groups for all slots and is never copied: a query reads the
    columns it needs from where they are.  The first use of a table counts its tasks' rows and may run this copy.
    """
    path = f"{sf_dir.rstrip('/')}/{name}.parquet"
    key = (spark.sparkContext.applicationId, path)
    if key not in _TABLES:
        slots = spark.sparkContext.defaultParallelism
        stored = spark.read.parquet(path)
        _TABLES[key] = stored if _even(stored, slots) else materialize(stored.repartition(slots), f"table-{name}")
    return _TABLES[key]


def _even(stored: DataFrame, slots: int) -> bool:
    """Has no task more than twice a slot's share of the rows?  Reads the row counts of the files, no column."""
    tasks = stored.groupBy(F.spark_partition_id().alias("task")).count()
    rows = tasks.agg(F.max("count").alias("most"), F.sum("count").alias("all")).first()
    return (rows["most"] or 0) * slots <= 2 * (rows["all"] or 0)


def _s(c) -> F.Column:
    return F.col(c).cast("string") if isinstance(c, str) else c.cast("string")


# ---------------------------------------------------------------- B1: runs
def b1_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One run per order: repo ``own{custkey % 97}/r_{k}``; no result if k % 11 = 0."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        k.alias("run_id"),
        F.concat(F.lit("own"), _s(F.col("o_custkey") % 97), F.lit("/r_"), _s(k)).alias("repo"),
        (k % 11 != 0).alias("has_result"),
        (k % 13 == 0).alias("build_only"),
    )


def b1_log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Build-log lines (run_id, kind, line) for every run with a result.

    compile log by k % 7: 0 compiler-plugin failure, 1 [FATAL], 2 BUILD FAILURE,
    else BUILD SUCCESS.  Test log: one surefire line per lineitem row, then a
    marker by k % 5: 0 failure, 1 none ([FATAL] when k even), 2 both, else success.
    """
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"))
    orders = orders.filter(F.col("run_id") % 11 != 0)
    k = F.col("run_id")
    ks = _s(k)
    compile_marker = (
        F.when(k % 7 == 0, F.concat(
            F.lit("[ERROR] Failed to execute goal org.apache.maven.plugins:maven-compiler-plugin:3.8.1:compile "
                  "(default-compile) on project r_"), ks, F.lit(": Compilation failure")))
        .when(k % 7 == 1, F.concat(F.lit("[FATAL] Non-resolvable parent POM for r_"), ks))
        .when(k % 7 == 2, F.lit("[INFO] BUILD FAILURE"))
        .otherwise(F.lit("[INFO] BUILD SUCCESS")))
    compile_lines = orders.select(
        k, F.lit("compile").alias("kind"),
        F.explode(F.array(F.lit("[INFO] Scanning for projects..."), compile_marker)).alias("line"))
    test_marker = (
        F.when(k % 5 == 0, F.array(F.lit("[INFO] BUILD FAILURE")))
        .when((k % 5 == 1) & (k % 2 == 0), F.array(F.lit("[FATAL] The forked VM terminated")))
        .when(k % 5 == 1, F.array().cast("array<string>"))
        .when(k % 5 == 2, F.array(F.lit("[INFO] BUILD SUCCESS"), F.lit("[ERROR] BUILD FAILURE")))
        .otherwise(F.array(F.lit("[INFO] BUILD SUCCESS"))))
    marker_lines = orders.select(k, F.lit("test").alias("kind"), F.explode(test_marker).alias("line"))
    li = table(spark, sf_dir, "lineitem")
    counter_lines = li.filter(F.col("l_orderkey") % 11 != 0).select(
        F.col("l_orderkey").alias("run_id"), F.lit("test").alias("kind"),
        F.concat(F.lit("[INFO] Tests run: "), _s(F.col("l_quantity").cast("bigint")),
                 F.lit(", Failures: "), _s(F.col("l_linenumber")),
                 F.lit(", Errors: 0, Skipped: "), _s(F.col("l_partkey") % 3),
                 F.lit(", Time elapsed: 0.1 s - in A")).alias("line"))
    return compile_lines.unionByName(marker_lines).unionByName(counter_lines)


def b1_test_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole-text logs, one per lineitem row: a per-class line, a total line and noise."""
    li = table(spark, sf_dir, "lineitem")
    q = _s(F.col("l_quantity").cast("bigint"))
    ln = _s(F.col("l_linenumber"))
    sk = _s(F.col("l_partkey") % 3)
    per_class = F.concat(F.lit("Tests run: "), q, F.lit(", Failures: "), ln, F.lit(", Errors: 0, Skipped: "), sk)
    total = F.concat(F.lit("Tests run:   "), q, F.lit(",Failures: 0,  Errors: "), ln, F.lit(", Skipped: 0"))
    text = (F.when(F.col("l_partkey") % 4 == 0, F.lit("[INFO] no tests to run\n[INFO] BUILD SUCCESS"))
            .otherwise(F.concat_ws("\n", F.lit("[INFO] T E S T S"), per_class, F.lit("Results :"), total,
                                   F.lit("[INFO] BUILD SUCCESS"))))
    return li.select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").alias("line_no"),
                     F.col("l_partkey").alias("part_id"), text.alias("log"))


def files_written(files, name: str) -> str:
    """Write rows (rel, content) as files below a fresh folder in the shared checkpoint folder, in tasks; its path.

    A task that is run again writes the same files once more.  Runs a job.
    """
    import uuid

    from runlens.session import checkpoint_dir, ship_package
    from runlens.sources.tree import open_root
    spark = files.sparkSession
    ship_package(spark)
    root = f"{checkpoint_dir(spark).rstrip('/')}/runlens-io/{name}-{uuid.uuid4().hex[:12]}"
    open_root(root)[0].create_dir(open_root(root)[1], recursive=True)

    def write(batches):
        import pyarrow as pa
        system, base = open_root(root)
        made = set()
        for batch in batches:
            # One content at a time: no second copy of a batch stands beside it.
            for rel, content in zip(batch.column("rel").to_pylist(), (c.as_buffer() for c in batch.column("content"))):
                folder = f"{base}/{rel}".rpartition("/")[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                with system.open_output_stream(f"{base}/{rel}") as f:
                    f.write(content)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], type=pa.int64())], names=["files"])

    files.select("rel", F.col("content").cast("binary")).mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return root
