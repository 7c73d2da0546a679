"""Plan-shaping helpers shared by operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, IntegerType, LongType, StructField, StructType


def evaluate_once(df: DataFrame) -> DataFrame:
    """Re-emit each row through a one-row generator (``inline(array(struct(*)))``).

    Catalyst pushes filters through projections by substituting the projected
    expression into the predicate, and that copies an expensive expression
    (a parsed log section, an XPath sum) into every reference.  A Generate
    node is not crossed by such pushdown or by project collapsing, so the
    columns above it are computed exactly once per row.  It adds no shuffle
    and stays in the same stage.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` evaluated once per row, however often the body names it (a lambda's variable is bound)."""
    return F.try_element_at(F.transform(F.array(value), body), F.lit(1))


#: Bytes of a range of ``running_sum`` when the number of ranges is not given.
RANGE_BYTES = 256 << 20
MAX_RANGES = 20_000


def ranges_for(df: DataFrame, n_ranges: int | None = None) -> int:
    """Number of ranges: as given, else by the bytes of the tables read, the shuffle partitions at least.

    Leaves without a known size (rows handed over by the driver count as the largest number there is)
    are left out, and so are estimates above the leaves, which multiply at joins.
    """
    if n_ranges:
        return n_ranges
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    known = sum(s for s in sizes if s < 1 << 60)
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(MAX_RANGES, -(-known // RANGE_BYTES)))


#: Characters of a text that the range exchange looks at; Spark samples its keys to the driver and sends bounds to every task.
PREFIX = 256


def range_keys(df: DataFrame, cols: list[str]) -> list[Column]:
    """Columns to range by: long texts by their first PREFIX characters, which order like the texts themselves."""
    return [F.substring(F.col(c), 1, PREFIX) if df.schema[c].dataType.typeName() == "string" else F.col(c) for c in cols]


def running_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, out_col: str,
                inclusive: bool = False, n_ranges: int | None = None) -> DataFrame:
    """Running sum of ``value_col`` per group in ``order_cols`` order, safe for hot groups.

    The rows move once, whole, into balanced ranges of (group, order); a task streams its sorted range,
    adds the sum inside the range and says which rows belong to the range's first group.  The result is
    written to the shared folder.  Only a range's first group can continue an earlier range, so what is
    still missing is one number per range: it is found from one summary row per range (MAX_RANGES at
    most) and added.  NULL groups and orders are groups and orders like any other, rows that repeat stay
    apart (their order among themselves is open), a NULL value counts 0.  Rows whose keys agree up to
    PREFIX characters of each text share a range.
    Returns ``df`` with ``out_col`` added (exclusive by default).  Runs a job at the time of the call.
    """
    import pyarrow as pa
    from pyspark import TaskContext

    from runlens.session import materialize, ship_package
    ship_package(df.sparkSession)
    def run(batches):
        rng, group, total, nth = TaskContext.get().partitionId(), None, 0, -1
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in group_cols)))
            sums, firsts, totals = [], [], []
            for key, value in zip(keys, batch.column(value_col).to_pylist()):
                if nth < 0 or key != group:
                    group, total, nth = key, 0, nth + 1
                before = total
                total += value or 0
                sums.append(total if inclusive else before)
                totals.append(total)
                firsts.append(nth == 0)
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(sums, type=pa.int64()), pa.array(totals, type=pa.int64()),
                 pa.array([rng] * n, type=pa.int32()), pa.array(firsts, type=pa.bool_())],
                names=[*batch.schema.names, "_sum", "_total", "_rng", "_first"])

    ordered = [*group_cols, *order_cols]
    ranged = df.repartitionByRange(ranges_for(df, n_ranges), *range_keys(df, ordered)).sortWithinPartitions(*ordered)
    schema = StructType([*df.schema.fields, StructField("_sum", LongType()), StructField("_total", LongType()),
                         StructField("_rng", IntegerType()), StructField("_first", BooleanType())])
    summed = materialize(ranged.mapInArrow(run, schema), "running-sum")
    key = F.struct(*group_cols)
    place = F.struct(F.struct(*ordered), "_total")
    ranges = summed.groupBy("_rng").agg(
        F.min(key).alias("first"), F.max(key).alias("last"),
        F.max_by("_total", place).alias("last_total"), F.bool_and("_first").alias("single")).orderBy("_rng").collect()
    starts, group, carried = {}, None, 0
    for r in ranges:
        first, last = tuple(r["first"]), tuple(r["last"])
        start = carried if group == first else 0
        starts[r["_rng"]] = start
        group, carried = last, (start + r.last_total if r.single else r.last_total)
    spark = df.sparkSession
    table = spark.createDataFrame(list(starts.items()), "_rng int, _start long")
    out = summed.join(F.broadcast(table), "_rng")                 # one row per range
    return out.select(*df.columns, (F.col("_sum") + F.when(F.col("_first"), F.col("_start")).otherwise(0)).alias(out_col))


def ranged_sum(df: DataFrame, group_cols: list[str], order_cols: list[str], value_col: str, out_col: str,
               inclusive: bool = False, n_ranges: int | None = None) -> DataFrame:
    """``running_sum`` without Python workers, for wide rows that are read once afterwards.

    The rows move once into ranges of (group, order) and are stored in a table bucketed by their range's
    number, a file per range.  A window inside (range, group) over that table needs no second exchange, and
    neither does the summary that tells how much of a range's first group stands before it (a row per
    range, MAX_RANGES at most; no column but groups and value is read for it).  The table is kept in the
    shared folder under a name of its own in the session's catalog.  NULLs, repeated keys and long texts
    as in ``running_sum``.  Runs jobs at the time of the call; the window is computed when the result is read.
    """
    import uuid

    from runlens.session import checkpoint_dir
    spark, ordered, n = df.sparkSession, [*group_cols, *order_cols], ranges_for(df, n_ranges)
    name = f"runlens_ranges_{uuid.uuid4().hex}"
    (df.repartitionByRange(n, *range_keys(df, ordered)).withColumn("_rng", F.spark_partition_id())
     .write.bucketBy(n, "_rng").option("path", f"{checkpoint_dir(spark).rstrip('/')}/{name}").saveAsTable(name))
    stored = spark.table(name)
    value = F.coalesce(F.col(value_col).cast("bigint"), F.lit(0))
    key = F.struct(*group_cols)
    summary = (stored.groupBy("_rng", *group_cols).agg(F.sum(value).alias("total"))
               .groupBy("_rng").agg(F.min(key).alias("first"), F.max(key).alias("last"), F.max_by("total", key).alias("total"),
                                    (F.count("*") == 1).alias("single")).orderBy("_rng"))
    starts, group, carried = [], None, 0
    for r in summary.collect():
        start = carried if group == tuple(r["first"]) else 0
        if start:
            starts.append((r["_rng"], r["first"], start))
        group, carried = tuple(r["last"]), r["total"] + (start if r["single"] else 0)
    schema = StructType([StructField("_of", IntegerType()), StructField("_first", StructType([df.schema[c] for c in group_cols])),
                         StructField("_start", LongType())])
    table = spark.createDataFrame(starts, schema)                   # one row per range at most
    own = Window.partitionBy("_rng", *group_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    summed = stored.withColumn("_sum", F.coalesce(F.sum(value).over(own), F.lit(0)))
    out = summed.join(F.broadcast(table), (F.col("_rng") == F.col("_of")) & key.eqNullSafe(F.col("_first")), "left")
    return out.select(*df.columns, (F.col("_sum") + F.coalesce("_start", F.lit(0))).alias(out_col))
