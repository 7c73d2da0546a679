"""Gapless numbers for rows in a global order, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm._common import written
from runlens.operators._plan import ranges_for


def numbered(df: DataFrame, group: list[str], order: list[Column], out: str) -> DataFrame:
    """``df`` with ``out``: the place (from 0) of every row in its group, in the given order.

    The rows move once into balanced ranges of (group, order, place in the scan), so that neither a
    large group nor a third of all rows with one key lands in one task.  Inside a range the sorted rows
    are counted as they stream by, the result is written to the shared folder, and what lies in front
    of a range is summed from one row per (range, group).  Rows that are equal in group and order are
    numbered in any order.  Group columns hold no nulls.  ``df`` must come from files (``written``), whose
    rows stand in a fixed order: a task that is run again then deals its rows out alike.  Runs a job.
    """
    keys = [*map(F.col, group), *order, F.col("_scan_place")]
    ranged = (df.withColumn("_scan_place", F.monotonically_increasing_id())
              .repartitionByRange(ranges_for(df), *keys).sortWithinPartitions(*keys).drop("_scan_place")
              .withColumn("_place", F.monotonically_increasing_id()))
    rows = written(ranged, "numbered").withColumn("_range", F.shiftright("_place", 33))
    heads = rows.groupBy("_range", *group).agg(F.min("_place").alias("_first"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    heads = heads.select("_range", *group, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (rows.join(heads, ["_range", *group])
            .select(*[F.col(f"`{c}`") for c in df.columns], (F.col("_place") + F.col("_shift")).alias(out)))
