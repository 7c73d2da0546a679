"""Maven status trace per run (Q3: W3, F1, P4) and trace points (Q6: A8, L2, W4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.functions import maven as M
from runlens.session import materialize


def status_trace(steps: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Q3: (run, step, status) for steps with execution logs, NO_MAVEN dropped.

    ``step`` is the 0-based position among *all* steps of the log (numbered
    before filtering), which the step parser already carries as ``step_pos``.
    Map-only: no shuffle.
    """
    logs = F.col("execution_logs")
    code = M.maven_status_code(logs)
    return (steps.filter(logs.isNotNull() & (logs != ""))
            .select(run_col, F.col("step_pos").alias("step"), code.alias("status_code"))
            .filter(F.col("status_code") != 0)
            .withColumn("status_name", M.status_name(F.col("status_code"))))


def trace_points(trace: DataFrame, run_col: str = "run_id") -> DataFrame:
    """Q6: y = rank of the step's status among the distinct statuses of its run.

    The distinct statuses of a run are one 11-bit mask (``bit_or``), an
    algebraic aggregate: partial per task, so a run with a huge trace costs
    one partial row per task.  The rank is the number of present statuses
    with a lower code, ``bit_count(mask & ((1 << code) - 1))``.
    """
    # The trace feeds both the mask aggregate and the join: the small (run, step, status) rows are
    # written once to the shared folder (a job at the time of the call) instead of parsing the logs twice.
    trace = materialize(trace, "trace")
    masks = trace.groupBy(F.col(run_col).alias("_run")).agg(
        F.bit_or(F.expr("shiftleft(1, status_code)")).alias("_mask"))
    j = trace.join(masks, F.col(run_col).eqNullSafe(F.col("_run")))
    y = F.expr("bit_count(_mask & (shiftleft(1, status_code) - 1))")
    label = F.concat(F.col("status_name"), F.lit(" ("), F.col("status_code").cast("string"), F.lit(")"))
    return j.select(run_col, "step", y.cast("int").alias("y"), "status_code", label.alias("label"))


def distinct_statuses(trace: DataFrame, run_col: str = "run_id") -> DataFrame:
    """A8 + L2: distinct statuses of each trace, in enum order."""
    return (trace.select(run_col, "status_code", "status_name").distinct()
            .orderBy(run_col, "status_code"))
