"""Session helpers.

On a cluster the session is created by the launcher; these helpers only fill
in settings that are unset, so a cluster's own values always win.
"""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings every runlens job relies on (UTC so timestamps match the oracle,
# AQE so shuffle partition counts and skewed joins are re-planned at runtime).
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app_name: str = "runlens") -> SparkSession:
    """Return the active session, or build a local one (tests, bench)."""
    active = SparkSession.getActiveSession()
    if active is not None:
        return active
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in _DEFAULTS.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", os.environ.get("RUNLENS_DRIVER_MEMORY", "16g"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared checkpoint folder named by the cluster in ``spark.checkpoint.dir``.

    Only on a local master (tests) an unset folder is replaced by a fresh scratch folder; anywhere
    else executors would write to their own disks, so an unset folder is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    configured = configured or sc.getCheckpointDir()
    if not configured:
        if not re.match(r"local(\[|$)", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        configured = tempfile.mkdtemp(prefix="runlens-ckpt-")
        spark.conf.set("spark.checkpoint.dir", configured)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(configured)
    return configured


def materialize(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` to a new folder under the shared checkpoint folder and read it back.

    Each row is computed once, whatever reads it afterwards, and a lost executor costs a re-read.
    This runs a job at the time of the call.
    """
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/runlens-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``runlens`` importable in Python workers (idempotent per SparkContext).

    Operators that run Python (pandas UDFs, ``mapInPandas``) pickle functions
    by reference to this package, so executors need it on their path.  A
    cluster job usually ships it with ``--py-files``; otherwise the package is
    zipped once and distributed with ``SparkContext.addPyFile``.
    """
    try:
        sc = spark.sparkContext
        key = sc.applicationId
    except Exception:  # noqa: BLE001 - Spark Connect: ship with the client's artifact API instead
        return
    if key in _SHIPPED:
        return
    import zipfile

    import runlens
    pkg_dir = os.path.dirname(os.path.abspath(runlens.__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="runlens-pyfiles-"), "runlens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for base, _dirs, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(base, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(out)
    _SHIPPED.add(key)
