"""User functions per row: error capture (X1) and bounded retries."""
from pyspark.sql.types import LongType, StructField, StructType

from runlens.operators.udf import guarded_map

OUT = StructType([StructField("y", LongType())])


def _flaky_factory():
    seen = {}

    def fn(rec):
        # Fails on the first try of every even id, then succeeds; id 3 always fails.
        n = seen.get(rec["id"], 0)
        seen[rec["id"]] = n + 1
        if rec["id"] == 3:
            raise RuntimeError("always broken")
        if rec["id"] % 2 == 0 and n == 0:
            raise ValueError("transient")
        return {"y": rec["id"] * 10}
    return fn


def test_guarded_map_captures_errors(spark):
    df = spark.range(6).withColumnRenamed("id", "id").repartition(2)
    rows = {r.id: r for r in guarded_map(df, _flaky_factory(), OUT, keep=["id"]).collect()}
    assert rows[1].status == "SUCCESS" and rows[1].y == 10
    assert rows[2].status == "FAIL" and rows[2].error == "transient" and rows[2].y is None
    assert rows[3].error == "always broken"


def test_guarded_map_retries(spark):
    df = spark.range(6).repartition(2)
    rows = {r.id: r for r in guarded_map(df, _flaky_factory(), OUT, keep=["id"], attempts=3).collect()}
    assert all(rows[i].status == "SUCCESS" for i in (0, 1, 2, 4, 5))
    assert rows[3].status == "FAIL" and rows[3].error == "always broken"


def test_guarded_map_keeps_integers_and_takes_no_wrong_type(spark):
    big = 9007199254740993
    df = spark.createDataFrame([(1, big, None), (2, None, "x"), (3, big, "bad")], "id long, n long, s string")

    def fn(rec):
        assert rec["n"] is None or isinstance(rec["n"], int)
        return {"y": rec["n"] if rec["s"] != "bad" else "not a number"}

    rows = {r.id: r for r in guarded_map(df, fn, OUT, keep=["id", "n", "s"]).collect()}
    assert (rows[1].n, rows[1].y, rows[1].s, rows[1].status) == (big, big, None, "SUCCESS")
    assert (rows[2].n, rows[2].y, rows[2].status) == (None, None, "SUCCESS")
    assert rows[3].status == "FAIL" and rows[3].error and rows[3].y is None
