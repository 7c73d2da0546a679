"""Property tests (hypothesis) for the scalar functions and the funnel."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from runlens.functions import text as T
from runlens.operators import runs

texts = st.lists(st.one_of(st.none(), st.text(max_size=300)), min_size=1, max_size=40)


@settings(max_examples=15, deadline=None)
@given(texts, st.integers(min_value=4, max_value=120))
def test_collapse_middle_bounds(spark, values, n):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for v, r in zip(values, [x.r for x in df.select(T.collapse_middle("v", n).alias("r")).collect()]):
        if v is None:
            assert r == "None"
        else:
            assert len(r) <= n and (r == v or (r.startswith(v[:(n - 3) // 2]) and "..." in r))


@settings(max_examples=15, deadline=None)
@given(texts)
def test_ansi_strip_idempotent_and_splitlines(spark, values):
    df = spark.createDataFrame([(v,) for v in values], "v string")
    rows = df.select("v", T.strip_ansi("v").alias("a"), T.splitlines("v").alias("l")).collect()
    for r in rows:
        if r.v is not None:
            assert r.l == r.v.splitlines()
    again = spark.createDataFrame([(r.a,) for r in rows], "a string").select(T.strip_ansi("a").alias("b")).collect()
    assert [r.a for r in rows] == [x.b for x in again]


flags = st.lists(st.tuples(st.booleans(), st.sampled_from([True, False, None]), st.sampled_from([True, False, None])),
                 min_size=1, max_size=60)


@settings(max_examples=15, deadline=None)
@given(flags)
def test_funnel_monotone_when_tests_imply_build(spark, rows):
    # Only runs with a result carry build/test outcomes, and a passing test implies a build.
    clean = [(h, b if h else None, (t if (h and b) else None)) for h, b, t in rows]
    df = spark.createDataFrame(clean, "has_result boolean, build_success boolean, test_success boolean")
    f = {r.stage: (r.started, r.succeeded) for r in runs.funnel(df).collect()}
    assert f["run_job"][0] >= f["run_job"][1] == f["compile"][0] >= f["compile"][1] == f["test"][0] >= f["test"][1]
    assert f["overall"] == (f["run_job"][0], f["test"][1])
    stats = runs.result_stats(df.select(F.when(~F.col("has_result"), "FAIL")
                                        .when(F.col("test_success"), "SUCCESS").otherwise("SKIP").alias("status")))
    s = stats.collect()[0]
    assert s.success + s.fail + s.skip == len(rows)


def test_guard_lookups_broadcast_small_sides(spark):
    df = E.queries()["guard_rows"](spark, SF_SMALL)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in final and "LeftSemi" in final and "LeftOuter" in final


path_parts = st.lists(st.sampled_from(["target", "targets", "src", ".git", "a.b", "..", ".", "x.JAR", "y.jar.tmp",
                                       "z.Class", ".tmp", "..jar", "a..war", "b.ear.bak", "lib"]),
                      min_size=1, max_size=5)


def _py_excluded(p):
    import os
    if any(part == "target" for part in p.split("/")):
        return True
    return os.path.splitext(p)[1].lower() in {".class", ".jar", ".war", ".ear", ".tmp"}


@settings(max_examples=20, deadline=None)
@given(st.lists(path_parts, min_size=1, max_size=30))
def test_patch_exclusion_matches_python(spark, paths):
    from runlens.operators.patch import is_excluded
    ps = ["/".join(x) for x in paths]
    got = [r.e for r in spark.createDataFrame([(p,) for p in ps], "p string").select(is_excluded("p").alias("e")).collect()]
    assert got == [_py_excluded(p) for p in ps], list(zip(ps, got))


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["hot", "hot", "hot", "a", "b"]), st.integers(0, 50)), min_size=1,
                max_size=300),
       st.booleans(), st.sampled_from([1, 3, 8]))
def test_running_sum_matches_python(spark, rows, inclusive, n_ranges):
    from runlens.operators._plan import running_sum
    data = [(g, i, v) for i, (g, v) in enumerate(rows)]
    df = spark.createDataFrame(data, "g string, pos long, v long")
    got = {(r.g, r.pos): r.s for r in running_sum(df, ["g"], ["pos"], "v", "s", inclusive=inclusive,
                                                   n_ranges=n_ranges).collect()}
    want, acc = {}, {}
    for g, pos, v in data:
        before = acc.get(g, 0)
        want[(g, pos)] = before + v if inclusive else before
        acc[g] = before + v
    assert got == want
