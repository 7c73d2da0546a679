"""Plan-shape tests: built-in operators stay in the JVM, the log parser needs no shuffle,
and the corpus layout stays exact when one repository holds most files."""
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from conftest import SF_SMALL
from runlens.operators import corpus as CO

PY_NODES = ("BatchEvalPython", "ArrowEvalPython", "MapInArrow", "MapInPandas", "FlatMapGroupsInPandas", "PythonUDF")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["funnel", "build_verdict", "agent_steps", "status_trace", "maven_status",
                                  "pom_modules", "multi_module", "changed_files", "filtered_patch"])
def test_no_python_in_builtin_queries(spark, name):
    p = plan(E.queries()[name](spark, SF_SMALL))
    assert not any(n in p for n in PY_NODES), p


def test_agent_log_parsing_is_map_only(spark):
    p = plan(E.queries()["agent_steps"](spark, SF_SMALL))
    assert "Exchange" not in p, p


def test_descriptor_elements_are_map_only(spark):
    p = plan(E.queries()["pom_dependencies"](spark, SF_SMALL))
    assert "Exchange" not in p and p.count("MapInArrow") == 1, p
    p = plan(E.queries()["multi_module"](spark, SF_SMALL))
    assert "regexp_extract_all" not in p and "aggregate(" not in p, p


def test_filters_reach_the_scan(spark):
    p = plan(E.queries()["first_n"](spark, SF_SMALL))
    assert "TakeOrderedAndProject" in p
    p = E.queries()["build_verdict"](spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<l_orderkey:bigint,l_partkey:bigint,l_linenumber:int,l_quantity:double>" in p


def test_corpus_layout_skewed_repo_matches_brute_force(spark):
    rows = [("hot", f"/r/hot/f{i:05d}.py", "x" * (i % 7)) for i in range(3000)] + \
           [("cold", f"/r/cold/g{i}.py", "yy") for i in range(5)]
    pieces = spark.createDataFrame(rows, "repo string, path string, piece string")
    got = {(r.repo, r.path): r.offset for r in CO.corpus_layout(pieces, n_ranges=8).collect()}
    want = {}
    for repo in ("hot", "cold"):
        off = 0
        for _, path, piece in sorted(r for r in rows if r[0] == repo):
            want[(repo, path)] = off
            off += len(piece) + 1
    assert got == want


def test_running_sum_ranges_by_short_keys(spark, monkeypatch):
    """No whole text is a range key, and ties of the prefixes keep the order of the texts."""
    from runlens.operators import _plan
    monkeypatch.setattr(_plan, "PREFIX", 2)
    rows = [("g", f"{'ab' if i % 3 else 'aa'}{(i * 37) % 100:03d}", 1) for i in range(100)] + [("g", None, 1)]
    df = spark.createDataFrame(rows, "g string, o string, v long").repartition(3)
    got = {r.o: r.s for r in _plan.running_sum(df, ["g"], ["o"], "v", "s", n_ranges=5).collect()}
    assert got == {o: i for i, o in enumerate([None, *sorted(o for _, o, _ in rows if o)])}
    p = plan(df.repartitionByRange(5, *_plan.range_keys(df, ["g", "o"])))
    assert "rangepartitioning(substring" in p or "_w0" in p or "rangepartitioning(_" in p, p


@pytest.mark.parametrize("form", ["running_sum", "ranged_sum"])
def test_running_sum_keeps_null_and_repeated_keys(spark, form):
    from runlens.operators import _plan
    running_sum = getattr(_plan, form)
    rows = [(None, 1, 5), (None, None, 7), ("a", 1, 2), ("a", 1, 2), ("a", 2, None), ("b", 1, 9)] + [("c", i, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(3)
    got = sorted(((r.g, r.o, r.v, r.s) for r in running_sum(df, ["g"], ["o"], "v", "s", inclusive=True, n_ranges=7).collect()), key=repr)
    want = [(None, None, 7, 7), (None, 1, 5, 12), ("a", 1, 2, 2), ("a", 1, 2, 4), ("a", 2, None, 4), ("b", 1, 9, 9)]
    assert got == sorted(want + [("c", i, 1, i + 1) for i in range(500)], key=repr)


def test_ranged_sum_needs_no_second_exchange(spark):
    """The window and its summary read the stored ranges bucket by bucket, without Python; groups over many ranges add up."""
    from runlens.operators._plan import ranged_sum
    rows = [("hot", i, i % 5) for i in range(900)] + [("a", 1, 3), ("z", 1, 4), ("z", 2, 5)]
    df = spark.createDataFrame(rows, "g string, o int, v long").repartition(5)
    out = ranged_sum(df, ["g"], ["o"], "v", "s", n_ranges=9)
    p = plan(out)
    assert "Window" in p and "hashpartitioning" not in p and "rangepartitioning" not in p and not any(n in p for n in PY_NODES), p
    want = {("a", 1): 0, ("z", 1): 0, ("z", 2): 4} | {("hot", i): sum(j % 5 for j in range(i)) for i in range(900)}
    assert {(r.g, r.o): r.s for r in out.collect()} == want
    assert ranged_sum(df.where("false"), ["g"], ["o"], "v", "s").count() == 0


def test_agent_log_lines_move_once(spark):
    """The logs are read and ranged once; the plan over the numbered lines has one group per step and the header join."""
    from runlens.operators import agentlog
    from runlens.plans.q_agentlog import b3_agent_log_lines
    p = plan(agentlog.parse_agent_log_lines(b3_agent_log_lines(spark, SF_SMALL)))
    assert p.count("hashpartitioning") <= 4 and "rangepartitioning" not in p and "Window" not in p


def test_status_trace_builds_only_what_it_needs(spark):
    p = E.queries()["status_trace"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    for gone in ("raw_text", "input_tokens", "warnings", "_alone", "_rest"):
        assert gone not in p


def test_trace_points_keep_null_runs(spark):
    from runlens.operators import trace
    t = spark.createDataFrame([(None, 0, 3, "SUCCESS"), (None, 1, 1, "COMPILE_ERROR")], "run_id long, step int, status_code int, status_name string")
    assert sorted((r.step, r.y) for r in trace.trace_points(t).collect()) == [(0, 1), (1, 0)]


def test_checkpoint_folder_must_be_shared():
    from types import SimpleNamespace

    import pytest

    from runlens.session import checkpoint_dir
    fake = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None, set=lambda *a: None),
                                          sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None))
    with pytest.raises(RuntimeError):
        checkpoint_dir(fake("spark://host:7077"))
    with pytest.raises(RuntimeError):
        checkpoint_dir(fake("local-cluster[2,1,1024]"))
    assert checkpoint_dir(fake("local[4]"))


def test_ranges_follow_the_tables_read(spark):
    from runlens.operators import _plan as P
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(1, "a")], "k int, v string")
    table = spark.read.parquet(f"{SF_SMALL}/lineitem.parquet").select(F.col("l_linenumber").alias("k"), F.col("l_returnflag").alias("v"))
    for df in (rows, table.union(rows), table.join(table, "k").join(rows, "k")):
        assert P.ranges_for(df) == least
    assert P.ranges_for(table, 3) == 3


def test_stored_guard_needs_no_exchange(spark):
    p = plan(E.queries()["guard_stored"](spark, SF_SMALL))
    assert "Exchange" not in p and p.count("SortMergeJoin") == 2 and "Bucketed: true" in p, p


def test_window_of_experiments_opens_only_their_dates(spark):
    df = E.queries()["experiment_window"](spark, SF_SMALL)
    p = plan(df)
    assert "dynamicpruning" in p.lower() and "run_date" in p, p
    assert df.count() > 0


def test_tables_with_row_groups_for_all_slots_are_read_in_place(spark, tmp_path):
    """Only a table that a few tasks would read is copied (and then without loss)."""
    from runlens.plans import bridges as B
    slots = spark.sparkContext.defaultParallelism
    rows = spark.range(1000).select(F.col("id").alias("o_orderkey"), (F.col("id") % 7).alias("o_custkey"))
    rows.repartition(4 * slots).write.parquet(f"{tmp_path}/many/orders.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/one/orders.parquet")
    spark.conf.set("spark.sql.files.openCostInBytes", "1k")
    try:
        many, one = (B.table(spark, f"{tmp_path}/{d}", "orders") for d in ("many", "one"))
    finally:
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert all(f"{tmp_path}/many/" in f for f in many.inputFiles())
    assert not any(str(tmp_path) in f for f in one.inputFiles()) or slots <= 2
    assert sorted(many.collect()) == sorted(one.collect()) == sorted(rows.collect())
    rows.where("false").write.parquet(f"{tmp_path}/none/orders.parquet")
    assert B.table(spark, f"{tmp_path}/none", "orders").count() == 0


def test_written_guard_is_computed_once(spark, monkeypatch):
    """The summary is counted from written rows, and the resumed guard does not parse the reports again."""
    from runlens.sources import files as S
    seen, write = [], S.write_guard_report
    monkeypatch.setattr(S, "write_guard_report", lambda rows, summary, out: (seen.extend([plan(rows), plan(summary)]), write(rows, summary, out)))
    E.queries()["guard_written"](spark, SF_SMALL)
    seen.append(plan(E.queries()["guard_resume"](spark, SF_SMALL)))
    assert len(seen) == 5 and not any(n in p for p in seen for n in PY_NODES)


def test_patch_names_and_texts_are_made_once(spark):
    """The generator's file names stand in a projection of their own."""
    p = E.queries()["filtered_patch"](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert p.count("src/main/java/A") == 1
