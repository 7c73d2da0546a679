"""File sources and sinks on real directories in a fresh temp folder."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from runlens.operators import buildlog, corpus as CO, coverage as C
from runlens.sources import files as S, tree as T
from runlens.streaming.progress import latest_counts, progress_counts, progress_latest


def _write(root, rel, data, mode="w"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, mode) as f:
        f.write(data)
    return path


def test_manifest_yaml(spark):
    root = tempfile.mkdtemp(prefix="runlens-manifest-")
    _write(root, "full_dataset.yaml", "- repo_name: a/b\n  commit: '0123'\n  license: MIT\n  extra: 1\n"
                                      "  repo_features:\n    number_of_modules: 2\n"
                                      "  test_count:\n    tests_run: 5\n  commit_date: 2024-01-02T03:04:05Z\n"
                                      "- repo_name: c/d\n  commit: abc\n")
    _write(root, "tiny_dataset.yaml", "- repo_name: x/y\n  commit: zz\n")
    m = S.with_tier(S.read_manifests(spark, root))
    rows = sorted(m.collect(), key=lambda r: (r.tier, r.ordinal))
    assert [(r.tier, r.ordinal, r.repo_name, r.commit) for r in rows] == [
        ("full", 0, "a/b", "0123"), ("full", 1, "c/d", "abc"), ("tiny", 0, "x/y", "zz")]
    assert rows[0].repo_features.number_of_modules == 2 and rows[0].test_count.tests_run == 5
    assert str(rows[0].commit_date) == "2024-01-02 03:04:05"
    rep = {r.tier: (r.n_rows, r.not_in_base) for r in S.tier_subset_report(m).collect()}
    assert rep == {"full": (2, 0), "tiny": (1, 1)}


def test_run_artifact_scan(spark):
    root = tempfile.mkdtemp(prefix="runlens-runs-")
    jr = os.path.join(root, "job_results")
    _write(jr, "own_repo1/result.yaml", "run_success: true\nerror: null\nbuild_result:\n  build_success: true\n"
                                        "  test_success: false\n  build_time: 3.5\n  test_results:\n"
                                        "    tests_run: 4\n    failures: 1\n    errors: 0\n    skipped: 0\n")
    _write(jr, "own_repo1/build.log", "[INFO] BUILD FAILURE\n")
    _write(jr, "own_repo1/stdout.log", "agent said hi\n")
    _write(jr, "own_repo1/diff.patch", "diff --git a/x b/x\n")
    _write(jr, "own_repo2/result.yaml", "")                     # run without result: empty file
    _write(jr, "own_repo3/result.yaml", "run_success: true\nbuild_result:\n  build_success: true\n")  # no patch
    rows = {r.repo: r for r in S.scan_run_artifacts(spark, jr).collect()}
    r1 = rows["own/repo1"]
    assert r1.migration_result.build_result.test_success is False
    assert r1.migration_result.build_result.test_results.tests_run == 4
    assert r1.migration_result.diff == "diff --git a/x b/x\n" and r1.migration_result.output == ""
    assert rows["own/repo2"].empty_result is True and rows["own/repo2"].migration_result is None
    r3 = rows["own/repo3"]                                # no patch, no logs: the build result stays
    assert r3.migration_result.build_result.build_success is True and r3.migration_result.diff is None and r3.stdout is None
    assert r1.stdout == "agent said hi\n" and r1.build_result.build_time == 3.5 and r1.build_log == "[INFO] BUILD FAILURE\n"
    compat = {r.repo: r for r in S.scan_run_artifacts(spark, jr, compat=True).collect()}
    assert compat["own/repo1"].migration_result.build_result.test_results is None
    assert compat["own/repo3"].migration_result is None   # the reference's reload wants all four
    # Build logs read as lines feed the line-form verdict.
    lines = S.read_build_log_lines(spark, jr).select("repo_dir", F.lit("compile").alias("kind"), "line")
    v = buildlog.attach_verdict(spark.createDataFrame([("own_repo1",)], "repo_dir string"),
                                buildlog.verdict_inputs(lines, run_col="repo_dir"), run_col="repo_dir",
                                build_only_col=None).collect()[0]
    assert v.build_success is False


def test_run_records_sink_round_trip(spark):
    out = tempfile.mkdtemp(prefix="runlens-k1-")
    df = spark.createDataFrame([("e1", "a/b", True, ("\x1b[31mred\x1b[0m", "no newline", "LOG"))],
                               "experiment string, repo string, run_success boolean, "
                               "migration_result struct<stdout:string, diff:string, build_log:string>")
    S.write_run_records(df, out + "/runs")
    back = S.read_stored_results(spark, out + "/runs").collect()[0]
    assert back.migration_result.stdout == "red" and back.migration_result.diff == "no newline\n"
    assert back.build_log == "LOG" and "build_log" not in back.migration_result.asDict()
    assert back.experiment == "e1"


def test_pre_coverage_csv(spark):
    root = tempfile.mkdtemp(prefix="runlens-csv-")
    p = _write(root, "cov_data.csv", "repo,percent_before\nown_a,50.5\nown_b,\nown_c,0\n")
    got = {r.repo: r.percent_before for r in S.read_pre_coverage(spark, p).collect()}
    assert got["own/a"] == 50.5 and got["own/c"] == 0.0 and got["own/b"] != got["own/b"]  # NaN


def test_coverage_report_discovery(spark):
    root = tempfile.mkdtemp(prefix="runlens-cov-")
    rep = '<report><counter type="LINE" missed="1" covered="3"/></report>'
    _write(root, "r/m1/target/site/jacoco/jacoco.xml", rep)
    _write(root, "r/m2/target/site/jacoco-aggregate/jacoco.xml", rep)
    _write(root, "r/m3/target/site/other/jacoco.xml", rep)
    _write(root, "r/m4/target/site/jacoco/jacoco.xml", "<report>")
    reports = S.scan_coverage_reports(spark, root).withColumn("run_id", F.lit(1))
    per = C.coverage_per_run(C.report_counters(reports)).collect()[0]
    assert (per.line_missed, per.line_covered, per.line_total, per.line_percent) == (2, 6, 8, 75.0)


def test_source_tree_and_corpus_sink(spark):
    root = tempfile.mkdtemp(prefix="runlens-src-")
    _write(root, "repoA/src/B.java", "class B {}")
    _write(root, "repoA/src/A.py", "print(1)")
    _write(root, "repoA/.git/x.py", "hidden dir")
    _write(root, "repoA/src/.h.py", "hidden file")
    _write(root, "repoA/src/C.JAVA", "upper ext")
    _write(root, "repoA/src/bad.py", b"\xff\xfe", mode="wb")
    files = S.scan_source_tree(spark, root, extensions=CO.DEFAULT_EXTENSIONS)
    assert files.count() == 3          # hidden paths and C.JAVA are never read
    assert S.scan_source_tree(spark, root).count() == 6
    _write(root, "repoB/_int/__init__.py", "")
    _write(root, "repoB/_util.py", "x")
    assert sorted(r.rel_path for r in S.scan_source_tree(spark, root, CO.DEFAULT_EXTENSIONS).where("repo = 'repoB'").collect()) == [
        "_int/__init__.py", "_util.py"]
    pieces = CO.corpus_pieces(files)
    lay = sorted(CO.corpus_layout(pieces).collect(), key=lambda r: r.offset)
    assert [os.path.basename(r.path) for r in lay] == ["A.py", "B.java"]
    expected = "\n".join(r.piece for r in lay)
    assert lay[1].offset == len(lay[0].piece) + 1
    assert expected.startswith("\n--- File: ") and "print(1)" in expected
    out = tempfile.mkdtemp(prefix="runlens-corpus-") + "/c"
    CO.write_corpus(pieces, out)
    d = os.path.join(out, "repo=repoA")
    text = "".join(open(os.path.join(d, f)).read() for f in sorted(os.listdir(d)) if f.startswith("part-"))
    assert text == expected + "\n"


def test_experiment_path(spark):
    df = spark.createDataFrame([("data/experiments/2025-03-04/05-06-07-brave-turing",), ("nope",)], "p string")
    rows = df.select(*S.parse_experiment_path("p")).collect()
    assert str(rows[0].run_ts) == "2025-03-04 05:06:07" and rows[0].run_name == "brave-turing"
    assert rows[1].run_ts is None and rows[1].run_name is None


def test_progress_stream_resumes(spark):
    src = tempfile.mkdtemp(prefix="runlens-stream-")
    spark.createDataFrame([("SUCCESS",), ("FAIL",)], "status string").write.mode("append").parquet(src)
    ck = tempfile.mkdtemp(prefix="runlens-stream-ck-")
    out = ck + "/out"
    got = {r.status: r.finished for r in progress_counts(spark, src, "status string", "status",
                                                          out_dir=out, checkpoint=ck + "/cp").collect()}
    assert got == {"SUCCESS": 1, "FAIL": 1}
    spark.createDataFrame([("SUCCESS",)], "status string").write.mode("append").parquet(src)
    got = {r.status: r.finished for r in progress_counts(spark, src, "status string", "status",
                                                          out_dir=out, checkpoint=ck + "/cp").collect()}
    assert got == {"SUCCESS": 2, "FAIL": 1}


def test_report_sinks(spark):
    import json
    from runlens.operators import runs as R
    out = tempfile.mkdtemp(prefix="runlens-sinks-")
    f = R.funnel(spark.createDataFrame([(True, True, True)], "has_result boolean, build_success boolean, "
                                                               "test_success boolean"))
    S.write_funnel(f, out + "/funnel")
    rows = [json.loads(x) for p in os.listdir(out + "/funnel") if p.endswith(".json")
            for x in open(os.path.join(out, "funnel", p))]
    assert sorted(r["stage"] for r in rows) == ["compile", "overall", "run_job", "test"]
    g = spark.createDataFrame([(1, "a/b", "SUCCESS", None, 1.0, 1.0, 0.0, True)],
                              "run_id long, repo string, status string, error string, cov_before double, "
                              "cov_after double, cov_percent_change double, cov_guard_pass boolean")
    S.write_guard_report(g, C.guard_summary(g), out + "/guard")
    assert spark.read.parquet(out + "/guard/repo_results").count() == 1
    assert spark.read.json(out + "/guard/summary").collect()[0].cov_guard_pass_rate == 1.0
    S.write_nested_results(g.select("repo", F.struct("status", "cov_before").alias("r")), out + "/nested")
    assert spark.read.json(out + "/nested").collect()[0].r.status == "SUCCESS"


def test_agent_log_lines_from_files(spark, monkeypatch):
    from runlens.operators import agentlog
    from runlens.sources import tree
    root = tempfile.mkdtemp(prefix="runlens-logs-")
    bar = "━" * 10
    log = "\n".join(["╭── New run ──╮", "│ task │"] +
                    [f"{bar} Step {i} {bar}\nExecution logs:\n" + "x" * 50 + f"\nOut: {i}" for i in range(1, 300)])
    _write(root, "own_a/stdout.log", log + "\n")
    # Small splits force one log over several tasks.
    monkeypatch.setattr(S, "read_tree_lines", lambda files, root: tree.read_tree_lines(files, root, 4096))
    got = agentlog.parse_agent_log_lines(S.read_agent_log_lines(spark, root), n_ranges=4)
    rows = sorted((r.step_pos, r.out, r.execution_logs) for r in got.collect())
    assert rows == [(i - 1, str(i), "x" * 50) for i in range(1, 300)]


def test_run_artifact_scan_roots(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="runlens-empty-")
    df = S.scan_run_artifacts(spark, root)
    assert df.count() == 0 and "migration_result" in df.columns
    with pytest.raises(FileNotFoundError):
        S.scan_run_artifacts(spark, root + "/missing")


def test_one_bad_result_fails_its_own_run(spark):
    root = tempfile.mkdtemp(prefix="runlens-bad-")
    roots = []
    for exp, text in (("a", "run_success: true\nbuild_result: {build_success: true}\n"), ("b", "run_success: [oops")):
        jr = os.path.join(root, exp, "job_results")
        roots.append(jr)
        for name, data in (("result.yaml", text), ("build.log", ""), ("stdout.log", "s"), ("diff.patch", "")):
            _write(jr, f"_own_r/{name}", data)
    _write(roots[0], "own_bytes/result.yaml", "run_success: true\nbuild_result: {build_success: true}\n")
    for name in ("build.log", "stdout.log", "diff.patch"):
        _write(roots[0], f"own_bytes/{name}", b"\xff", mode="wb")
    _write(roots[0], "own_type/result.yaml", "run_success: 7\n")
    _write(roots[0], "own_nothing/other.txt", "x")
    rows = {(os.path.basename(r.experiment), r.repo_dir): r for r in S.scan_run_artifacts(spark, roots).collect()}
    assert set(rows) == {("a", "_own_r"), ("b", "_own_r"), ("a", "own_bytes"), ("a", "own_type"), ("a", "own_nothing")}
    assert not rows["a", "own_nothing"].has_result_file and rows["a", "own_nothing"].migration_result is None
    assert rows["a", "own_bytes"].build_result.build_success is True and rows["a", "own_bytes"].stdout is None
    assert rows["a", "_own_r"].problem is None and rows["a", "_own_r"].migration_result.build_log == ""
    for key, start in ((("b", "_own_r"), "result.yaml: "), (("a", "own_bytes"), "build.log: "), (("a", "own_type"), "result.yaml: ")):
        assert rows[key].problem.startswith(start) and rows[key].migration_result is None


def test_one_repository_in_two_experiments_is_two_runs(spark):
    from runlens.operators import agentlog
    root = tempfile.mkdtemp(prefix="runlens-two-")
    bar = "━" * 10
    for exp in ("a", "b"):
        _write(root, f"{exp}/job_results/own_r/stdout.log", f"New run {exp}\n{bar} Step 1 {bar}\nOut: {exp}1\n{bar} Step 2 {bar}\nOut: {exp}2")
    _write(root, "_c/job_results/_own/stdout.log", f"{bar} Step 5 {bar}\r\nOut: c\r\n")
    _write(root, "_c/job_results/empty/stdout.log", "")
    got = agentlog.parse_agent_log_lines(S.read_agent_log_lines(spark, root), n_ranges=3).collect()
    assert sorted((r.run_id, r.step_pos, r.out, r.run_header) for r in got) == [
        ("_c/_own", 0, "c", None), ("a/own_r", 0, "a1", "New run a"), ("a/own_r", 1, "a2", "New run a"),
        ("b/own_r", 0, "b1", "New run b"), ("b/own_r", 1, "b2", "New run b")]


def test_line_splits_keep_every_line_once(spark):
    from runlens.sources.tree import list_tree, read_tree_lines
    root = tempfile.mkdtemp(prefix="runlens-splits-")
    lines = ["", "a", "é" * 40, "", "x" * 3, "last"]
    for name, end in (("with.txt", "\n"), ("without.txt", "")):
        _write(root, name, "\n".join(lines) + end)
    _write(root, "_empty.txt", "")
    for size in (1, 2, 7, 50, 10_000):
        got = {}
        for r in read_tree_lines(list_tree(spark, root), root, split_bytes=size).collect():
            got.setdefault(r.rel, []).append((r.pos, r.line))
        assert set(got) == {"with.txt", "without.txt"}
        for rows in got.values():
            assert [x for _, x in sorted(rows)] == lines


def test_run_records_of_other_experiments_stay(spark):
    out = tempfile.mkdtemp(prefix="runlens-k1-two-") + "/runs"
    ddl = "experiment string, repo string, migration_result struct<stdout:string, diff:string, build_log:string>"
    for rows in ([("a", "r1"), ("a", "r2"), ("b", "r1")], [("a", "r3")]):
        S.write_run_records(spark.createDataFrame([(e, r, ("", "", "")) for e, r in rows], ddl), out)
    assert sorted((r.experiment, r.repo) for r in S.read_stored_results(spark, out).collect()) == [("a", "r3"), ("b", "r1")]


def test_pre_coverage_by_name(spark):
    import pytest
    root = tempfile.mkdtemp(prefix="runlens-csv2-")
    p = _write(root, "cov.csv", "idx,percent_before,repo\n0,1,own_a\n1,,own_b\n2,N/A,own_c\n3,2.5,own_a\n")
    got = {r.repo: r.percent_before for r in S.read_pre_coverage(spark, p).collect()}
    assert got["own/a"] == 2.5 and got["own/b"] != got["own/b"] and got["own/c"] != got["own/c"]
    with pytest.raises(ValueError, match="percent_before"):
        S.read_pre_coverage(spark, _write(root, "no.csv", "repo,x\nown_a,1\n"))
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        S.read_pre_coverage(spark, _write(root, "text.csv", "repo,percent_before\nown_a,much\n")).collect()


def test_progress_restart_without_new_files(spark):
    src, ck = tempfile.mkdtemp(prefix="runlens-stream-"), tempfile.mkdtemp(prefix="runlens-stream-ck-") + "/cp"
    run = lambda: {r.status: r.finished for r in progress_counts(spark, src, "status string", "status", checkpoint=ck).collect()}
    assert run() == {}
    spark.createDataFrame([("SUCCESS",), ("FAIL",)], "status string").write.mode("append").parquet(src)
    assert run() == {"SUCCESS": 1, "FAIL": 1}
    assert run() == {"SUCCESS": 1, "FAIL": 1}


def test_guard_report_may_replace_the_one_it_read(spark):
    out = tempfile.mkdtemp(prefix="runlens-k3-")
    ddl = "run_id long, repo string, status string, error string, cov_before double, cov_after double, cov_percent_change double, cov_guard_pass boolean"
    rows = spark.createDataFrame([(1, "a/b", "SUCCESS", None, 1.0, 1.0, 0.0, True), (2, "a/c", "FAIL", "x", None, None, None, None)], ddl)
    S.write_guard_report(rows, C.guard_summary(rows), out)
    back = S.read_stored_results(spark, out + "/repo_results")
    S.write_guard_report(back, C.guard_summary(back), out)
    assert S.read_stored_results(spark, out + "/repo_results").count() == 2


def test_source_tree_query_scans_every_document(spark):
    from conftest import SF_SMALL
    from runlens.plans.q_corpus import _files_written
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    tree = S.scan_source_tree(spark, _files_written(spark, SF_SMALL), CO.DEFAULT_EXTENSIONS).collect()
    got = {(r.repo, r.rel_path): bytes(r.content) for r in tree}
    want = {(f"r{d.doc_id // 16 % 50}", f"pkg{d.doc_id // 16}/_d{d.doc_id}.py"): d.text.encode() for d in docs}
    want |= {(f"r{d.doc_id // 16 % 50}", f"pkg{d.doc_id // 16}/__init__.py"): b"" for d in docs}
    assert got == want and len(tree) == len(got)


def test_tree_is_listed_in_rounds(spark, monkeypatch):
    """More entries than a task lists: the rest goes to the next round; folders that cannot match are not opened."""
    from runlens.sources import tree
    root = tempfile.mkdtemp(prefix="runlens-rounds-")
    want = set()
    for i in range(40):
        for rel in (f"r{i}/target/site/jacoco/jacoco.xml", f"r{i}/m/target/site/jacoco-aggregate/jacoco.xml", f"r{i}/target/site/other/jacoco.xml",
                    f"r{i}/_a/.b/empty.txt"):
            _write(root, rel, "" if rel.endswith("txt") else "x")
            want.add(rel)
    for entries in (1, 7, 10_000):
        monkeypatch.setattr(tree, "TASK_ENTRIES", entries)
        assert {r.rel for r in tree.list_tree(spark, root).collect()} == want
        got = {r.rel for r in tree.list_tree(spark, root, "**/target/site/jacoco*/jacoco.xml").collect()}
        assert got == {w for w in want if "/jacoco" in w.removesuffix("/jacoco.xml")}
    p = tree.PathPattern("r*/target/site/*.xml")
    assert p.may_hold("r1") and p.may_hold("r1/target") and not p.may_hold("x") and not p.may_hold("r1/src") and not p.may_hold("r1/target/site/a")
    assert p.is_file("r1/target/site/a.xml") and not p.is_file("r1/a.xml")
    closed = os.path.join(root, "r0", "_a")
    os.chmod(closed, 0)                                          # a branch that cannot match
    try:
        assert tree.list_tree(spark, root, "*/target/site/*/jacoco.xml").count() == 80
    finally:
        os.chmod(closed, 0o700)


def test_commit_date_in_another_zone(spark):
    root = tempfile.mkdtemp(prefix="runlens-zone-")
    _write(root, "full_dataset.yaml", "- repo_name: a/b\n  commit_date: '2024-01-02T12:00:00+00:00'\n- repo_name: c/d\n- repo_name: e/f\n"
                                      "  commit_date: 2024-07-02T12:00:00+02:00\n")
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        got = S.read_manifests(spark, root).orderBy("ordinal").select(F.unix_timestamp("commit_date").alias("t")).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
    assert [r.t for r in got] == [1704196800, None, 1719914400]


def _manifest_folder(files: dict[str, bytes]) -> str:
    root = tempfile.mkdtemp(prefix="runlens-manifests-")
    for name, content in files.items():
        with open(os.path.join(root, name), "wb") as f:
            f.write(content)
    return root


def _items_of(spark, root, split_bytes):
    got = S.read_manifest_items(spark, root, split_bytes=split_bytes)
    return {(os.path.basename(r.source_file), r.ordinal): (r.repo_name, r.commit, r.license, r.test_count and r.test_count.tests_run, r.problem)
            for r in got.collect()}


@pytest.mark.parametrize("split_bytes", [7, 64, 1 << 20])
def test_manifest_items_equal_the_whole_file(spark, split_bytes):
    item = "- repo_name: own/r{0}\n  commit: '{0}'\n\n  # note\n  license: |\n    one\n    - two\n  test_count:\n    tests_run: {0}\n"
    root = _manifest_folder({
        "plain.yaml": ("# head\n---\n" + "".join(item.format(i) for i in range(30))).encode(),
        "alias.yaml": b"- repo_name: &n own/a\n  commit: c\n- repo_name: *n\n  commit: d\n",
        "flow.yaml": b"[{repo_name: x, commit: y},\n {repo_name: z}]\n", "crlf.yaml": b"- repo_name: a\r\n  commit: b\r\n- repo_name: c\r\n",
        "indented.yaml": b"  - repo_name: i\n  - repo_name: j\n", "bare.yaml": b"-\n  repo_name: k\n- repo_name: l", "empty.yaml": b"", "note.yaml": b"# none\n"})
    got = _items_of(spark, root, split_bytes)
    want = {(os.path.basename(r.source_file), r.ordinal): (r.repo_name, r.commit, r.license, r.test_count and r.test_count.tests_run, None)
            for r in S.read_manifests(spark, root).collect()}
    assert got == want and len(got) == 30 + 2 + 2 + 2 + 2 + 2


def test_manifest_items_that_cannot_be_read(spark):
    root = _manifest_folder({
        "m.yaml": b"- repo_name: a\n- repo_name: [b\n  commit: x\n- text\n- repo_name: \xff\n- repo_name: e\n  test_count: 5\n- repo_name: f\n",
        "whole.yaml": b"repo_name: a\n", "bytes.yaml": b"repo_name: \xff\n"})
    got = _items_of(spark, root, 16)
    assert {k: v[0] for k, v in got.items() if v[4] is None} == {("m.yaml", 0): "a", ("m.yaml", 5): "f"}
    assert {k for k, v in got.items() if v[4]} == {("m.yaml", i) for i in (1, 2, 3, 4)} | {("whole.yaml", None), ("bytes.yaml", None)}


def test_one_manifest_fills_many_tasks(spark):
    root = _manifest_folder({"big.yaml": b"".join(b"- repo_name: own/r%d\n  commit: c\n" % i for i in range(3000))})
    lines = T.read_tree_lines(T.list_tree(spark, root, "**/*.yaml"), root, 4096)
    assert lines.select(F.spark_partition_id()).distinct().count() > 1
    got = _items_of(spark, root, 4096)
    assert {k[1]: v[0] for k, v in got.items()} == {i: f"own/r{i}" for i in range(3000)}


def test_experiment_store(spark):
    out = tempfile.mkdtemp(prefix="runlens-experiments-") + "/store"
    rows = [("p/2025-03-04/05-06-07-a", 1), ("p/2025-03-04/09-06-07-b", 2), ("odd", 3), (None, 4), ("p/2025-13-04/05-06-07-c", 5)]
    S.write_experiment_runs(spark.createDataFrame(rows, "experiment string, run_id long"), out)
    S.write_experiment_runs(spark.createDataFrame([("p/2025-03-04/09-06-07-b", 6)], "experiment string, run_id long"), out)
    store = S.read_experiment_runs(spark, out)
    assert {(r.experiment, r.run_id, str(r.run_date)) for r in store.collect()} == {
        ("p/2025-03-04/05-06-07-a", 1, "2025-03-04"), ("p/2025-03-04/09-06-07-b", 6, "2025-03-04"), ("odd", 3, S.NO_DATE),
        ("", 4, S.NO_DATE), ("p/2025-13-04/05-06-07-c", 5, S.NO_DATE)}
    named = spark.createDataFrame([("odd", 1), ("odd", 2), ("p/2025-03-04/05-06-07-a", 1), (None, 1), ("gone", 1)], "experiment string, n int")
    assert sorted(r.run_id for r in S.experiment_window(store, named).collect()) == [1, 3, 4]


def test_progress_latest_over_restarts(spark):
    schema = "run string, at int, status string"
    src, ck = tempfile.mkdtemp(prefix="runlens-latest-"), tempfile.mkdtemp(prefix="runlens-latest-ck-") + "/cp"

    def portion(*rows):
        if rows:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = progress_latest(spark, src, schema, "run", ["at"], checkpoint=ck)
        assert got.columns == ["run", "at", "status"]
        return {r.run: (r.at, r.status) for r in got.collect()}, {r.status: r.finished for r in latest_counts(got, "status").collect()}

    assert portion() == ({}, {})
    first = portion(("a", 2, "FAIL"), ("b", 1, "SUCCESS"), (None, 1, "FAIL"))
    assert first == ({"a": (2, "FAIL"), "b": (1, "SUCCESS"), None: (1, "FAIL")}, {"FAIL": 2, "SUCCESS": 1})
    assert portion(("a", 1, "SUCCESS"), ("b", 1, "SUCCESS"), ("b", None, "FAIL")) == first      # late, repeated, without a time
    assert portion() == first
    assert portion(("a", 3, "SUCCESS"), ("a", 3, "SKIP"))[0]["a"] == (3, "SUCCESS")             # a tie: the greater one


def test_progress_latest_runs_a_batch_again(spark):
    src, ck = tempfile.mkdtemp(prefix="runlens-again-"), tempfile.mkdtemp(prefix="runlens-again-ck-") + "/cp"
    run = lambda: {r.run: r.status for r in progress_latest(spark, src, "run string, status string", "run", ["status"], checkpoint=ck).collect()}
    for rows in ([("a", "1"), ("b", "1")], [("a", "2"), ("c", "1")]):
        spark.createDataFrame(rows, "run string, status string").write.mode("append").parquet(src)
        before = run()
    commits = f"{ck}/commits"
    for name in [n for n in os.listdir(commits) if n.strip(".").startswith("1")]:      # as if the run had failed after its sink had written
        os.remove(os.path.join(commits, name))
    assert run() == before == {"a": "2", "b": "1", "c": "1"}


@pytest.mark.parametrize("split_bytes", [4, 7, 64 << 10])
def test_corpus_of_split_files_equals_whole_files(spark, split_bytes):
    """Splits end at characters, empty files count, a bad byte in any split drops the file, hidden and other files are not read."""
    root = tempfile.mkdtemp(prefix="runlens-splits-")
    long = 200_000 if split_bytes > 100 else 50
    texts = {"hot/a.py": "aé€😀\n" * long, "hot/b.py": "", "hot/sub/c.py": "x\r\ny", "cold/z.java": "日本", "cold/😀.py": "ü"}
    for rel, text in texts.items():
        _write(root, rel, text)
    _write(root, "hot/.git/d.py", "hidden")
    _write(root, "hot/e.txt", "no code")
    body = b"good text " * long
    for name, bad in {"first": b"\xff" + body, "last": body + b"\xe2\x82", "middle": body + b"\xff" + body, "stray": b"\x80" * 9 + body}.items():
        os.makedirs(f"{root}/cold", exist_ok=True)
        with open(f"{root}/cold/{name}.py", "wb") as f:
            f.write(bad)
    got = CO.corpus_tree_layout(spark, root, shown_root="/w", split_bytes=split_bytes).collect()
    for repo in ("hot", "cold"):
        whole = "\n".join(f"\n--- File: /w/{rel} ---\n{text}" for rel, text in sorted(texts.items()) if rel.startswith(repo + "/"))
        mine = sorted((r for r in got if r.repo == repo), key=lambda r: (r.path, r.start))
        assert [r.piece for r in mine] == [whole[r.offset:r.offset + r.piece_chars] for r in mine]
        assert sum(r.piece_chars for r in mine) == len(whole) - (len({r.path for r in mine}) - 1)
    assert len(got) > len(texts) + 5
    assert {r.path for r in got} == {f"/w/{rel}" for rel in texts}
    empty = tempfile.mkdtemp(prefix="runlens-splits-")
    assert CO.corpus_tree_layout(spark, empty).count() == 0


def test_usual_times_of_manifests_need_no_guess(monkeypatch):
    import pandas as pd
    from datetime import datetime, timedelta, timezone
    usual = ["2023-11-15T00:13:20+02:00", "2024-02-29 12:00:00", "1969-12-31T23:59:59-14:59", datetime(2023, 1, 2, 3),
             datetime(2023, 1, 2, 3, 4, 5, 678901, tzinfo=timezone(timedelta(hours=-5)))]
    general = pd.to_datetime
    for odd in ("2024-02-29T12:00:00Z", "2023-11-15", "15 Nov 2023", 5):
        assert S._as_time(odd) == general(odd, utc=True)
    for wrong in ("2023-02-30T00:00:00", "2023-11-15T24:00:00", "soon", datetime(1500, 1, 1)):
        with pytest.raises(ValueError) as said:
            general(wrong, utc=True)
        with pytest.raises(ValueError) as again:
            S._as_time(wrong)
        assert str(again.value) == str(said.value)
    monkeypatch.setattr(pd, "to_datetime", None)
    got = [S._as_time(v) for v in usual]
    monkeypatch.undo()
    assert got == [general(v, utc=True) for v in usual]


def test_artifact_folders_are_handed_on_in_batches(tmp_path):
    import pyarrow as pa
    root = str(tmp_path / "exp" / "job_results")
    for i in range(S.ARTIFACT_BATCH_ROWS // 2):
        (tmp_path / "exp" / "job_results" / f"a_{i}").mkdir(parents=True)
    (tmp_path / "exp" / "job_results" / "a_1" / "build.log").write_bytes(b"log")
    names = [f"a_{i}" for i in range(S.ARTIFACT_BATCH_ROWS // 2)] * 3
    given = pa.RecordBatch.from_arrays([pa.array([root] * len(names)), pa.array(names)], names=["root", "repo_dir"])
    got = list(S._read_artifacts(iter([given]), [root]))
    assert [b.num_rows for b in got] == [S.ARTIFACT_BATCH_ROWS, S.ARTIFACT_BATCH_ROWS // 2]
    rows = [r for b in got for r in b.to_pylist()]
    assert [r["repo_dir"] for r in rows] == names and {r["experiment"] for r in rows} == {str(tmp_path / "exp")}
    assert [r["build_log"] for r in rows[:2]] == [None, b"log"] and {r["result_yaml"] for r in rows} == {None}


def test_texts_of_splits_are_handed_on_in_small_batches(tmp_path):
    """A task holds a few megabytes of decoded texts, however many splits it is given."""
    import pyarrow as pa
    text = "é" * (1 << 19)
    for i in range(16):
        (tmp_path / f"f{i}").write_text(text, encoding="utf-8")
    given = pa.RecordBatch.from_arrays([pa.array([f"f{i}" for i in range(16)]), pa.array([0] * 16, type=pa.int64())], names=["rel", "start"])
    got = list(T._split_batches(iter([given]), str(tmp_path), 2 << 20, "text", pa.string(), str))
    assert max(b.num_rows for b in got) << 20 <= T.TEXT_BATCH_BYTES
    assert [(r["rel"], r["text"] == text) for b in got for r in b.to_pylist()] == [(f"f{i}", True) for i in range(16)]
