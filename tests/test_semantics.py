"""Golden tests for the semantics that a naive translation gets wrong."""
import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import maven as M
from runlens.functions import text as T
from runlens.functions import xml as X
from runlens.operators import buildlog, coverage as C, descriptor as D, patch as P, runs


def one(spark, col, value, ddl="string"):
    return spark.createDataFrame([(value,)], f"v {ddl}").select(col.alias("r")).collect()[0].r


# 2.12.1 nulls in the funnel
def test_funnel_null_is_failure_and_test_without_build(spark):
    df = spark.createDataFrame(
        [(True, True, True), (True, None, True), (True, False, None), (False, None, None)],
        "has_result boolean, build_success boolean, test_success boolean")
    got = {r.stage: (r.started, r.succeeded) for r in runs.funnel(df).collect()}
    assert got == {"run_job": (4, 3), "compile": (3, 1), "test": (1, 2), "overall": (4, 2)}


# 2.12.4 / 2.12.5 division by zero and NaN in the guard
def test_coverage_change_zero_and_nan(spark):
    df = spark.createDataFrame([(0.0, 50.0), (float("nan"), 50.0), (50.0, 47.5), (50.0, 47.6), (40.0, 50.0)],
                               "b double, a double")
    ch, ok = C.coverage_change(F.col("b"), F.col("a"))
    rows = df.select(ch.alias("c"), ok.alias("ok")).collect()
    assert rows[0].c is None
    assert math.isnan(rows[1].c) and rows[1].ok is False
    assert rows[2].ok is False            # exactly -0.05 fails (strict)
    assert rows[3].ok is True and rows[4].ok is True


def test_guard_cascade_and_summary(spark):
    cands = spark.createDataFrame([
        (1, "o/a", False, None, True), (2, "o/b", True, False, True), (3, "o/c", True, True, False),
        (4, "o/d", True, True, True), (5, "o/e", True, True, True), (6, "o/f", True, True, True),
        (7, "o/g", True, True, True), (8, "o/h", True, True, True)],
        "run_id long, repo string, has_result boolean, test_success boolean, has_patch boolean")
    stored = spark.createDataFrame([(8, "o/h", 50.0, 60.0, 0.2, True)],
                                   "run_id long, repo string, cov_before double, cov_after double, "
                                   "cov_percent_change double, cov_guard_pass boolean")
    after = spark.createDataFrame([(5, 40.0), (6, 40.0), (7, 40.0), (8, 1.0)], "run_id long, line_percent double")
    pre = spark.createDataFrame([("o/d", 10.0), ("o/e", 0.0), ("o/g", 50.0)], "repo string, percent_before double")
    rows = {r.run_id: r for r in C.guard_rows(cands, stored, after, pre).collect()}
    assert [rows[i].status for i in range(1, 9)] == ["FAIL", "SKIP", "FAIL", "FAIL", "FAIL", "FAIL", "SUCCESS", "SKIP"]
    assert rows[1].error == "'NoneType' object is not subscriptable"
    assert rows[4].error == "Failed calculating coverage"
    assert rows[5].error == "float division by zero"
    assert rows[6].error == "'o/f'"
    assert rows[7].cov_guard_pass is False and rows[8].cov_guard_pass is True
    s = C.guard_summary(C.guard_rows(cands, stored, after, pre)).collect()[0]
    assert (s.passed, s.total, s.cov_guard_pass_rate, s.job_fails) == (1, 2, 0.5, 5)


def test_guard_resume_repeated_keys_and_patch_errors(spark):
    cands = spark.createDataFrame([(i, f"o/{i}", True, True, True, "no way" if i == 3 else None) for i in range(1, 6)],
                                  "run_id long, repo string, has_result boolean, test_success boolean, has_patch boolean, patch_error string")
    ddl = "run_id long, repo string, status string, error string, cov_before double, cov_after double, cov_percent_change double, cov_guard_pass boolean"
    stored = spark.createDataFrame([(1, "o/1", "SUCCESS", None, 50.0, 60.0, 0.2, True), (1, "o/1", "SUCCESS", None, 50.0, 60.0, 0.2, True),
                                    (2, "o/2", "FAIL", "x", None, None, None, None), (9, "o/9", "SUCCESS", None, 1.0, 1.0, 0.0, True)], ddl)
    after = spark.createDataFrame([(i, 40.0) for i in range(1, 6)], "run_id long, line_percent double")
    pre = spark.createDataFrame([(f"o/{i}", 80.0 if n == 0 else 40.0, n) for i in range(1, 5) for n in (1, 0)], "repo string, percent_before double, n int")
    rows = [(r.run_id, r.status, r.error, r.cov_before) for r in C.guard_rows(cands, stored, after, pre, pre_order="n").orderBy("run_id").collect()]
    assert rows == [(1, "SKIP", None, 50.0), (2, "SUCCESS", None, 40.0), (3, "FAIL", "Failed applying patch: no way", None),
                    (4, "SUCCESS", None, 40.0), (5, "FAIL", "'o/5'", None)]


def test_strip_is_linear_and_like_python(spark):
    import time
    s = " \t\x1c\u2003 a" + " " * 1_000_000 + "b\u00a0\x85\n"
    t = time.time()
    assert one(spark, T.py_strip(F.col("v")), s) == s.strip()
    framed = "╰──" + " ─" * 500_000 + "x─"
    assert one(spark, T.py_strip_chars(F.col("v"), "╰─"), framed) == framed.strip("╰─")
    assert time.time() - t < 20
    spaces = "".join(chr(i) for i in range(0x3100) if chr(i).isspace())
    assert one(spark, T.py_strip(F.col("v")), spaces + "x" + spaces) == "x"
    assert one(spark, T.line_view(F.col("v"), 1, -2), "a\nb") is None


@pytest.mark.parametrize("section,path", [
    ("diff --git a/x.java b/x.java\nindex 1..2\n--- a/x.java\n+++ b/x.java\n@@ -1 +1 @@\n+++ b/other", "x.java"),
    ("diff --git a/d b/e.txt b/d b/e.txt\nold mode 1\nnew mode 2", "d b/e.txt"),
    ("diff --git a/old.txt b/new.txt\nsimilarity index 90%\nrename from old.txt\nrename to new.txt", "new.txt"),
    ("diff --git a/gone.jar b/gone.jar\ndeleted file mode 1\n--- a/gone.jar\n+++ /dev/null\n@@ -1 +0,0 @@", "gone.jar"),
    ('diff --git "a/t\\303\\274r \\"q\\".java" "b/t\\303\\274r \\"q\\".java"\n--- "a/t\\303\\274r \\"q\\".java"\n+++ "b/t\\303\\274r \\"q\\".java"\n@@ -1 +1 @@',
     'tür "q".java'),
    ('diff --git "a/tab\\there.txt" "b/tab\\there.txt"\nnew file mode 1', "tab\there.txt"),
])
def test_patch_paths(spark, section, path):
    df = spark.createDataFrame([(1, section)], "id long, diff string")
    assert [r.file for r in P.changed_files(df).collect()] == [path]


# 2.12.6 every "Tests run" line is summed; NULL when none
def test_test_counters_sum_all_matches(spark):
    log = "Tests run: 3, Failures: 1, Errors: 0, Skipped: 0\nTests run: 3, Failures: 1, Errors: 0, Skipped: 0\n"
    r = one(spark, M.test_counters(F.col("v")), log)
    assert (r.tests_run, r.failures, r.errors, r.skipped) == (6, 2, 0, 0)
    assert one(spark, M.test_counters(F.col("v")), "no tests") is None
    big = one(spark, M.test_counters(F.col("v")), "Tests run: 99999999999, Failures: 0, Errors: 0, Skipped: 0")
    assert big.tests_run == 99999999999


# 2.12.11 cascade order
@pytest.mark.parametrize("log,code", [
    ("no marker BUILD SUCCESS", 0),
    ("Scanning for projects COMPILATION ERROR BUILD SUCCESS", 1),
    ("Scanning for projects Tests are skipped. BUILD SUCCESS", 10),
    ("Scanning for projects BUILD SUCCESS Tests run", 3),
    ("Scanning for projects Malformed POM COMPILATION ERROR", 9),
    ("Scanning for projects Failed to execute goal BUILD FAILURE", 7),
    ("Scanning for projects BUILD FAILURE", 5),
    ("Scanning for projects", 6),
])
def test_maven_status_cascade(spark, log, code):
    assert one(spark, M.maven_status_code(F.col("v")), log) == code


def test_build_verdict_text_form(spark):
    v = lambda c, t, b=False: spark.createDataFrame([(c, t, b)], "c string, t string, b boolean").select(
        M.build_verdict("c", "t", "b").alias("r")).collect()[0].r
    fail = "[ERROR] Failed to execute goal org.apache.maven.plugins:maven-compiler-plugin:3.1:compile (x)"
    assert (v(fail, "").build_success, v(fail, "").test_success) == (False, None)
    assert (v("[FATAL] x", "").build_success, v("ok", "", True).test_success) == (False, None)
    r = v("ok", "BUILD SUCCESS BUILD FAILURE Tests run: 1, Failures: 0, Errors: 0, Skipped: 0")
    assert (r.build_success, r.test_success, r.test_results.tests_run) == (True, True, 1)
    assert v("ok", "[FATAL] boom").test_success is False
    assert v("ok", "nothing").test_success is None


def test_build_verdict_line_form_matches_text_form(spark):
    lines = spark.createDataFrame([
        (1, "compile", "[INFO] BUILD SUCCESS"), (1, "test", "Tests run: 2, Failures: 0, Errors: 1, Skipped: 0"),
        (1, "test", "[INFO] BUILD FAILURE"), (2, "compile", "[INFO] BUILD FAILURE"),
        (3, "compile", "fine")], "run_id long, kind string, line string")
    rs = spark.createDataFrame([(1, False), (2, False), (3, True), (4, False)], "run_id long, build_only boolean")
    got = {r.run_id: r for r in buildlog.attach_verdict(rs, buildlog.verdict_inputs(lines)).collect()}
    assert (got[1].build_success, got[1].test_success, got[1].tests_run, got[1].errors) == (True, False, 2, 1)
    assert (got[2].build_success, got[2].test_success) == (False, None)
    assert (got[3].build_success, got[3].test_success) == (True, None)
    assert (got[4].build_success, got[4].test_success, got[4].tests_run) == (True, None, None)


# 2.12.12 / F22 splitlines like Python
@pytest.mark.parametrize("s", ["", "a", "a\n", "a\n\n", "\n", "a\r\nb\rc\x0bd\x0ce\x1cf\x85g h i", "x\x1fy"])
def test_splitlines_like_python(spark, s):
    assert one(spark, T.splitlines(F.col("v")), s) == s.splitlines()


# 2.12.17 strip like Python
@pytest.mark.parametrize("s", ["  a b \t", " x　", "\x1cy\x1f", "\n\n", ""])
def test_py_strip(spark, s):
    assert one(spark, T.py_strip(F.col("v")), s) == s.strip()


# 2.12.21 collapse_middle
@pytest.mark.parametrize("s,n", [("abcdefghij", 5), ("abcdefghij", 4), ("abc", 4), ("a" * 101, 100), (None, 100)])
def test_collapse_middle(spark, s, n):
    def ref(x, m):
        if x is None:
            return "None"
        if len(x) <= m:
            return x
        ks = (m - 3) // 2
        return x[:ks] + "..." + x[-(m - 3 - ks):]
    assert one(spark, T.collapse_middle(F.col("v"), n), s) == ref(s, n)
    with pytest.raises(ValueError):
        T.collapse_middle(F.col("v"), 3)


def test_strip_ansi_idempotent(spark):
    s = "\x1b[1;31mred\x1b[0m and \x1b[2Kplain"
    once = one(spark, T.strip_ansi(F.col("v")), s)
    assert once == "red and plain" and one(spark, T.strip_ansi(F.col("v")), once) == once


def test_keys_round_trip(spark):
    assert one(spark, T.recover_key(T.safe_key(F.col("v"))), "owner/re_po/x") == "owner/re_po_x"
    assert one(spark, T.recover_key(T.safe_key(F.col("v"))), "owner/repo") == "owner/repo"
    assert one(spark, T.recover_key(F.col("v")), "nounderscore") is None


@pytest.mark.parametrize("path,excluded", [
    ("src/A.java", False), ("a/target/b.txt", True), ("target", True), ("lib/X.JAR", True), ("x.Class", True),
    ("docs/.tmp", False), ("docs/a.tmp", True), ("b/out.war.bak", False), ("targets/x.java", False),
])
def test_patch_exclusion(spark, path, excluded):
    assert one(spark, P.is_excluded(F.col("v")), path) is excluded


def test_changed_files_and_filtered_patch(spark):
    diff = ("diff --git a/src/A.java b/src/A.java\n+x\n"
            "diff --git a/target/A.class b/target/A.class\n+y\n"
            "diff --git a/lib/z.jar b/lib/z.jar\n+z")
    df = spark.createDataFrame([(1, diff), (2, ""), (3, None)], "id long, diff string")
    files = sorted((r.id, r.file, r.excluded) for r in P.changed_files(df).collect())
    assert files == [(1, "lib/z.jar", True), (1, "src/A.java", False), (1, "target/A.class", True)]
    kept = dict((r.id, r.k) for r in df.select("id", P.filtered_patch("diff").alias("k")).collect())
    assert kept == {1: "diff --git a/src/A.java b/src/A.java\n+x\n", 2: "", 3: ""}


# 2.12.7 / 2.12.8 coverage XML: all depths, DOCTYPE, malformed, empty
def test_coverage_counters(spark):
    good = ('<?xml version="1.0"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd">'
            '<report><package><counter type="LINE" missed="1" covered="2"/>'
            '<class><counter type="LINE" missed="3" covered="4"/><counter type="METHOD" covered="5"/></class>'
            '</package><counter type="LINE" missed="10" covered="20"/></report>')
    df = spark.createDataFrame([(1, good), (2, good[:-5]), (3, ""), (4, "<other/>")], "id long, xml string")
    r = {x.id: x for x in C.report_counters(df).collect()}
    assert (r[1].valid, r[1].line_missed, r[1].line_covered, r[1].method_missed, r[1].method_covered) == \
        (True, 14, 26, 0, 5)
    assert r[2].valid is False and r[2].line_missed is None
    assert r[3].valid is False
    assert (r[4].valid, r[4].line_missed) == (True, 0)
    bad = spark.createDataFrame([(1, bytearray(good[:60].encode() + b"\xff" + good[60:].encode())), (2, bytearray(good.replace('"20"', '"9' + "0" * 30 + '"').encode())),
                                 (3, bytearray(good.encode())), (4, None)], "id long, xml binary")
    r = {x.id: x for x in C.report_counters(bad).collect()}
    assert [r[i].valid for i in (1, 2, 3, 4)] == [False, False, True, False] and r[3].line_missed == 14


def test_xml_check_message(spark):
    assert one(spark, X.xml_check_message(F.col("v")), "<a><b/></a>") == "XML is well-formed."
    assert one(spark, X.xml_check_message(F.col("v")), "<a>").startswith("XML is not well-formed: ")


# 2.12.9 / 2.12.10 descriptors: namespace, missing children, plugin without groupId
def test_descriptor_dependencies_aligned(spark):
    pom = ('<project xmlns="http://maven.apache.org/POM/4.0.0"><modules><module> m1 </module></modules>'
           '<dependencies><dependency><groupId>g</groupId><artifactId>a</artifactId></dependency>'
           '<dependency><groupId>g2</groupId><artifactId>a2</artifactId><version>2</version></dependency>'
           '</dependencies><build><plugins><plugin><artifactId>p</artifactId></plugin></plugins></build></project>')
    df = spark.createDataFrame([(1, pom), (2, "<project><broken>")], "id long, pom string")
    parsed = D.with_parsed(df)
    deps = sorted((r.group_id, r.artifact_id, r.version, r.where_found) for r in D.dependencies(parsed, ["id"]).collect())
    assert deps == [("g", "a", None, "direct"), ("g2", "a2", "2", "direct")]
    plugins = [(r.group_id, r.artifact_id) for r in D.plugins(parsed, ["id"]).collect()]
    assert plugins == [(None, "p")]
    assert [r.module for r in D.modules(parsed, ["id"]).collect()] == ["m1"]
    odd = D.with_parsed(spark.createDataFrame(
        [(3, "<project><modules><module></module><module>  </module><module>\n b \n</module></modules></project>"),
         (4, "<project><modules/></project>")], "id long, pom string"))
    assert [r.module for r in D.modules(odd, ["id"]).orderBy("module_pos").collect()] == ["", "b"]
    assert {r.id: r.multi_module for r in D.is_multi_module(odd, ["id"]).collect()} == {3: True, 4: True}
    flags = {r.id: (r.parsed, r.has_namespace) for r in parsed.select("id", "parsed", "has_namespace").collect()}
    assert flags == {1: (True, True), 2: (False, False)}
    policy = spark.createDataFrame([("g", "a", "1"), (None, "p", "1")], "group_id string, artifact_id string, "
                                                                          "target_version string")
    rep = D.policy_report(D.dependencies(parsed, ["id"]), policy, ["id"]).collect()
    assert [(r.group_id, r.current_version, r.where_found, r.needs_change) for r in rep] == [("g", None, "direct", True)]


def test_descriptor_elements_anywhere(spark):
    """Repeated sections, odd places, nested plugins, children of children, comments and CDATA."""
    assert [(p, t) for p, t in D.elements("<p><a><x><v>1</v><x><v>2</v></x><v>3</v></x></a></p>", "x", ("v",))] == [("/a", {"v": "1"}), ("/a/x", {"v": "2"})]
    pom = """<project xmlns="http://maven.apache.org/POM/4.0.0" note="a>b"><!-- <dependency><groupId>no</groupId></dependency> -->
      <dependencies><dependency><exclusions><exclusion><groupId>no</groupId></exclusion></exclusions><groupId> A </groupId></dependency></dependencies>
      <dependencies><dependency><groupId>B</groupId><groupId>C</groupId><version>x<!-- y -->z</version></dependency><dependency/></dependencies>
      <build><plugins><plugin><executions><execution><dependency><groupId><![CDATA[E<]]>&amp;F</groupId></dependency></execution></executions>
        <configuration><plugins><plugin><artifactId>inner</artifactId></plugin></plugins></configuration><artifactId>outer</artifactId>
      </plugin></plugins></build></project>"""
    many = "<project><dependencies>" + "".join(f"<dependency><version>{i}</version></dependency>" for i in range(9000)) + "</dependencies></project>"
    parsed = D.with_parsed(spark.createDataFrame([(1, pom), (2, "<project><dependencies><dependency></project>"), (3, None), (4, many)], "id long, pom string"))
    deps = D.dependencies(parsed, ["id"])
    assert [tuple(r)[1:4] + (r.version, r.where_found) for r in deps.where("id < 4").orderBy("dep_pos").collect()] == [
        (0, "A", None, None, "direct"), (1, "B", None, "x", "direct"), (2, None, None, None, "direct"), (3, "E<&F", None, None, "other")]
    assert [r.version for r in deps.where("id = 4").orderBy("dep_pos").collect()] == [str(i) for i in range(9000)]
    assert [(r.plugin_pos, r.artifact_id, r.where_found) for r in D.plugins(parsed, ["id"]).orderBy("plugin_pos").collect()] == [
        (0, "outer", "build"), (1, "inner", "other")]


def test_line_edit_functions(spark):
    s = "l1\nl2\nl3"
    assert one(spark, T.line_view(F.col("v"), 2, -1), s) == "l2\nl3"
    assert one(spark, T.line_view(F.col("v"), 0, 1), s) == "l1"
    assert one(spark, T.line_insert(F.col("v"), 1, "new"), s) == "l1\nnew\nl2\nl3\n"
    assert one(spark, T.line_insert(F.col("v"), 9, "new"), s) == "l1\nl2\nl3\nnew\n"
    assert one(spark, T.line_insert(F.col("v"), 0, "new"), "") == "new\n"
    py = "l1\nl2\nl3".splitlines()
    py.insert(-1, "new")
    assert one(spark, T.line_insert(F.col("v"), -1, "new"), s) == "\n".join(py) + "\n"
    assert one(spark, T.line_view(F.col("v"), 2, 2), s) == "l2"
    assert one(spark, T.line_view(F.col("v"), 3, 1), s) == ""
    assert one(spark, T.literal_replace(F.col("v"), "l.", "$1"), "l.l1") == "$1l1"


@pytest.mark.parametrize("txt,jdk,ok", [('openjdk version "17.0.2"', 17, True), ('java version "1.8.0_292"', 8, True),
                                         ('java version "1.8.0_292"', 17, False), ("no version", 17, False),
                                         ('openjdk version "21.0.1"', 17, False)])
def test_java_version(spark, txt, jdk, ok):
    assert one(spark, T.java_version_ok(F.col("v"), jdk), txt) is ok


_REGULAR = ('<?xml version="1.0" encoding="UTF-8" standalone="yes"?><!DOCTYPE report PUBLIC "-//JACOCO//DTD Report 1.1//EN" "report.dtd">'
            '<report name="a &amp; b"><sessioninfo id="é" start="1" dump="2"/><group name="g"><package name="p"><class name="A" sourcefilename="A.java">'
            '<method name="&lt;init&gt;" desc="()V" line="3"><counter type="LINE" missed="1" covered="2"/></method>'
            '<counter type="METHOD" missed="3" covered="4"/></class><sourcefile name="A.java"><line nr="1" mi="0" ci="1" mb="0" cb="0"/>'
            '<counter type="LINE" missed="10" covered="20"/></sourcefile></package></group>\n<counter type="BRANCH" missed="7" covered="7"/></report>\n')


def test_regular_reports_are_counted_without_the_parser(spark):
    """What the screen takes for regular counts as the parser counts it; what it is not sure of goes to the parser."""
    from runlens.functions import xml as X
    irregular = {
        "cut": _REGULAR[:-12], "twice": _REGULAR.replace('type="LINE"', 'type="LINE" type="LINE"', 1),
        "entity": _REGULAR.replace("&amp;", "&other;"), "markup": _REGULAR.replace("&amp;", "<"), "bare": _REGULAR.replace("&amp;", "&"),
        "control": _REGULAR.replace("&amp;", "\x01"), "crossed": _REGULAR.replace("</package></group>", "</group></package>"),
        "tail": _REGULAR + "<a/>", "gap": " " + _REGULAR, "big": _REGULAR.replace('covered="20"', 'covered="12345678901"'),
        "word": _REGULAR.replace('covered="20"', 'covered="x"'), "order": _REGULAR.replace('missed="10" covered="20"', 'covered="20" missed="10"'),
        "comment": _REGULAR.replace("<sessioninfo", '<!-- <counter type="LINE" missed="9" covered="9"/> --><sessioninfo'),
        "other": "<report><thing type='LINE' missed='1' covered='5'/></report>", "empty": "", "root": "<a/>"}
    rows = [("regular", _REGULAR.encode()), ("plain", b'<report name="r"/>'), ("deep", _REGULAR.replace("</package>", "</package>" + (
        '<package name="q">' + '<counter type="LINE" missed="1" covered="1"/>' * 50_000 + "</package>") * 4).encode())]
    rows += [(n, t.encode()) for n, t in irregular.items()] + [("null", None), ("bytes", _REGULAR.encode().replace(b"\xc3\xa9", b"\xc3"))]
    df = spark.createDataFrame([(n, bytearray(t) if t is not None else None) for n, t in rows], "name string, xml binary")
    screened = {r.name for r in df.where(X.regular_report("xml")).collect()}
    assert screened == {"regular", "plain", "deep"}
    got = {r.name: tuple(r)[1:] for r in C.report_counters(df).collect()}
    for name, xml in rows:
        message, *sums = X._count_one(xml)
        assert got[name] == (message == X.WELL_FORMED_MSG, *sums), name
    assert got["deep"] == (True, 200_011, 200_022, 3, 4) and got["order"][0] and not got["twice"][0]


def test_only_doubtful_reports_reach_the_parser(spark):
    df = spark.createDataFrame([("a", bytearray(b"<report/>"))], "name string, xml binary")
    plan = C.report_counters(df)._jdf.queryExecution().executedPlan().toString()
    asked = next(line for line in plan.splitlines() if "ArrowEvalPython" in line)
    assert "CASE WHEN NOT _regular" in asked and plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan


def test_report_texts_are_counted_before_rows_wait_for_python(spark):
    """No report text is kept beside the rows that wait for the Python workers: the counters are read below them."""
    df = spark.createDataFrame([(1, bytearray(b"<report/>"))], "run_id long, xml binary")
    plan = C.report_counters(df)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("ArrowEvalPython")
    assert below and "regexp_extract_all" in below and "regexp_extract_all" not in above


def test_attribute_values_of_regular_reports(spark):
    """Every character but markup, controls and the two non-characters may stand in a value, as if the class were negated."""
    from runlens.functions import xml as X
    codes = [*range(0, 0x300), *range(0xD7F0, 0xD800), *range(0xE000, 0xE010), *range(0xFFF0, 0x10010), 0x1F600, 0x10FFFF]
    rows = spark.createDataFrame([(c, f'<report name="a{chr(c)}&amp;{chr(c)}"/>') for c in codes], "code int, xml string")
    bad = {r.code for r in rows.where(~X.regular_report("xml")).collect()}
    assert bad == {*range(0x20), ord('"'), ord("<"), ord("&"), 0xFFFE, 0xFFFF}
