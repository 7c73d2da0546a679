"""Driver queries for the scalar text functions (F1-F3, F5-F7, F9, F18-F22, F25-F27), P1, L1."""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import maven as M
from runlens.functions import struct as ST
from runlens.functions import text as T
from runlens.operators import runs
from runlens.plans import bridges as B
from runlens.plans.catalog import register
from runlens.plans.q_builds import verdicts

# Fixed values for bridge B2: marker i of a step log (i = 10: no marker).
B2_MARKERS = [
    "Non-parseable POM", "Malformed POM", "COMPILATION ERROR",
    "Could not resolve dependencies for project", "Tests are skipped.", "BUILD SUCCESS",
    "Tests run", "one of its dependencies could not be resolved", "Failed to execute goal",
    "BUILD FAILURE", "",
]


def b2_step_logs(spark, sf_dir):
    """B2: one Maven step log per event: scan marker unless id % 13 = 0, plus two markers."""
    ev = B.table(spark, sf_dir, "events")
    i = F.col("event_id")
    arr = F.array(*[F.lit(m) for m in B2_MARKERS])
    m1 = F.element_at(arr, (i % 11 + 1).cast("int"))
    m2 = F.element_at(arr, ((i / 11).cast("bigint") % 11 + 1).cast("int"))
    log = F.concat_ws("\n",
                      F.when(i % 13 != 0, F.lit("[INFO] Scanning for projects...")).otherwise(F.lit("[INFO] start")),
                      F.concat(F.lit("[INFO] "), F.col("event_type"), F.lit(" "), m1),
                      F.concat(F.lit("[WARN] "), m2, F.lit(" "), F.col("props")))
    return ev.select(i, log.alias("log"))


def _b2_oracle() -> str:
    m1, m2 = "(event_id % 11)", "((event_id // 11) % 11)"
    whens = ["WHEN event_id % 13 = 0 THEN 0"]
    # Cascade order by status code rank: for each cascade step, the marker indexes that trigger it.
    order = [(9, (0, 1)), (1, (2,)), (4, (3,)), (10, (4,)), (3, (5,)), (2, (6,)), (8, (7,)), (7, (8,)), (5, (9,))]
    for code, idx in order:
        cond = " OR ".join(f"{m} IN ({', '.join(map(str, idx))})" for m in (m1, m2))
        whens.append(f"WHEN {cond} THEN {code}")
    names = dict(M.STATUS_NAMES)
    code_sql = "CASE " + " ".join(whens) + " ELSE 6 END"
    name_sql = "CASE c " + " ".join(f"WHEN {c} THEN '{n}'" for c, n in names.items()) + " END"
    return f"SELECT event_id, c AS status_code, {name_sql} AS status_name FROM (SELECT event_id, {code_sql} AS c FROM events)"


@register("maven_status", oracle=_b2_oracle())
def q_maven_status(spark, sf_dir):
    """F1 over B2 step logs."""
    logs = b2_step_logs(spark, sf_dir)
    code = M.maven_status_code("log")
    return logs.select("event_id", code.alias("status_code"), M.status_name(code).alias("status_name"))


# Key bridge over customer: no '_' (c % 3 = 0), one '_' (1), several '_' (2).
_KEY_SQL = """CASE c_custkey % 3 WHEN 0 THEN replace(c_name, '#', '')
                          WHEN 1 THEN 'o' || CAST(c_nationkey AS VARCHAR) || '/' || replace(c_name, '#', '')
                          ELSE 'own' || CAST(c_nationkey AS VARCHAR) || '/x_' || CAST(c_custkey AS VARCHAR) END"""


def _keys(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    name = F.replace(F.col("c_name"), F.lit("#"), F.lit(""))
    nat = F.col("c_nationkey").cast("string")
    repo = (F.when(F.col("c_custkey") % 3 == 0, name)
            .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("o"), nat, F.lit("/"), name))
            .otherwise(F.concat(F.lit("own"), nat, F.lit("/x_"), F.col("c_custkey").cast("string"))))
    return c.select("c_custkey", repo.alias("repo"))


@register("safe_key", oracle=f"""
SELECT c_custkey, {_KEY_SQL} AS repo, replace({_KEY_SQL}, '/', '_') AS safe
FROM customer""")
def q_safe_key(spark, sf_dir):
    return _keys(spark, sf_dir).select("c_custkey", "repo", T.safe_key("repo").alias("safe"))


@register("recover_key", oracle=f"""
SELECT c_custkey, safe,
       CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE {_KEY_SQL} END AS recovered,
       c_custkey % 3 <> 0 AS key_ok
FROM (SELECT c_custkey, c_nationkey, c_name, replace({_KEY_SQL}, '/', '_') AS safe FROM customer)""")
def q_recover_key(spark, sf_dir):
    """F2 then F3: the round trip is the identity for owners without '_'; keys without '_' -> NULL."""
    s = _keys(spark, sf_dir).select("c_custkey", T.safe_key("repo").alias("safe"))
    rec = T.recover_key("safe")
    return s.select("c_custkey", "safe", rec.alias("recovered"), rec.isNotNull().alias("key_ok"))


# Documents with ANSI colour codes around every sentence end and NULL text for doc_id % 17 = 0.
def _ansi_docs(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    colored = F.concat(F.lit("\u001b[1;32m"),
                       F.replace(F.col("text"), F.lit("."), F.lit("\u001b[0m.\u001b[2K")),
                       F.lit("\u001b[0m"))
    return d.select("doc_id", colored.alias("log"))


@register("strip_ansi", oracle="SELECT doc_id, text AS clean, length(text) AS n FROM documents")
def q_strip_ansi(spark, sf_dir):
    d = _ansi_docs(spark, sf_dir)
    clean = T.strip_ansi("log")
    return d.select("doc_id", clean.alias("clean"), F.length(clean).cast("bigint").alias("n"))


@register("collapse_middle", oracle="""
SELECT doc_id,
       CASE WHEN doc_id % 17 = 0 THEN 'None'
            WHEN length(text) <= 100 THEN text
            ELSE substr(text, 1, 48) || '...' || right(text, 49) END AS short
FROM documents""")
def q_collapse_middle(spark, sf_dir):
    d = B.table(spark, sf_dir, "documents")
    t = F.when(F.col("doc_id") % 17 != 0, F.col("text"))
    return d.select("doc_id", T.collapse_middle(t, 100).alias("short"))


@register("escape_newlines", oracle="""
SELECT doc_id, replace(replace(text, chr(10), '\\n'), chr(13), '\\r') AS escaped,
       CASE WHEN suffix(text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END, chr(10))
            THEN text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END
            ELSE text || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '' END || chr(10) END AS terminated
FROM documents""")
def q_escape_newlines(spark, sf_dir):
    """F7 and F9 over whole document texts."""
    d = B.table(spark, sf_dir, "documents")
    t = F.concat(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.lit("\n")).otherwise(F.lit("")))
    return d.select("doc_id", T.escape_newlines("text").alias("escaped"),
                    T.ensure_trailing_newline(t).alias("terminated"))


@register("splitlines", oracle="""
SELECT doc_id, CAST(generate_subscripts(l, 1) AS INTEGER) AS line_no, unnest(l) AS line
FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)""")
def q_splitlines(spark, sf_dir):
    """F22 over whole texts: one row per line with its 1-based number."""
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(T.splitlines("text")).alias("line_no", "line")).select(
        "doc_id", (F.col("line_no") + 1).alias("line_no"), "line")


@register("line_view", oracle="""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 5 - 1 AS st,
                  CASE WHEN doc_id % 3 = 0 THEN -1 ELSE doc_id % 5 + 2 END AS en FROM documents)
SELECT doc_id, array_to_string(l[greatest(st, 1):CASE WHEN en = -1 THEN len(l) ELSE en END], chr(10)) AS view
FROM d""")
def q_line_view(spark, sf_dir):
    """lines [doc_id % 5 - 1, doc_id % 5 + 2] (or to the end when doc_id % 3 = 0)."""
    d = B.table(spark, sf_dir, "documents")
    st = F.col("doc_id") % 5 - 1
    en = F.when(F.col("doc_id") % 3 == 0, F.lit(-1)).otherwise(F.col("doc_id") % 5 + 2)
    return d.select("doc_id", T.line_view("text", st, en).alias("view"))


@register("literal_replace", oracle="""
SELECT doc_id, replace(text, 'the.', '[the$1.]') AS replaced FROM documents""")
def q_literal_replace(spark, sf_dir):
    """literal replacement (the '.' and '$1' are not regex syntax)."""
    d = B.table(spark, sf_dir, "documents")
    return d.select("doc_id", T.literal_replace("text", "the.", "[the$1.]").alias("replaced"))


@register("line_insert", oracle="""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, doc_id % 4 AS k FROM documents)
SELECT doc_id, array_to_string(list_concat(l[1:least(k, len(l))], ['// inserted ' || CAST(doc_id AS VARCHAR)],
                                           l[least(k, len(l)) + 1:]), chr(10)) || chr(10) AS edited
FROM d""")
def q_line_insert(spark, sf_dir):
    """insert a line after line doc_id % 4 (0 = at the top; past the end appends)."""
    d = B.table(spark, sf_dir, "documents")
    new = F.concat(F.lit("// inserted "), F.col("doc_id").cast("string"))
    return d.select("doc_id", T.line_insert("text", F.col("doc_id") % 4, new).alias("edited"))


# Java version texts from part: p_size % 4 = 0 -> legacy "1.{p_size % 10}.0_x"; 1 -> unparsable.
_JV_SQL = """CASE p_size % 4 WHEN 0 THEN 'java version "1.' || CAST(p_size % 10 AS VARCHAR) || '.0_292"'
                     WHEN 1 THEN 'openjdk version ' || CAST(p_size AS VARCHAR)
                     ELSE 'openjdk version "' || CAST(p_size AS VARCHAR) || '.0.' || CAST(p_partkey % 9 AS VARCHAR) || '" 2024-01-16' END"""


@register("java_version_check", oracle=f"""
SELECT p_partkey, {_JV_SQL} AS version_text,
       CASE p_size % 4 WHEN 1 THEN NULL WHEN 0 THEN p_size % 10 ELSE p_size END AS major,
       CASE p_size % 4 WHEN 1 THEN FALSE WHEN 0 THEN FALSE ELSE p_size = 17 END AS ok17,
       CASE p_size % 4 WHEN 1 THEN FALSE WHEN 0 THEN p_size % 10 = 8 ELSE p_size = 8 END AS ok8
FROM part""")
def q_java_version_check(spark, sf_dir):
    """F25 against JDK 17 and JDK 8 (the ``1.8`` form only counts for 8)."""
    p = B.table(spark, sf_dir, "part")
    s, k = F.col("p_size"), F.col("p_partkey")
    txt = (F.when(s % 4 == 0, F.concat(F.lit('java version "1.'), (s % 10).cast("string"), F.lit('.0_292"')))
           .when(s % 4 == 1, F.concat(F.lit("openjdk version "), s.cast("string")))
           .otherwise(F.concat(F.lit('openjdk version "'), s.cast("string"), F.lit(".0."),
                               (k % 9).cast("string"), F.lit('" 2024-01-16'))))
    return p.select("p_partkey", txt.alias("version_text")).select(
        "p_partkey", "version_text", T.java_major("version_text").cast("int").alias("major"),
        T.java_version_ok("version_text", 17).alias("ok17"), T.java_version_ok("version_text", 8).alias("ok8"))


# Fixed values for the patch stderr bridge (index = event_id % 5).
_STDERR = ["error: patch failed: pom.xml:12\nerror: pom.xml: Patch does not apply",
           "error: corrupt patch at line 7", "fatal: Malformed patch at line 3",
           "error: unable to write file", "fatal: not a git repository"]


@register("patch_failure_class", oracle=f"""
SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'retry_3way' WHEN 2 THEN 'retry_3way' ELSE 'fail' END AS action
FROM events""")
def q_patch_failure_class(spark, sf_dir):
    """F26 over patch-apply stderr texts (one per event)."""
    ev = B.table(spark, sf_dir, "events")
    err = F.element_at(F.array(*[F.lit(x) for x in _STDERR]), (F.col("event_id") % 5 + 1).cast("int"))
    return ev.select("event_id", T.patch_failure_class(err).alias("action"))


@register("flatten", oracle="""
WITH r AS (SELECT o_orderkey AS k, o_orderkey % 11 <> 0 AS has_result, o_orderkey % 7 IN (0, 1, 2) AS cfail
           FROM orders)
SELECT k AS run_id, has_result AS run_success,
       CASE WHEN has_result THEN NOT cfail END AS migration_result_build_result_build_success,
       CASE WHEN has_result THEN 'r_' || CAST(k AS VARCHAR) END AS migration_result_diff
FROM r""")
def q_flatten(spark, sf_dir):
    """Nested run record -> flat columns joined by '_'."""
    v = verdicts(spark, sf_dir)
    nested = v.select(
        F.col("run_id"), F.col("has_result").alias("run_success"),
        F.when(F.col("has_result"), F.struct(
            F.struct(F.col("build_success")).alias("build_result"),
            F.concat(F.lit("r_"), F.col("run_id").cast("string")).alias("diff"))).alias("migration_result"))
    return ST.flatten(nested)


@register("first_n", oracle="""
SELECT o_orderkey AS ordinal, o_orderkey % 11 <> 0 AS has_result FROM orders ORDER BY o_orderkey LIMIT 100""")
def q_first_n(spark, sf_dir):
    """L1: the first 100 runs in manifest order (the limit is the feature)."""
    r = B.b1_runs(spark, sf_dir).select(F.col("run_id").alias("ordinal"), "has_result")
    return runs.first_n(r, 100, "ordinal")
