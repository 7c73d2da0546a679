"""Driver queries for patches.

Bridge B6: one patch per lineitem row (k, ln, pk, sk) with three file sections:
``src/main/java/A{pk}.java``; by pk % 4: ``target/classes/A{pk}.class``,
``lib/S{sk}.JAR``, ``module/target/gen/B{sk}.txt``, ``pom{pk}.xml``; by sk % 3:
``docs/.hidden{sk}.tmp``, ``notes/readme{sk}.md``, ``build/out{sk}.war.bak``.
Empty patch when (k + ln) % 9 = 0, line ends CRLF when (k + ln) % 9 = 4.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.operators import patch as P
from runlens.plans import bridges as B
from runlens.plans.catalog import register

_F1 = "'src/main/java/A' || CAST(pk AS VARCHAR) || '.java'"
_F2 = """CASE pk % 4 WHEN 0 THEN 'target/classes/A' || CAST(pk AS VARCHAR) || '.class'
                  WHEN 1 THEN 'lib/S' || CAST(sk AS VARCHAR) || '.JAR'
                  WHEN 2 THEN 'module/target/gen/B' || CAST(sk AS VARCHAR) || '.txt'
                  ELSE 'pom' || CAST(pk AS VARCHAR) || '.xml' END"""
_F3 = """CASE sk % 3 WHEN 0 THEN 'docs/.hidden' || CAST(sk AS VARCHAR) || '.tmp'
                  WHEN 1 THEN 'notes/readme' || CAST(sk AS VARCHAR) || '.md'
                  ELSE 'build/out' || CAST(sk AS VARCHAR) || '.war.bak' END"""


def _files(pk, sk):
    p, s = pk.cast("string"), sk.cast("string")
    f1 = F.concat(F.lit("src/main/java/A"), p, F.lit(".java"))
    f2 = (F.when(pk % 4 == 0, F.concat(F.lit("target/classes/A"), p, F.lit(".class")))
          .when(pk % 4 == 1, F.concat(F.lit("lib/S"), s, F.lit(".JAR")))
          .when(pk % 4 == 2, F.concat(F.lit("module/target/gen/B"), s, F.lit(".txt")))
          .otherwise(F.concat(F.lit("pom"), p, F.lit(".xml"))))
    f3 = (F.when(sk % 3 == 0, F.concat(F.lit("docs/.hidden"), s, F.lit(".tmp")))
          .when(sk % 3 == 1, F.concat(F.lit("notes/readme"), s, F.lit(".md")))
          .otherwise(F.concat(F.lit("build/out"), s, F.lit(".war.bak"))))
    return [f1, f2, f3]


def _section(f, k, ln):
    return F.concat(F.lit("diff --git a/"), f, F.lit(" b/"), f, F.lit("\nindex 1234567..89abcde 100644\n--- a/"), f,
                    F.lit("\n+++ b/"), f, F.lit("\n@@ -1 +1 @@\n-old "), k.cast("string"), F.lit("\n+new "),
                    ln.cast("string"), F.lit("\n"))


def b6_patches(spark, sf_dir):
    li = B.table(spark, sf_dir, "lineitem")
    k, ln, pk, sk = F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    # A projection each for the names and the text, which are named several times and made once.
    ids = ("l_orderkey", "l_linenumber", "l_partkey")
    named = li.select(*ids, *[f.alias(f"_f{i}") for i, f in enumerate(_files(pk, sk))])
    texts = named.select(*ids, F.concat(*[_section(F.col(f"_f{i}"), k, ln) for i in range(3)]).alias("_body"))
    body = F.col("_body")
    diff = (F.when((k + ln) % 9 == 0, F.lit("")).when((k + ln) % 9 == 4, F.replace(body, F.lit("\n"), F.lit("\r\n")))
            .otherwise(body))
    return texts.select(k.alias("run_id"), ln.alias("line_no"), pk.alias("part_id"), diff.alias("diff"))


_P_SQL = """SELECT l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk FROM lineitem
            WHERE (l_orderkey + l_linenumber) % 9 <> 0"""


@register("changed_files", oracle=f"""
WITH p AS ({_P_SQL})
SELECT k AS run_id, ln AS line_no, pk AS part_id, 0 AS file_pos, {_F1} AS file, FALSE AS excluded FROM p
UNION ALL SELECT k, ln, pk, 1, {_F2}, pk % 4 <> 3 FROM p
UNION ALL SELECT k, ln, pk, 2, {_F3}, sk % 3 = 0 FROM p""")
def q_changed_files(spark, sf_dir):
    """F21 + P3: file sections of every patch with the exclusion flag."""
    return P.changed_files(b6_patches(spark, sf_dir)).select(
        "run_id", "line_no", "part_id", F.col("file_pos").cast("int").alias("file_pos"), "file", "excluded")


def _sec_sql(f):
    return (f"'diff --git a/' || {f} || ' b/' || {f} || chr(10) || 'index 1234567..89abcde 100644' || chr(10) || "
            f"'--- a/' || {f} || chr(10) || '+++ b/' || {f} || chr(10) || '@@ -1 +1 @@' || chr(10) || "
            f"'-old ' || CAST(k AS VARCHAR) || chr(10) || '+new ' || CAST(ln AS VARCHAR) || chr(10)")


@register("filtered_patch", oracle=f"""
SELECT l_orderkey AS run_id, l_linenumber AS line_no, l_partkey AS part_id,
       CASE WHEN (l_orderkey + l_linenumber) % 9 = 0 THEN '' WHEN (l_orderkey + l_linenumber) % 9 = 4 THEN
         replace({_sec_sql(_F1)} || CASE WHEN pk % 4 = 3 THEN {_sec_sql(_F2)} ELSE '' END
         || CASE WHEN sk % 3 <> 0 THEN {_sec_sql(_F3)} ELSE '' END, chr(10), chr(13) || chr(10)) ELSE
         {_sec_sql(_F1)} || CASE WHEN pk % 4 = 3 THEN {_sec_sql(_F2)} ELSE '' END
         || CASE WHEN sk % 3 <> 0 THEN {_sec_sql(_F3)} ELSE '' END END AS kept_patch
FROM (SELECT *, l_orderkey AS k, l_linenumber AS ln, l_partkey AS pk, l_suppkey AS sk FROM lineitem)""")
def q_filtered_patch(spark, sf_dir):
    """The patch restricted to allowed files ('' when nothing is left), per patch row."""
    p = b6_patches(spark, sf_dir)
    return p.select("run_id", "line_no", "part_id", P.filtered_patch("diff").alias("kept_patch"))
