"""Driver queries for Maven descriptors (Q7: F13-F17, J6-J8).

Bridge B5: one root POM per part row (k = p_partkey, b = brand number,
t = p_type, s = p_size): default namespace unless k % 7 = 0; ``s % 3``
modules ``mod{i}`` (padded with spaces); direct dependency ``org.Brand{b}:t``
(version s, left out when k % 4 = 0; scope test when s is even, else compile)
except when k % 10 = 5; a ``junit`` dependency; a managed copy (version s+1)
when k % 5 = 0; a surefire plugin (no groupId when k % 6 = 0) with a
plugin-level dependency ``t-engine`` and, when k % 10 = 7, another below an execution.  When k % 8 = 3 a second
section of dependencies follows the build.  The managed section stands before the direct one unless k % 3 = 0.
A profile when k % 9 = 4 (in front of all sections when k is even, else behind them) with the coordinate
(version 9s), a managed jar plugin and a reporting plugin.  Cut short (malformed) when k % 11 = 0.
Module POM files exist for ``mod{i}`` when (k + i) % 2 = 0.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from runlens.functions import xml as X
from runlens.operators import descriptor as D
from runlens.plans import bridges as B
from runlens.plans.catalog import register

NS = ' xmlns="http://maven.apache.org/POM/4.0.0"'


def b5_descriptors(spark, sf_dir):
    p = B.table(spark, sf_dir, "part")
    k, s, t = F.col("p_partkey"), F.col("p_size"), F.col("p_type")
    b = F.replace(F.col("p_brand"), F.lit("#"), F.lit(""))
    ks, ss = k.cast("string"), s.cast("string")
    mods = F.array_join(F.transform(F.sequence(F.lit(0), s % 3 - 1),
                                    lambda i: F.concat(F.lit("<module> mod"), i.cast("string"), F.lit(" </module>"))), "")
    modules = F.when(s % 3 > 0, F.concat(F.lit("<modules>"), mods, F.lit("</modules>"))).otherwise(F.lit(""))
    coord = F.concat(F.lit("<groupId> org."), b, F.lit(" </groupId><artifactId>"), t, F.lit("</artifactId>"))
    managed = F.when(k % 5 == 0, F.concat(
        F.lit("<dependencyManagement><dependencies><dependency>"), coord, F.lit("<version>"),
        (s + 1).cast("string"), F.lit("</version></dependency></dependencies></dependencyManagement>"))).otherwise(F.lit(""))
    direct = F.when(k % 10 != 5, F.concat(
        F.lit("<dependency>"), coord,
        F.when(k % 4 != 0, F.concat(F.lit("<version>"), ss, F.lit("</version>"))).otherwise(F.lit("")),
        F.lit("<scope>"), F.when(s % 2 == 0, F.lit("test")).otherwise(F.lit("compile")), F.lit("</scope></dependency>"))
    ).otherwise(F.lit(""))
    junit = F.concat(F.lit("<dependency><groupId>junit</groupId><artifactId>junit</artifactId><version>4."),
                     (k % 13).cast("string"), F.lit("</version></dependency>"))
    plugin = F.concat(
        F.lit("<build><plugins><plugin>"),
        F.when(k % 6 != 0, F.lit("<groupId>org.apache.maven.plugins</groupId>")).otherwise(F.lit("")),
        F.lit("<artifactId>maven-surefire-plugin</artifactId><version>3."), (s % 5).cast("string"),
        F.lit("</version><dependencies><dependency><groupId>org."), b, F.lit("</groupId><artifactId>"), t,
        F.lit("-engine</artifactId></dependency></dependencies>"),
        F.when(k % 10 == 7, F.lit("<executions><execution><configuration><dependency><groupId>in</groupId><version>1</version></dependency>"
                                  "</configuration></execution></executions>")).otherwise(F.lit("")),
        F.lit("</plugin></plugins></build>"))
    late = F.when(k % 8 == 3, F.concat(
        F.lit("<dependencies><dependency><exclusions><exclusion><groupId>no</groupId></exclusion></exclusions><groupId>late</groupId>"
              "<artifactId><![CDATA[a&]]>amp;b</artifactId><version>"), (k % 4).cast("string"),
        F.lit("</version></dependency></dependencies>"))).otherwise(F.lit(""))
    profile = F.when(k % 9 == 4, F.concat(
        F.lit("<profiles><!-- <dependency> --><profile><id>x</id><dependencies><dependency>"), coord, F.lit("<version>9"), ss,
        F.lit("</version></dependency></dependencies><build><pluginManagement><plugins><plugin><groupId>org.apache.maven.plugins</groupId>"
              "<artifactId>maven-jar-plugin</artifactId><version>2."), (s % 4).cast("string"),
        F.lit("</version></plugin></plugins></pluginManagement></build><reporting><plugins><plugin><groupId>org.r</groupId>"
              "<artifactId>site</artifactId></plugin></plugins></reporting></profile></profiles>"))).otherwise(F.lit(""))
    pom = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<project'), F.when(k % 7 != 0, F.lit(NS)).otherwise(F.lit("")),
        F.lit(">\n  <modelVersion>4.0.0</modelVersion><groupId>org.part</groupId><artifactId>p"), ks,
        F.lit("</artifactId><version>1.0</version>\n  "), modules, F.when(k % 2 == 0, profile).otherwise(F.lit("")),
        F.when(k % 3 != 0, managed).otherwise(F.lit("")),
        F.lit("<dependencies>"), direct, junit, F.lit("</dependencies>\n  "), F.when(k % 3 == 0, managed).otherwise(F.lit("")),
        plugin, late, F.when(k % 2 == 1, profile).otherwise(F.lit("")),
        F.when(k % 11 != 0, F.lit("\n</project>\n")).otherwise(F.lit("\n")))
    return p.select(k.alias("part_id"), F.concat(F.lit("p"), ks, F.lit("/pom.xml")).alias("path"), pom.alias("pom"))


def b5_listing(spark, sf_dir):
    """Files that exist: every root POM, and module POMs where (k + i) % 2 = 0."""
    p = B.table(spark, sf_dir, "part")
    k, s = F.col("p_partkey"), F.col("p_size")
    ks = k.cast("string")
    root = p.select(F.concat(F.lit("p"), ks, F.lit("/pom.xml")).alias("path"))
    mods = p.filter(s % 3 > 0).select(k, F.explode(F.sequence(F.lit(0), s % 3 - 1)).alias("i")).filter(
        (F.col("p_partkey") + F.col("i")) % 2 == 0).select(
        F.concat(F.lit("p"), F.col("p_partkey").cast("string"), F.lit("/mod"), F.col("i").cast("string"),
                 F.lit("/pom.xml")).alias("path"))
    return root.unionByName(mods)


def b5_policy(spark, sf_dir):
    """Policy coordinates (distinct brand/type pairs) with a target version."""
    p = B.table(spark, sf_dir, "part")
    bn = F.regexp_extract(F.col("p_brand"), "(\\d+)", 1).cast("int")
    target = ((bn * 7 + F.length("p_type")) % 50).cast("string")
    return p.select(F.concat(F.lit("org.Brand"), bn.cast("string")).alias("group_id"),
                    F.col("p_type").alias("artifact_id"), target.alias("target_version")).distinct()


_PART_SQL = """
  SELECT p_partkey AS k, p_size AS s, p_type AS t, replace(p_brand, '#', '') AS b,
         CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS bn, p_partkey % 11 <> 0 AS parsed
  FROM part"""


@register("pom_dependencies", oracle=f"""
WITH p AS ({_PART_SQL}),
e AS (
SELECT k, 3 AS nth, 'org.' || b AS group_id, t AS artifact_id, CASE WHEN k % 4 <> 0 THEN CAST(s AS VARCHAR) END AS version,
       CASE WHEN s % 2 = 0 THEN 'test' ELSE 'compile' END AS scope, 'direct' AS where_found FROM p WHERE parsed AND k % 10 <> 5
UNION ALL SELECT k, 4, 'junit', 'junit', '4.' || CAST(k % 13 AS VARCHAR), NULL, 'direct' FROM p WHERE parsed
UNION ALL SELECT k, CASE WHEN k % 3 = 0 THEN 5 ELSE 2 END, 'org.' || b, t, CAST(s + 1 AS VARCHAR), NULL, 'managed' FROM p WHERE parsed AND k % 5 = 0
UNION ALL SELECT k, 6, 'org.' || b, t || '-engine', NULL, NULL, 'plugin' FROM p WHERE parsed
UNION ALL SELECT k, 7, 'in', NULL, '1', NULL, 'other' FROM p WHERE parsed AND k % 10 = 7
UNION ALL SELECT k, 8, 'late', 'a&amp;b', CAST(k % 4 AS VARCHAR), NULL, 'direct' FROM p WHERE parsed AND k % 8 = 3
UNION ALL SELECT k, CASE WHEN k % 2 = 0 THEN 1 ELSE 9 END, 'org.' || b, t, '9' || CAST(s AS VARCHAR), NULL, 'profile' FROM p WHERE parsed AND k % 9 = 4)
SELECT k AS part_id, CAST(row_number() OVER (PARTITION BY k ORDER BY nth) - 1 AS INTEGER) AS dep_pos,
       group_id, artifact_id, version, scope, where_found FROM e""")
def q_pom_dependencies(spark, sf_dir):
    """every dependency element of every descriptor, with the section it sits in."""
    parsed = D.with_parsed(b5_descriptors(spark, sf_dir))
    return D.dependencies(parsed, ["part_id"])


@register("pom_plugins", oracle=f"""
WITH p AS ({_PART_SQL})
SELECT k AS part_id, CAST(CASE WHEN k % 9 = 4 AND k % 2 = 0 THEN 2 ELSE 0 END AS INTEGER) AS plugin_pos,
       CASE WHEN k % 6 <> 0 THEN 'org.apache.maven.plugins' END AS group_id, 'maven-surefire-plugin' AS artifact_id, '3.' || CAST(s % 5 AS VARCHAR) AS version, 'build' AS where_found
FROM p WHERE parsed
UNION ALL SELECT k, CAST(k % 2 AS INTEGER), 'org.apache.maven.plugins', 'maven-jar-plugin', '2.' || CAST(s % 4 AS VARCHAR), 'profile_managed' FROM p WHERE parsed AND k % 9 = 4
UNION ALL SELECT k, CAST(k % 2 + 1 AS INTEGER), 'org.r', 'site', NULL, 'profile_reporting' FROM p WHERE parsed AND k % 9 = 4""")
def q_pom_plugins(spark, sf_dir):
    """F16: plugin elements (a plugin without groupId keeps a NULL group and never matches a lookup)."""
    parsed = D.with_parsed(b5_descriptors(spark, sf_dir))
    return D.plugins(parsed, ["part_id"])


@register("pom_modules", oracle=f"""
WITH p AS ({_PART_SQL}),
m AS (SELECT k, s, unnest(range(s % 3)) AS i FROM p WHERE parsed AND s % 3 > 0)
SELECT k AS part_id, 'root' AS module, 'p' || CAST(k AS VARCHAR) || '/pom.xml' AS pom_path FROM p
UNION ALL
SELECT k, 'mod' || CAST(i AS VARCHAR),
       CASE WHEN (k + i) % 2 = 0 THEN 'p' || CAST(k AS VARCHAR) || '/mod' || CAST(i AS VARCHAR) || '/pom.xml' END
FROM m""")
def q_pom_modules(spark, sf_dir):
    """F14 + J6: modules (stripped) with their POM path, NULL when the file does not exist; plus root."""
    return D.module_pom_paths(b5_descriptors(spark, sf_dir), b5_listing(spark, sf_dir), key="part_id")


@register("multi_module", oracle=f"""
WITH p AS ({_PART_SQL})
SELECT k AS part_id, parsed, CASE WHEN parsed THEN s % 3 > 0 END AS multi_module,
       k % 7 <> 0 AS has_namespace FROM p""")
def q_multi_module(spark, sf_dir):
    """F13 per descriptor (NULL for descriptors that do not parse)."""
    parsed = D.with_parsed(b5_descriptors(spark, sf_dir))
    return parsed.select("part_id", "parsed", F.when(F.col("parsed"), F.col("_p.modules").isNotNull())
                         .alias("multi_module"), "has_namespace")


@register("xml_valid", oracle=f"""
WITH p AS ({_PART_SQL}) SELECT k AS part_id, parsed AS well_formed FROM p""")
def q_xml_valid(spark, sf_dir):
    """the validator's verdict on each descriptor (message starts 'XML is well-formed.')."""
    from runlens.session import ship_package
    ship_package(spark)
    d = b5_descriptors(spark, sf_dir)
    return d.select("part_id", (X.xml_check_message("pom") == X.WELL_FORMED_MSG).alias("well_formed"))


@register("policy_report", oracle=f"""
WITH p AS ({_PART_SQL}),
pol AS (SELECT DISTINCT 'org.Brand' || CAST(bn AS VARCHAR) AS group_id, t AS artifact_id,
               CAST((bn * 7 + length(t)) % 50 AS VARCHAR) AS target_version FROM p),
o AS (SELECT *, CASE WHEN k % 9 = 4 AND k % 2 = 0 THEN 'profile'
                  WHEN k % 5 = 0 AND (k % 3 <> 0 OR k % 10 = 5) THEN 'managed'
                  WHEN k % 10 <> 5 THEN 'direct' END AS w FROM p WHERE parsed),
f AS (SELECT k, 'org.' || b AS group_id, t AS artifact_id, w AS where_found,
             CASE w WHEN 'profile' THEN '9' || CAST(s AS VARCHAR) WHEN 'managed' THEN CAST(s + 1 AS VARCHAR)
                    ELSE CASE WHEN k % 4 <> 0 THEN CAST(s AS VARCHAR) END END AS current_version FROM o)
SELECT k AS part_id, f.group_id, f.artifact_id, current_version, where_found, target_version,
       current_version IS DISTINCT FROM target_version AS needs_change
FROM f JOIN pol ON f.group_id = pol.group_id AND f.artifact_id = pol.artifact_id""")
def q_policy_report(spark, sf_dir):
    """J7 + J8: each descriptor's first match of a policy coordinate, its version and whether it must change."""
    parsed = D.with_parsed(b5_descriptors(spark, sf_dir))
    deps = D.dependencies(parsed, ["part_id"])
    return D.policy_report(deps, b5_policy(spark, sf_dir), ["part_id"])


@register("plugin_lookup", oracle=f"""
WITH p AS ({_PART_SQL}),
pol AS (SELECT * FROM (VALUES (0, 'org.apache.maven.plugins', 'maven-surefire-plugin', '3.2'),
                              (1, 'org.apache.maven.plugins', 'maven-jar-plugin', '2.1'), (2, 'org.r', 'site', '1')) v(r, g, a, t)
        JOIN region ON r_regionkey = r),
f AS (SELECT k, 'org.apache.maven.plugins' AS g, 'maven-surefire-plugin' AS a, '3.' || CAST(s % 5 AS VARCHAR) AS v, 'build' AS w
      FROM p WHERE parsed AND k % 6 <> 0
      UNION ALL SELECT k, 'org.apache.maven.plugins', 'maven-jar-plugin', '2.' || CAST(s % 4 AS VARCHAR), 'profile_managed'
      FROM p WHERE parsed AND k % 9 = 4
      UNION ALL SELECT k, 'org.r', 'site', NULL, 'profile_reporting' FROM p WHERE parsed AND k % 9 = 4)
SELECT k AS part_id, f.g AS group_id, f.a AS artifact_id, v AS current_version, w AS where_found, pol.t AS target_version,
       v IS DISTINCT FROM pol.t AS needs_change
FROM f JOIN pol ON f.g = pol.g AND f.a = pol.a""")
def q_plugin_lookup(spark, sf_dir):
    """J7/J8 for plugins: the first plugin with a coordinate of the policy (targets keyed by region)."""
    targets = F.create_map(*[F.lit(x) for k, v in {
        0: ("org.apache.maven.plugins", "maven-surefire-plugin", "3.2"), 1: ("org.apache.maven.plugins", "maven-jar-plugin", "2.1"),
        2: ("org.r", "site", "1")}.items() for x in (k, ":".join(v))])
    policy = (B.table(spark, sf_dir, "region").select(F.split(targets[F.col("r_regionkey")], ":").alias("t")).where("t is not null")
              .select(*[F.col("t")[i].alias(c) for i, c in enumerate(("group_id", "artifact_id", "target_version"))]))
    parsed = D.with_parsed(b5_descriptors(spark, sf_dir))
    return D.policy_report(D.plugins(parsed, ["part_id"]), policy, ["part_id"], pos="plugin_pos")
