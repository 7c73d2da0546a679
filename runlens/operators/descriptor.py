"""Maven descriptors (POM files) as rows: F13-F16, J6-J8.

A permissive ``from_xml`` parse per POM (JVM, no Python) says whether it is well formed and gives its modules.
Dependencies and plugins are found wherever they stand, like the reference's ``.//dependency`` and ``.//plugin``:
one pass over the tags (in Arrow batches; a fold with Spark's ``aggregate`` copies its state at every step, which
is quadratic in a long BOM) carries the path and the texts of the open elements, so an element's values, place and
document position come from the same scan.  A malformed POM gives no rows, never a failed job.  Namespaces: the default Maven namespace and none are read alike
(``has_namespace`` tells them apart; the reference needs the default namespace to be declared).
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions.text import py_strip
from runlens.session import ship_package

POM_SCHEMA = "struct<modules: struct<module: array<string>>, _corrupt_record: string>"

#: Parts without elements (CDATA is text), and tags with the text behind them.
_EVENT = re.compile(r"""<!--.*?-->|<!\[CDATA\[(?P<cdata>.*?)\]\]>(?P<more>[^<]*)|<\?.*?\?>|<![^>]*>
    |<(?P<closes>/?)(?:[\w.-]+:)?(?P<name>[\w.-]+)(?:\s(?:[^>"'/]|"[^"]*"|'[^']*'|/(?!>))*+)?(?P<empty>/?)>(?P<text>[^<]*)""", re.S | re.X)
_ROWS = 4096        # elements in an Arrow batch


def parse_pom(pom) -> Column:
    """One permissive parse; element text is kept raw (stripped later, like Python's ``strip()``)."""
    c = F.col(pom) if isinstance(pom, str) else pom
    return F.from_xml(c, POM_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record",
                                      "ignoreSurroundingSpaces": "false"})


def _txt(raw: Column) -> Column:
    """Element text as the reference reads it: no text -> NULL, else stripped."""
    return F.when(raw != "", py_strip(raw))


def elements(pom: str, element: str, fields: tuple[str, ...]) -> list[tuple[str, dict[str, str]]]:
    """(path of the parent below the root, first text of each child among ``fields``) of every ``element`` in document order.

    One pass over the tags of a well-formed descriptor: the open tags are the path, the open elements a stack, so an
    element inside another (a plugin's configuration may list plugins) keeps its own texts.
    """
    path: list[str] = []
    inside: list[tuple[int, dict[str, str]]] = []       # depth of the children, texts
    found, told = [], None
    for m in _EVENT.finditer(pom):
        name = m["name"]
        if name is None:
            if m["cdata"] is None:
                told = None                             # text behind a comment is no text of the element
            elif told:
                told[0][told[1]] += m["cdata"] + html.unescape(m["more"])
            continue
        told = None
        if m["closes"]:
            if path:
                path.pop()
            if inside and inside[-1][0] > len(path):
                inside.pop()
            continue
        if inside and inside[-1][0] == len(path) and name in fields and name not in inside[-1][1]:
            told = (inside[-1][1], name)
            told[0][name] = "" if m["empty"] else html.unescape(m["text"])
        if name == element:
            found.append(("/" + "/".join(path[1:]), {}))
            if not m["empty"]:
                inside.append((len(path) + 1, found[-1][1]))
        if not m["empty"]:
            path.append(name)
    return found


def with_parsed(descriptors: DataFrame, pom_col: str = "pom") -> DataFrame:
    """Parse once per row; keeps the other columns, adds ``_p``, ``_pom`` (the text) and flags."""
    from runlens.operators._plan import evaluate_once
    pom = F.col(pom_col)
    d = descriptors.withColumns({"_p": parse_pom(pom_col), "_pom": pom, "has_namespace": pom.rlike("<project[^>]*\\sxmlns\\s*=")})
    d = d.withColumn("parsed", F.col("_p._corrupt_record").isNull() & pom.isNotNull())
    return evaluate_once(d.drop(pom_col))


_PROFILE = "/profiles/profile"
# How the usual places of a dependency or plugin (path of its parent) are called; any other place is "other".
DEPENDENCY_PLACES = {"/dependencies": "direct", "/dependencyManagement/dependencies": "managed",
                     "/build/plugins/plugin/dependencies": "plugin",
                     "/build/pluginManagement/plugins/plugin/dependencies": "plugin",
                     "/reporting/plugins/plugin/dependencies": "plugin"}
PLUGIN_PLACES = {"/build/plugins": "build", "/build/pluginManagement/plugins": "managed", "/reporting/plugins": "reporting"}
_IN_PROFILE = {"direct": "profile", "build": "profile"}


def _rows(parsed: DataFrame, keys: list[str], element: str, places: dict[str, str], pos: str, columns: dict[str, str]) -> DataFrame:
    """One row per element: its document position, text fields and place."""
    called = {**places, **{_PROFILE + path: _IN_PROFILE.get(where, f"profile_{where}") for path, where in places.items()}}
    names = F.create_map(*[F.lit(x) for pair in called.items() for x in pair])
    fields = tuple(columns.values())
    ship_package(parsed.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held: list[tuple] = []
            for i, pom in enumerate(batch.column("_pom").to_pylist()):
                held += [(i, n, path, *map(texts.get, fields)) for n, (path, texts) in enumerate(elements(pom, element, fields))]
                if len(held) >= _ROWS:
                    yield rows(batch, held)
                    held = []
            yield rows(batch, held)

    def rows(batch: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        which, place, *texts = [list(c) for c in zip(*held)] or [[] for _ in range(3 + len(fields))]
        return pa.RecordBatch.from_arrays(
            [*(batch.column(f"_k{k}").take(pa.array(which, type=pa.int64())) for k in range(len(keys))), pa.array(place, type=pa.int32()),
             *(pa.array(c, type=pa.string()) for c in texts)], names=[*(f"_k{k}" for k in range(len(keys))), "_pos", "_path", *fields])

    schema = ", ".join([*(f"_k{k} {parsed.schema[c].dataType.simpleString()}" for k, c in enumerate(keys)), "_pos int, _path string",
                        *(f"{f} string" for f in fields)])
    found = parsed.where("parsed").select(*[F.col(c).alias(f"_k{k}") for k, c in enumerate(keys)], "_pom").mapInArrow(run, schema)
    return found.select(*[F.col(f"_k{k}").alias(c) for k, c in enumerate(keys)], F.col("_pos").alias(pos),
                        *[_txt(F.col(n)).alias(c) for c, n in columns.items()],
                        F.coalesce(F.element_at(names, F.col("_path")), F.lit("other")).alias("where_found"))


def dependencies(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """one row per ``dependency`` element in document order (``dep_pos``): direct, managed, of plugins, in profiles, other."""
    return _rows(parsed, keys, "dependency", DEPENDENCY_PLACES, "dep_pos",
                 {"group_id": "groupId", "artifact_id": "artifactId", "version": "version", "scope": "scope"})


def plugins(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """F16: one row per ``plugin`` element in document order (``plugin_pos``): build, pluginManagement, reporting, profiles, other."""
    return _rows(parsed, keys, "plugin", PLUGIN_PLACES, "plugin_pos",
                 {"group_id": "groupId", "artifact_id": "artifactId", "version": "version"})


def modules(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """module names in order: modules without text are skipped, the others stripped
    (a whitespace-only name becomes ''); F13 = at least a ``modules`` element."""
    raw = F.coalesce(F.col("_p.modules.module"), F.array().cast("array<string>"))
    mods = F.transform(F.filter(raw, lambda m: m != ""), lambda m: py_strip(m))
    return parsed.select(*keys, F.posexplode(mods).alias("module_pos", "module"))


def is_multi_module(parsed: DataFrame, keys: list[str]) -> DataFrame:
    """F13 per descriptor."""
    return parsed.select(*keys, F.col("_p.modules").isNotNull().alias("multi_module"))


def module_pom_paths(descriptors: DataFrame, listing: DataFrame, key: str = "repo",
                     path_col: str = "path") -> DataFrame:
    """J6: 'root' -> root POM, module -> ``<dir>/<module>/pom.xml`` or NULL if the file is absent.

    ``descriptors`` holds root POMs (key, path, pom); ``listing`` the files that
    exist (path).  The existence check is a left join on the path.
    """
    parsed = with_parsed(descriptors)
    mods = modules(parsed, [key, path_col])
    base = F.regexp_replace(F.col(path_col), "/?[^/]*$", "")
    cand = mods.select(key, "module", F.concat_ws("/", F.when(base != "", base), F.col("module"),
                                                     F.lit("pom.xml")).alias("_cand"))
    exist = listing.select(F.col(path_col).alias("_cand"), F.lit(True).alias("_exists"))
    found = cand.join(exist, "_cand", "left").select(
        key, "module", F.when(F.col("_exists"), F.col("_cand")).alias("pom_path"))
    root = parsed.select(key, F.lit("root").alias("module"), F.col(path_col).alias("pom_path"))
    return root.unionByName(found)


def policy_report(elements: DataFrame, policy: DataFrame, keys: list[str], pos: str = "dep_pos") -> DataFrame:
    """J7 + J8: per descriptor and policy coordinate found, the first match and whether it needs a change.

    ``elements`` are the rows of ``dependencies`` or, with ``pos="plugin_pos"``, of ``plugins``.  A match
    needs both ``groupId`` and ``artifactId`` text (an element without ``groupId`` never matches); the first
    in document order counts.  A policy that repeats a coordinate has its greatest target.  The policy
    table is joined on the coordinate; Spark broadcasts it when its measured size is small and shuffles
    otherwise.
    """
    targets = policy.groupBy("group_id", "artifact_id").agg(F.max("target_version").alias("target_version"))
    m = elements.filter(F.col("group_id").isNotNull() & F.col("artifact_id").isNotNull()).join(targets, ["group_id", "artifact_id"])
    first = m.groupBy(*keys, "group_id", "artifact_id").agg(
        F.min_by(F.struct("version", "where_found"), F.col(pos)).alias("_f"), F.max("target_version").alias("target_version"))
    return first.select(*keys, "group_id", "artifact_id", F.col("_f.version").alias("current_version"),
                        F.col("_f.where_found").alias("where_found"), "target_version",
                        (~F.col("_f.version").eqNullSafe(F.col("target_version"))).alias("needs_change"))
