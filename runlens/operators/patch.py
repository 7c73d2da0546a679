"""Patches: changed files (F21) with the build-output exclusion rule.

A patch is one text row.  It is split into per-file sections at
``diff --git`` lines with a zero-width split (in-row, no shuffle), the new
path is read from the section header, and the exclusion rule is applied.
``filtered_patch`` re-assembles only the kept sections, in-row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
EXCLUDED_DIRS = ["target"]
EXCLUDED_EXTS = [".class", ".jar", ".war", ".ear", ".tmp"]  # compared lower-cased
# ---------------------------------------------------------------------------

SECTION_MARK = "diff --git "
# The section's own lines name the file: where it was renamed or copied to, its new or (deleted) its old
# side; a section without them (mode change, empty file) names it twice in its first line.
_NAMED = r'(?m)^(?:rename to |copy to |\+\+\+ b/|\+\+\+ (?="b/))([^\t\n]*)'
_DELETED = r'(?m)^--- (?:a/|(?="a/))([^\t\n]*)'
_TWICE = r'^diff --git (?:a/(.*) b/\1|"a/(.*)" "b/\2")$'


def _excluded_re() -> str:
    import re
    dirs = "|".join(re.escape(d) for d in EXCLUDED_DIRS)
    exts = "|".join(re.escape(e.lstrip(".")) for e in EXCLUDED_EXTS)
    # A path part equal to an excluded folder, or a last dot-segment of the base name
    # (with a non-dot character before it, as splitext requires) in the list, any case.
    return f"(^|/)({dirs})(/|$)|[^/.][^/]*\\.(?i:{exts})$"


def is_excluded(path) -> Column:
    """Any path part named ``target``, or a build-output extension (case-insensitive).

    One ``rlike`` encodes both rules (``os.path.splitext`` semantics for the
    extension), so the check stays cheap inside per-section lambdas.
    """
    c = F.col(path) if isinstance(path, str) else path
    return c.rlike(_excluded_re())


def _bodies(diff: Column) -> Column:
    """File sections in order, each without the line break that ends it (the last keeps its own ending).

    ``'\\n' + diff`` is split on the literal ``'\\ndiff --git '`` (a plain
    substring search); the first piece is the preamble and the marker is put
    back on the others.  Measured 4-5x faster than a look-around split.
    """
    parts = F.split(F.concat(F.lit("\n"), F.coalesce(diff, F.lit(""))), "\n" + SECTION_MARK, -1)
    return F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda b: F.concat(F.lit(SECTION_MARK), b))


def _unquoted(path: Column) -> Column:
    """A path as git writes it: quoted with backslash escapes (octal bytes among them) or plain; leading side removed."""
    inner = F.regexp_extract(path, r'(?s)^"(?:[ab]/)?(.*)"$', 1)
    pieces = F.regexp_extract_all(inner, F.lit(r"(?s)\\[0-7]{3}|\\.|[^\\]+"), F.lit(0))

    def raw(x: Column) -> Column:
        plain = F.when(x == r"\t", "\t").when(x == r"\n", "\n").when(x == r"\r", "\r").when(
            x.startswith("\\"), F.substring(x, 2, 1)).otherwise(x)
        return F.when(x.rlike(r"^\\[0-7]{3}$"), F.unhex(F.lpad(F.conv(F.substring(x, 2, 3), 8, 16), 2, "0"))).otherwise(
            F.encode(plain, "UTF-8"))

    joined = F.aggregate(F.transform(pieces, raw), F.lit(b""), lambda acc, x: F.concat(acc, x))
    return F.when(path.startswith('"'), joined.cast("string")).otherwise(path)


def _path(section: Column) -> Column:
    """the file of a section (its new name)."""
    from runlens.operators._plan import let

    def named(head: Column) -> Column:
        first = F.substring_index(head, "\n", 1)
        found = F.coalesce(*[F.nullif(c, F.lit("")) for c in (
            F.regexp_extract(head, _NAMED, 1), F.regexp_extract(head, _DELETED, 1), F.regexp_extract(first, _TWICE, 1),
            F.concat(F.lit('"'), F.nullif(F.regexp_extract(first, _TWICE, 2), F.lit("")), F.lit('"')))], F.lit(""))
        return let(found, _unquoted)

    # A carriage return in front of a line end belongs to the line end (git quotes one that is part of a name).
    def ended(head: Column) -> Column:
        return F.when(head.contains("\r"), F.regexp_replace(head, "\r(\n|\\z)", "$1")).otherwise(head)

    return let(F.substring_index(section, "\n@@", 1), lambda head: let(ended(head), named))


def changed_files(patches: DataFrame, diff_col: str = "diff") -> DataFrame:
    """one row per file section: ``file`` (new path), ``excluded`` (P3), ``hunk_text``."""
    from runlens.operators._plan import evaluate_once
    keys = [c for c in patches.columns if c != diff_col]
    staged = evaluate_once(patches.select(*keys, _bodies(F.col(diff_col)).alias("_b")))
    ex = staged.select(*keys, F.size("_b").alias("_n"), F.posexplode("_b").alias("file_pos", "_body"))
    hunk = F.concat(F.col("_body"), F.when(F.col("file_pos") < F.col("_n") - 1, F.lit("\n")).otherwise(F.lit("")))
    return ex.select(*keys, "file_pos", _path(F.col("_body")).alias("file"), hunk.alias("hunk_text")) \
        .withColumn("excluded", is_excluded("file"))


def filtered_patch(diff) -> Column:
    """Patch text restricted to allowed files ('' when none is left), computed in-row.

    Kept sections are joined with the line breaks the split removed; a final
    break is added when the patch's own last section was dropped.
    """
    from runlens.operators._plan import let
    c = F.col(diff) if isinstance(diff, str) else diff
    judged = F.transform(_bodies(c), lambda s: F.struct(s.alias("body"), is_excluded(_path(s)).alias("out")))

    def joined(sections: Column) -> Column:
        last_out = F.try_element_at(sections, F.lit(-1))["out"]
        return let(F.filter(sections, lambda s: ~s["out"]), lambda kept: F.when(F.size(kept) == 0, F.lit("")).otherwise(
            F.concat(F.array_join(F.transform(kept, lambda s: s["body"]), "\n"), F.when(last_out, "\n").otherwise(""))))

    return let(judged, joined)
