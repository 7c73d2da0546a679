"""Text column functions (F2-F3, F5-F7, F9, F18-F22, F25-F27, Python-style strip).

All are compositions of Spark built-ins; none calls back into Python.
Python and Java regex/whitespace rules differ, so each function states which
Python behaviour it reproduces.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
# Line breaks of Python's str.splitlines: \r\n, \n, \r, \x0b, \x0c, \x1c, \x1d, \x1e, \x85, \u2028,
SPLITLINES_RE = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]"
# ANSI escape sequence (ESC, one of @-_, parameters 0-?, intermediates space-/, final @-~)
ANSI_RE = "\u001b[@-_][0-?]*[ -/]*[@-~]"
# Python str.isspace() characters (Java's Unicode \s plus the \x1c-\x1f separators)
PY_SPACE = "[\\s\u001c-\u001f]"
PY_SPACE_CHARS = ("\t\n\u000b\u000c\r\u001c\u001d\u001e\u001f \u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
                  "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")
# Header put before each file of a packed corpus
FILE_HEADER_PREFIX = "\n--- File: "
FILE_HEADER_SUFFIX = " ---\n"
# Patch-apply failure texts (lower-cased stderr) that are retried with a three-way merge
PATCH_RETRY_MARKERS = ("patch does not apply", "malformed patch")
# Java version text: first "major.minor.patch" after a double quote
JAVA_VERSION_RE = '"(\\d+)\\.(\\d+)\\.(\\d+)'
# ---------------------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def py_strip(s) -> Column:
    """Python ``str.strip()``: remove all Unicode whitespace at both ends (linear in the text's length)."""
    return F.btrim(_col(s), F.lit(PY_SPACE_CHARS))


def py_strip_chars(s, chars: str) -> Column:
    """Python ``str.strip(chars)`` for a literal set of characters."""
    return F.btrim(_col(s), F.lit(chars))


def splitlines(s) -> Column:
    """Python ``str.splitlines()`` as array<string> ('' -> [], one trailing break dropped).

    The one trailing line break is removed first (anchored at the very end,
    ``\\z``) so the text is split exactly once.
    """
    c = _col(s)
    body = F.regexp_replace(c, f"(?:{SPLITLINES_RE})\\z", "")
    return F.when(c == "", F.array().cast("array<string>")).otherwise(F.split(body, SPLITLINES_RE, -1))


def safe_key(repo) -> Column:
    """``owner/name`` -> ``owner_name`` (every '/')."""
    return F.replace(_col(repo), F.lit("/"), F.lit("_"))


def recover_key(key) -> Column:
    """first '_' -> '/'; NULL when the key has no '_' (the reference raises)."""
    k = _col(key)
    return F.when(F.instr(k, "_") > 0, F.regexp_replace(k, "^([^_]*)_", "$1/"))


def strip_ansi(s) -> Column:
    """remove ANSI escape sequences."""
    return F.regexp_replace(_col(s), ANSI_RE, "")


def collapse_middle(s, max_len: int = 100) -> Column:
    """shorten to ``max_len`` chars keeping both ends around '...'; NULL -> 'None'."""
    if max_len < 4:
        raise ValueError("max_len must be at least 4")
    keep_start = (max_len - 3) // 2
    keep_end = max_len - 3 - keep_start
    c = _col(s)
    short = F.concat(F.substring(c, 1, keep_start), F.lit("..."), F.substring(c, -keep_end, keep_end))
    return (F.when(c.isNull(), F.lit("None"))
            .when(F.length(c) <= max_len, c)
            .otherwise(short))


def escape_newlines(s) -> Column:
    """'\\n' -> backslash-n, '\\r' -> backslash-r."""
    return F.replace(F.replace(_col(s), F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r"))


def ensure_trailing_newline(s) -> Column:
    """append '\\n' unless the text already ends with one."""
    c = _col(s)
    return F.when(c.endswith("\n"), c).otherwise(F.concat(c, F.lit("\n")))


def line_view(s, start, end) -> Column:
    """lines [start, end] (1-based, inclusive), ``end = -1`` = to the end, joined by '\\n'.

    Like the reference, a start below 1 is clamped to 1 and an end past the
    last line stops at the last line.  An end below -1 is rejected: NULL.
    """
    st = F.greatest(_lit(start), F.lit(1))
    e = _lit(end)
    kept = F.filter(splitlines(s), lambda x, i: (i + 1 >= st) & ((e == -1) | (i + 1 <= e)))
    return F.when(e >= -1, F.array_join(kept, "\n"))


def literal_replace(s, old: str, new: str) -> Column:
    """replace every occurrence of a literal (not a regex)."""
    return F.replace(_col(s), F.lit(old), F.lit(new))


def line_insert(s, after_line, new_text) -> Column:
    """insert a line after line ``after_line``; past the end appends; ends with '\\n'.

    A negative position counts from the end, as Python's ``list.insert`` does.
    """
    lines = splitlines(s)
    a = _lit(after_line)
    k = F.when(a < 0, F.greatest(F.size(lines) + a, F.lit(0))).otherwise(a)
    head = F.filter(lines, lambda x, i: i < k)
    tail = F.filter(lines, lambda x, i: i >= k)
    return F.concat(F.array_join(F.concat(head, F.array(_lit(new_text)), tail), "\n"), F.lit("\n"))


def java_version_ok(version_text, jdk: int) -> Column:
    """parse ``"major.minor.patch`` and check it against the target JDK.

    ``1.8`` counts as 8; otherwise the major must equal the target; no parse -> false.
    """
    t = _col(version_text)
    major = F.regexp_extract(t, JAVA_VERSION_RE, 1)
    minor = F.regexp_extract(t, JAVA_VERSION_RE, 2)
    mj = major.try_cast("bigint")
    mn = minor.try_cast("bigint")
    legacy8 = (mj == 1) & (mn == 8) & F.lit(jdk == 8)
    return F.coalesce(F.when(major == "", F.lit(False)).otherwise(legacy8 | (mj == jdk)), F.lit(False))


def java_major(version_text) -> Column:
    """Major Java version from version text (``1.x`` -> x); NULL if unparsable."""
    t = _col(version_text)
    mj = F.regexp_extract(t, JAVA_VERSION_RE, 1).try_cast("bigint")
    mn = F.regexp_extract(t, JAVA_VERSION_RE, 2).try_cast("bigint")
    return F.when(mj == 1, mn).otherwise(mj)


def patch_failure_class(stderr) -> Column:
    """'retry_3way' if the strict check failed for a context reason, else 'fail'."""
    low = F.lower(_col(stderr))
    cond = None
    for m in PATCH_RETRY_MARKERS:
        cond = low.contains(m) if cond is None else cond | low.contains(m)
    return F.when(_col(stderr).isNull(), F.lit(None).cast("string")).when(cond, "retry_3way").otherwise("fail")


def file_with_header(path, content_bin) -> Column:
    """``\\n--- File: {path} ---\\n{text}``; content that is not valid UTF-8 -> ''."""
    txt = _col(content_bin).cast("string")
    return F.when(F.is_valid_utf8(txt),
                  F.concat(F.lit(FILE_HEADER_PREFIX), _col(path), F.lit(FILE_HEADER_SUFFIX), txt)).otherwise(F.lit(""))


def _lit(v) -> Column:
    return v if isinstance(v, Column) else F.lit(v)
