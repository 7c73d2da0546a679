"""XML column functions: well-formedness (F17) and coverage counters (A4).

Spark's ``xpath*`` functions raise on malformed input and would fail the whole
job, and ``from_xml`` is no full well-formedness check, so documents go through
expat in Arrow batches: the same parser family the reference uses.  A document
that cannot be read gives a message, never a failed job.

Coverage reports as the usual writer makes them are proved regular and counted
by column functions (``regular_report``, ``regular_counters``); only the others
need the parser.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

# ---------------------------------------------------------------------------
# Fixed values that must equal the reference's for right results.
WELL_FORMED_MSG = "XML is well-formed."
NOT_WELL_FORMED_PREFIX = "XML is not well-formed: "
UNEXPECTED_PREFIX = "An unexpected error occurred: "
COVERAGE_TYPES = ("LINE", "METHOD")
# ---------------------------------------------------------------------------


def _parse(text, on_start=None) -> str:
    """Parse a document (text or bytes) and say how it went."""
    import xml.parsers.expat as expat
    parser = expat.ParserCreate()
    if on_start is not None:
        parser.StartElementHandler = on_start
    try:
        parser.Parse(bytes(text) if isinstance(text, (bytearray, memoryview)) else text, True)
    except expat.ExpatError as e:
        return NOT_WELL_FORMED_PREFIX + str(e)
    except (ValueError, LookupError) as e:      # e.g. an encoding that does not exist
        return UNEXPECTED_PREFIX + str(e)
    return WELL_FORMED_MSG


def _check_message(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else _parse(t))


def xml_check_message(xml) -> Column:
    """the validator's message for each document ('XML is well-formed.' or the error); NULL for NULL."""
    return F.pandas_udf(_check_message, StringType())(F.col(xml) if isinstance(xml, str) else xml)


_COUNTER_SCHEMA = StructType([StructField("message", StringType())] + [
    StructField(f"{t.lower()}_{a}", LongType()) for t in COVERAGE_TYPES for a in ("missed", "covered")])


_LEAST, _MOST = -(1 << 63), (1 << 63) - 1


def _count_one(text):
    """One streaming expat parse: sum missed/covered of every element typed LINE/METHOD.

    Only a document whose root element is ``report`` contributes counters; a parse error, a counter that
    is not an integer or a sum beyond 64 bits makes the report invalid.
    """
    if text is None:
        return (None, None, None, None, None)
    acc = [0, 0, 0, 0]
    root = []

    def start(name, attrs):
        if not root:
            root.append(name)
        t = attrs.get("type")
        if t in COVERAGE_TYPES:
            i = 2 * COVERAGE_TYPES.index(t)
            acc[i] += int(attrs.get("missed", 0))
            acc[i + 1] += int(attrs.get("covered", 0))

    message = _parse(text, start)
    if message != WELL_FORMED_MSG:
        return (message, None, None, None, None)
    if root[0] != "report":
        return (message, 0, 0, 0, 0)
    if not all(_LEAST <= n <= _MOST for n in acc):
        return (UNEXPECTED_PREFIX + "a counter beyond 64 bits", None, None, None, None)
    return (message, *acc)


def _count_all(texts: pd.Series) -> pd.DataFrame:
    given = texts[texts.notna()]        # most are NULL where regular reports are counted elsewhere
    columns = list(zip(*map(_count_one, given))) or [()] * 5
    out = {"message": pd.Series(list(columns[0]), index=given.index, dtype=object)}
    for name, values in zip(_COUNTER_SCHEMA.names[1:], columns[1:]):
        out[name] = pd.Series(pd.array(list(values), dtype="Int64"), index=given.index)
    return pd.DataFrame(out, index=given.index).reindex(texts.index)


def coverage_counters(xml) -> Column:
    """A4: per report, sums of missed/covered over every element (any depth) typed LINE / METHOD.

    One streaming expat parse per report (Arrow-batched): the same pass checks
    well-formedness, so a malformed report yields a message and NULL counters
    instead of failing the job.  ``message`` is 'XML is well-formed.' for
    usable reports.  (Spark's ``xpath_*`` would parse the document again per
    expression and throws on malformed input; measured 2x slower here.)
    """
    return F.pandas_udf(_count_all, _COUNTER_SCHEMA)(F.col(xml) if isinstance(xml, str) else xml)


# ---------------------------------------------------------------- regular reports, without a parser
# Values of attributes: no markup, no control characters, and only the five entities every parser knows.  The class names
# what it takes, letters and digits first: as a negated class (all but ", <, &, \\x00-\\x1F, \\uFFFE, \\uFFFF) it is several times slower.
_PLAIN = "[\\x3D-\\uFFFD\\x27-\\x3B\\x20\\x21\\x23-\\x25\\x{10000}-\\x{10FFFF}]*+"
_VALUE = f'"{_PLAIN}(?:&(?:lt|gt|amp|quot|apos);{_PLAIN})*+"'
_NUMBER = '"[0-9]{1,9}+"'                     # sums of such numbers stay within 64 bits
_GAP = "[ \\t\\r\\n]*+"


def _element(name: str, attributes: str, *children: str) -> str:
    """Pattern of an element with exactly these attributes, in this order, and any number of the children.

    Every repetition is possessive: it runs as a loop, so neither time nor stack grows with a report faster than its length.
    """
    begin = f"<{name}{attributes}{_GAP}"
    if not children:
        return f"{begin}/>"
    return f"{begin}(?:/>|>{_GAP}(?:(?:{'|'.join(children)}){_GAP})*+</{name}{_GAP}>)"


def _attributes(**values: str) -> str:
    return "".join(f" {name}={value}" for name, value in values.items())


def _report_pattern() -> str:
    named = _attributes(name=_VALUE)
    counter = _element("counter", _attributes(type='"[A-Z]++"', missed=_NUMBER, covered=_NUMBER))
    line = _element("line", _attributes(nr=_NUMBER, mi=_NUMBER, ci=_NUMBER, mb=_NUMBER, cb=_NUMBER))
    method = _element("method", _attributes(name=_VALUE, desc=_VALUE) + f"(?: line={_VALUE})?+", counter)
    class_ = _element("class", named + f"(?: sourcefilename={_VALUE})?+", method, counter)
    source = _element("sourcefile", named, line, counter)
    package = _element("package", named, class_, source, counter)
    group = _element("group", named, package, counter)
    session = _element("sessioninfo", _attributes(id=_VALUE, start=_VALUE, dump=_VALUE))
    prolog = '(?:<\\?xml version="1\\.0" encoding="UTF-8"(?: standalone="(?:yes|no)")?+\\?>)?+'
    doctype = '(?:<!DOCTYPE report PUBLIC "[A-Za-z0-9 /.-]*+" "[A-Za-z0-9/.:-]*+">)?+'
    report = _element("report", named, session, group, package, counter)
    return f"\\A{prolog}{_GAP}{doctype}{_GAP}{report}{_GAP}\\z"


REGULAR_REPORT = _report_pattern()


def regular_report(xml) -> Column:
    """True for a report (text or binary) that is certainly well-formed and whose counters ``regular_counters`` reads.

    False means "not proved": the report may still be well-formed.  NULL gives False.
    """
    text = (F.col(xml) if isinstance(xml, str) else xml).cast("string")
    return F.coalesce(F.is_valid_utf8(text) & text.rlike(REGULAR_REPORT), F.lit(False))


def regular_counters(xml) -> Column:
    """The four sums of ``coverage_counters`` of a regular report, as a struct, by column functions."""
    text = (F.col(xml) if isinstance(xml, str) else xml).cast("string")

    def total(kind: str, group: int) -> Column:
        found = F.regexp_extract_all(text, F.lit(f'<counter type="{kind}" missed="([0-9]+)" covered="([0-9]+)"'), F.lit(group))
        return F.aggregate(found, F.lit(0).cast("bigint"), lambda acc, n: acc + n.cast("bigint"))

    return F.struct(*[total(t, i + 1).alias(f"{t.lower()}_{a}") for t in COVERAGE_TYPES for i, a in enumerate(("missed", "covered"))])
