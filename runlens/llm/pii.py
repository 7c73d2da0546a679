"""Personal data: base patterns and bootstrapped contextual extraction.

Base kinds (leftmost, not overlapping, per kind): email, ip, card (Luhn), phone;
a match that fails its check is dropped and not tried again.

The method then learns from context.  Base entities are *seeds*.  Seeds and all
other identifier-like tokens (at least 10 of ``[A-Za-z0-9_-]``, three digits or
more) are *instances*; the words around an instance are its lexical *patterns*:
the word before, the two words before, the word behind, and the key in the same
token (``password=``).  Spark scores the pattern-instance graph in rounds: a
pattern is as trustworthy as its instances are on average (shrunk by SHRINK
imaginary wrong ones), an instance that is no seed is as certain as its patterns
make it (noisy or).  Trust thus passes from seeds to the words around them, to
unseen identifiers beside the same words, to the keys of those, and on.
Identifiers introduced by a pattern of high confidence and enough support are
further spans of kind ``id``.  Shorter tokens (6 to 9 characters, three digits or
more) take no part in learning, but are spans too where such a pattern introduces
them.  Words of context are looked for within 60 code points of a token.

Texts are read once and only candidate rows (never texts) are shuffled; scores
are summed before each exchange.

Defined cases: null is the empty text and has no spans; rows that repeat are
searched row by row; a copy adds no weight to the graph (its edges are
distinct); offsets are code points, the end exclusive; a text of any length is
searched in time linear in it; an empty table gives no rows.  Only doc_id and
text are read; ``redacted`` hands on all columns, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import prepare, text_slices, written

KINDS = ("email", "ip", "card", "phone")
FOUND = "id"
SHRINK = 3.0
ROUNDS = 4
CONFIDENCE = 0.6
SUPPORT = 5

_DIGIT = re.compile(r"[0-9]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_TOKEN = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")       # a run of digits is tried once, at its start
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[0-9]+")
_KEY = re.compile(r"[A-Za-z_]+[\"']?[=:][\"']?$")
_BEFORE = re.compile(r"(\S+)\s+(\S+)\s*$|(\S+)\s*$")
_BEHIND = re.compile(r"[\"']?\s*(\S+)")
#: Least lengths of a token that teaches and of one that a trusted pattern may introduce, and least digits of both.
LEARNING, SHORT, DIGITS = 10, 6, 3
_CONTEXT = 60           # code points on either side in which context words are looked for


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _octet(part: str) -> bool:
    digits = part.lstrip("0")
    return len(digits) <= 3 and int(digits or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base entities, sorted."""
    out: list[tuple[int, int, int]] = []
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        nxt = at + 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((start, 0, m.end()))
            last = nxt = m.end()
        at = text.find("@", nxt)
    if _DIGIT.search(text):
        out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(map(_octet, m.group().split(".")))]
        for m in _CARD.finditer(text):
            if m.end() - m.start() >= 14 and 14 <= len(d := m.group().replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(map(len, _NUMBER.findall(m.group()))) <= 15:
                    out.append((m.start(), 3, m.end()))
    return sorted(out)


def other_tokens(text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Tokens outside the base entities that may be identifiers, the short ones too."""
    out: list[tuple[int, int]] = []
    taken = iter([*sorted((s, e) for s, _, e in base), (len(text) + 1, len(text) + 1)])
    s, e = next(taken)
    upto = 0
    for m in _NUMBER.finditer(text):
        if m.start() < upto:
            continue
        start, upto = m.start(), m.end()
        while start > 0 and text[start - 1] in _TOKEN:
            start -= 1
        while upto < len(text) and text[upto] in _TOKEN:
            upto += 1
        while e <= start:
            s, e = next(taken)
        if upto <= s and upto - start >= SHORT and sum(map(len, _NUMBER.findall(text, start, upto))) >= DIGITS:
            out.append((start, upto))
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns around a span."""
    before = text[max(0, start - _CONTEXT):start]
    out = []
    if key := _KEY.search(before):
        out.append("key " + key.group().lower())
        before = before[:key.start()]
    if m := _BEFORE.search(before.rstrip("\"'")):
        near = (m.group(2) or m.group(3)).lower()
        out.append("before " + near)
        if m.group(1):
            out.append(f"before {m.group(1).lower()} {near}")
    if m := _BEHIND.match(text, end, end + _CONTEXT):
        out.append("behind " + m.group(1).lower())
    return out


def _instance(kind: str, value: str) -> int:
    return int.from_bytes(hashlib.blake2b(f"{kind}\0{value}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.string()), ("end", pa.int64())])
_CANDIDATE = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("seed", pa.bool_()),
                        ("teaches", pa.bool_()), ("patterns", pa.list_(pa.string()))])
_DDL = ("row long, base array<struct<start: bigint, kind: string, end: bigint>>, "
        "candidates array<struct<start: bigint, end: bigint, instance: bigint, seed: boolean, teaches: boolean, patterns: array<string>>>")


def candidates(docs: DataFrame, carry: list[str]) -> DataFrame:
    """The ``carry`` columns of every row with a row number, its base spans and its candidates; written to the shared folder."""
    prepare(docs.sparkSession)
    wanted = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)]
    rows = docs.select(F.col("text").alias("the_text"), *wanted)
    fields = ", ".join(f"c{i} {docs.schema[c].dataType.simpleString()}" for i, c in enumerate(carry))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33      # fixed once the rows are written, which happens at once
        for part in text_slices(batches, "the_text"):
            numbers, bases, found = [], [], []
            for text in part.column("the_text").to_pylist():
                text = text or ""
                base = base_spans(text)
                here = [(s, e, _instance(KINDS[k], text[s:e]), True, True, patterns(text, s, e)) for s, k, e in base]
                if _DIGIT.search(text):
                    here += [(s, e, _instance(FOUND, text[s:e]), False, e - s >= LEARNING, patterns(text, s, e)) for s, e in other_tokens(text, base)]
                numbers.append(row)
                row += 1
                bases.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in base])
                found.append([dict(zip(("start", "end", "instance", "seed", "teaches", "patterns"), x)) for x in here])
            yield pa.RecordBatch.from_arrays(
                [*part.columns[1:], pa.array(numbers, type=pa.int64()), pa.array(bases, type=pa.list_(_SPAN)),
                 pa.array(found, type=pa.list_(_CANDIDATE))],
                names=[*part.schema.names[1:], "row", "base", "candidates"])

    return written(rows.mapInArrow(run, f"{fields}, {_DDL}" if carry else _DDL), "pii-candidates")


def trusted_patterns(found: DataFrame) -> DataFrame:
    """pattern, confidence, support of the patterns that the graph ends up trusting."""
    edges = written(found.select(F.explode("candidates").alias("c")).where("c.teaches").select("c.instance", "c.seed", F.explode("c.patterns").alias("pattern"))
                    .distinct(), "pii-edges")
    score = edges.groupBy("instance").agg(F.max("seed").cast("double").alias("score"))
    for last in [False] * (ROUNDS - 1) + [True]:
        trust = written(edges.join(score, "instance").groupBy("pattern").agg(
            (F.sum("score") / (F.count("*") + SHRINK)).alias("confidence"), F.count("*").alias("support")), "pii-patterns")
        if not last:
            score = edges.join(trust, "pattern").groupBy("instance").agg(
                F.when(F.max("seed"), 1.0).otherwise(1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("score"))
    return trust.where((F.col("confidence") >= CONFIDENCE) & (F.col("support") >= SUPPORT))


def discovered(found: DataFrame) -> DataFrame:
    """row and the spans that trusted patterns introduce (one row for each row that has any)."""
    other = (found.select("row", F.explode("candidates").alias("c")).where("not c.seed")
             .select("row", "c.start", "c.end", F.explode("c.patterns").alias("pattern")))
    return (other.join(trusted_patterns(found), "pattern", "left_semi")
            .groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(FOUND).alias("kind"), "end"))).alias("more")))


def _said(spans):
    """kind:start:end of spans by start, then kind as listed."""
    kinds = F.array(*map(F.lit, (*KINDS, FOUND)))
    ordered = F.transform(F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"], F.array_position(kinds, s["kind"]).alias("nth"), s["end"], s["kind"]))),
                          lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))
    return F.array_join(ordered, ",")


def _number(kind: str):
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, n_found, base_sha256, spans of every row."""
    found = candidates(docs.select(F.col("doc_id").cast("long"), "text"), ["doc_id"])
    joined = found.select("c0", "row", "base").join(discovered(found), "row", "left")
    spans = F.coalesce(F.concat("base", "more"), "base")
    return joined.select(
        F.col("c0").alias("doc_id"),
        *[_number(k).alias(f"n_{k}") for k in KINDS],
        F.coalesce(F.size("more"), F.lit(0)).cast("long").alias("n_found"),
        F.sha2(_said(F.col("base")), 256).alias("base_sha256"), _said(spans).alias("spans"))


def redact_text(text: str, spans: list[tuple[int, str, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans become one, named by the first."""
    out, at = [], 0
    for start, kind, end in sorted(spans):
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame) -> DataFrame:
    """``docs`` (all columns, every row) with personal data replaced by ``[EMAIL]``, ``[IP]``, ``[CARD]``, ``[PHONE]``, ``[ID]``.

    Texts without personal data stay as they are; ``n_chars`` follows a changed text if the table has it.
    """
    columns = docs.columns
    found = candidates(docs, columns)
    joined = found.drop("candidates").join(discovered(found), "row", "left")
    at, size = columns.index("text"), columns.index("n_chars") if "n_chars" in columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, f"c{at}"):
            own = [part.column(f"c{i}") for i in range(len(columns))]
            spans = [(a or []) + (b or []) for a, b in zip(part.column("base").to_pylist(), part.column("more").to_pylist())]
            if any(spans):
                texts = [redact_text(t, [(x["start"], x["kind"], x["end"]) for x in s]) if s else t
                         for t, s in zip(own[at].to_pylist(), spans)]
                own[at] = pa.array(texts, type=own[at].type)
                if size is not None:
                    own[size] = pa.array([len(t) if s else n for t, s, n in zip(texts, spans, own[size].to_pylist())], type=own[size].type)
            yield pa.RecordBatch.from_arrays(own, schema=pa.schema([pa.field(c, a.type) for c, a in zip(columns, own)]))

    return joined.select(*[f"c{i}" for i in range(len(columns))], "base", "more").mapInArrow(run, docs.schema)
