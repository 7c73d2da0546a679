"""Chat formatting with a template compiler.

A small sandboxed template language is parsed into a syntax tree, constants are
folded, and the tree is turned into Python closures that render conversations
and note where generated text stands (the loss mask).

    {{ expression }}                       output (null is nothing)
    {% for x in expression %} ... {% endfor %}
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% set name = expression %}
    {% generation %} ... {% endgeneration %}     what a model is trained to write
    {# comment #}

Expressions: strings, numbers, true, false, none, names, ``a.b``, ``a[e]``, ``not and or``,
``== != < <= > >= in``, ``+ - * %``, ``~`` (joins as text), ``e if e else e`` and filters
``e | name(arguments)`` out of FILTERS.  Names and items come from the data given; ``a.b`` is the
item ``b`` of a mapping.  There is no call, no attribute of an object and no import, so a
template cannot reach anything else.  In a loop ``loop.index0``, ``loop.first`` and ``loop.last``
are known.

The default template marks turns with ``### Role:`` and ``</turn>``; the filter ``escape`` makes
roles and texts free of these marks, reversibly.

Conversations may be of any length: a template that loops over the turns is rendered turn by turn, by as
many tasks as the turns fill, and cut into pieces of about PIECE code points at turn ends, so no
conversation is held whole.

Defined cases: null text and null role are empty; turns are ordered by turn (null first), ties by
role and text; rows that repeat are turns like any other; rows with null conv_id form one
conversation; an empty table gives no rows; only conv_id, turn, role and text are read, so other
columns may have any name (a template of another shape sees no further column either).
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import groupby
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import prepare
from runlens.operators._plan import running_sum

PIECE = 1 << 18

DEFAULT = ("{% for m in turns %}### {{ m.role | escape }}:\n"
           "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
           "{% else %}{{ m.text | escape }}{% endif %}</turn>\n{% endfor %}")

# ------------------------------------------------------------------ escaping

_ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l", ":": "\\c", "\n": "\\n"}
_TO_ESCAPE = re.compile(r"[\\#<:\n]")
_UNESCAPES = {v[1]: k for k, v in _ESCAPES.items()}
_TO_UNESCAPE = re.compile(r"\\(.)", re.S)


def escape(text: str) -> str:
    """The text without ``#``, ``<``, ``:`` and line breaks, each written as a backslash and a letter."""
    return _TO_ESCAPE.sub(lambda m: _ESCAPES[m.group()], text)


def unescape(text: str) -> str:
    return _TO_UNESCAPE.sub(lambda m: _UNESCAPES[m.group(1)], text)


def _text(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


FILTERS: dict[str, Callable[..., Any]] = {
    "escape": lambda v: escape(_text(v)), "trim": lambda v: _text(v).strip(), "upper": lambda v: _text(v).upper(),
    "lower": lambda v: _text(v).lower(), "title": lambda v: _text(v).title(), "length": len,
    "default": lambda v, other="": other if v is None else v, "replace": lambda v, a, b: _text(v).replace(a, b),
}

# ------------------------------------------------------------------ parsing

_PART = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}|\{#.*?#\}", re.S)
_LEXEME = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_]\w*)"""
                     r"""|(?P<op>==|!=|<=|>=|[-+*%~<>=|.,()\[\]]))""")
_STRING_ESCAPE = re.compile(r"\\(.)", re.S)
_BINARY = ({"or"}, {"and"}, {"==", "!=", "<", "<=", ">", ">=", "in"}, {"~"}, {"+", "-"}, {"*", "%"})


class TemplateError(ValueError):
    pass


class _Expression:
    """Recursive descent over one expression; nodes are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.lexemes: list[tuple[str, str]] = []
        at, source = 0, source.rstrip()
        while at < len(source):
            m = _LEXEME.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.lexemes.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *texts: str) -> bool:
        return self.at < len(self.lexemes) and self.lexemes[self.at][0] != "str" and self.lexemes[self.at][1] in texts

    def take(self, *texts: str) -> str:
        if not self.peek(*texts):
            raise TemplateError(f"expected {' or '.join(texts)}")
        self.at += 1
        return self.lexemes[self.at - 1][1]

    def whole(self) -> tuple:
        node = self.choice()
        if self.at != len(self.lexemes):
            raise TemplateError(f"unexpected {self.lexemes[self.at][1]!r}")
        return node

    def choice(self) -> tuple:
        node = self.binary(0)
        if self.peek("if"):
            self.take("if")
            test = self.binary(0)
            self.take("else")
            return ("choice", test, node, self.choice())
        return node

    def binary(self, level: int) -> tuple:
        if level == len(_BINARY):
            return self.unary()
        node = self.binary(level + 1)
        while self.peek(*_BINARY[level]):
            node = ("binary", self.take(*_BINARY[level]), node, self.binary(level + 1))
        return node

    def unary(self) -> tuple:
        if self.peek("not", "-"):
            return ("unary", self.take("not", "-"), self.unary())
        node = self.atom()
        while self.peek(".", "[", "|"):
            mark = self.take(".", "[", "|")
            if mark == "[":
                node = ("item", node, self.choice())
                self.take("]")
                continue
            if self.at >= len(self.lexemes) or self.lexemes[self.at][0] != "name":
                raise TemplateError("expected a name")
            name = self.lexemes[self.at][1]
            self.at += 1
            if mark == ".":
                node = ("item", node, ("value", name))
                continue
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name}")
            arguments = []
            if self.peek("("):
                self.take("(")
                while not self.peek(")"):
                    arguments.append(self.choice())
                    if not self.peek(")"):
                        self.take(",")
                self.take(")")
            node = ("filter", name, node, tuple(arguments))
        return node

    def atom(self) -> tuple:
        if self.at >= len(self.lexemes):
            raise TemplateError("an expression ends too soon")
        kind, text = self.lexemes[self.at]
        self.at += 1
        if kind == "num":
            return ("value", float(text) if "." in text else int(text))
        if kind == "str":
            return ("value", _STRING_ESCAPE.sub(lambda m: {"n": "\n", "t": "\t"}.get(m.group(1), m.group(1)), text[1:-1]))
        if kind == "name":
            constants = {"true": True, "false": False, "none": None}
            return ("value", constants[text]) if text in constants else ("name", text)
        if text == "(":
            node = self.choice()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> tuple:
    """Syntax tree of a template: ("block", nodes)."""
    parts: list[tuple[str, str]] = []
    at = 0
    for m in _PART.finditer(source):
        if m.start() > at:
            parts.append(("text", source[at:m.start()]))
        if m.group(1) is not None:
            parts.append(("out", m.group(1)))
        elif m.group(2) is not None:
            parts.append(("tag", m.group(2).strip()))
        at = m.end()
    if at < len(source):
        parts.append(("text", source[at:]))
    position = 0

    def block(*ends: str) -> tuple[tuple, str]:
        nonlocal position
        nodes = []
        while position < len(parts):
            kind, body = parts[position]
            position += 1
            if kind == "text":
                nodes.append(("text", body))
            elif kind == "out":
                nodes.append(("out", _Expression(body).whole()))
            else:
                word, _, rest = body.partition(" ")
                if word in ends:
                    return ("block", tuple(nodes)), body
                nodes.append(tag(word, rest.strip()))
        if ends:
            raise TemplateError(f"missing {' or '.join(ends)}")
        return ("block", tuple(nodes)), ""

    def tag(word: str, rest: str) -> tuple:
        if word == "for":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read for {rest}")
            return ("for", m.group(1), _Expression(m.group(2)).whole(), block("endfor")[0])
        if word == "if":
            branches, test, otherwise = [], _Expression(rest).whole(), ("block", ())
            while True:
                body, end = block("elif", "else", "endif")
                branches.append((test, body))
                if end.startswith("elif"):
                    test = _Expression(end[4:]).whole()
                    continue
                if end == "else":
                    otherwise, _ = block("endif")
                return ("if", tuple(branches), otherwise)
        if word == "set":
            m = re.fullmatch(r"([A-Za-z_]\w*)\s*=(?!=)(.+)", rest, re.S)
            if not m:
                raise TemplateError(f"cannot read set {rest}")
            return ("set", m.group(1), _Expression(m.group(2)).whole())
        if word == "generation":
            return ("generation", block("endgeneration")[0])
        raise TemplateError(f"unknown tag {word}")

    return block()[0]


# ------------------------------------------------------------------ folding

_OPERATORS: dict[str, Callable[[Any, Any], Any]] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b,
    ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b, "~": lambda a, b: _text(a) + _text(b),
    "+": lambda a, b: _number(a) + _number(b), "-": lambda a, b: _number(a) - _number(b),
    "*": lambda a, b: _number(a) * _number(b), "%": lambda a, b: _number(a) % _number(b),
}


def _number(value: Any) -> int | float:
    if not isinstance(value, (int, float)):
        raise TemplateError("arithmetic on something that is no number")
    return value


def fold(node: tuple) -> tuple:
    """The tree with constant expressions evaluated, decided branches chosen and neighbouring text joined."""
    kind = node[0]
    if kind in ("value", "name", "text"):
        return node
    if kind == "binary":
        _, op, a, b = node[0], node[1], fold(node[2]), fold(node[3])
        if op in ("and", "or"):
            if a[0] == "value":
                return b if bool(a[1]) == (op == "and") else a
        elif a[0] == b[0] == "value":
            return ("value", _OPERATORS[op](a[1], b[1]))
        return ("binary", op, a, b)
    if kind == "unary":
        a = fold(node[2])
        return ("value", (not a[1]) if node[1] == "not" else -a[1]) if a[0] == "value" else ("unary", node[1], a)
    if kind == "choice":
        test, a, b = map(fold, node[1:])
        return (a if test[1] else b) if test[0] == "value" else ("choice", test, a, b)
    if kind == "item":
        return ("item", fold(node[1]), fold(node[2]))
    if kind == "filter":
        a, arguments = fold(node[2]), tuple(map(fold, node[3]))
        if all(x[0] == "value" for x in (a, *arguments)):
            return ("value", FILTERS[node[1]](a[1], *(x[1] for x in arguments)))
        return ("filter", node[1], a, arguments)
    if kind == "out":
        a = fold(node[1])
        return ("text", _text(a[1])) if a[0] == "value" else ("out", a)
    if kind == "for":
        return ("for", node[1], fold(node[2]), fold(node[3]))
    if kind == "set":
        return ("set", node[1], fold(node[2]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    if kind == "if":
        branches = []
        for test, body in node[1]:
            test, body = fold(test), fold(body)
            if test[0] == "value" and not test[1]:
                continue
            if test[0] == "value":
                return ("if", tuple(branches), body) if branches else body
            branches.append((test, body))
        return ("if", tuple(branches), fold(node[2])) if branches else fold(node[2])
    nodes: list[tuple] = []
    for child in map(fold, node[1]):
        for part in child[1] if child[0] == "block" else (child,):
            if part == ("text", ""):
                continue
            if part[0] == "text" and nodes and nodes[-1][0] == "text":
                nodes[-1] = ("text", nodes[-1][1] + part[1])
            else:
                nodes.append(part)
    return ("block", tuple(nodes))


# ------------------------------------------------------------------ closures

class Output:
    """Rendered text with the [start, end) places of generated text."""

    def __init__(self):
        self.parts: list[str] = []
        self.size = 0
        self.spans: list[tuple[int, int]] = []

    def put(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def cut(self) -> tuple[str, list[tuple[int, int]]]:
        done = "".join(self.parts), self.spans
        self.parts, self.size, self.spans = [], 0, []
        return done


def _value(node: tuple) -> Callable[[dict], Any]:
    kind = node[0]
    if kind == "value":
        constant = node[1]
        return lambda scope: constant
    if kind == "name":
        name = node[1]
        return lambda scope: scope.get(name)
    if kind == "item":
        of, key = _value(node[1]), _value(node[2])

        def item(scope: dict) -> Any:
            whole, k = of(scope), key(scope)
            if isinstance(whole, dict):
                return whole.get(k)
            if isinstance(whole, (list, tuple, str)) and isinstance(k, int):
                return whole[k] if -len(whole) <= k < len(whole) else None
            return None

        return item
    if kind == "filter":
        act, of, arguments = FILTERS[node[1]], _value(node[2]), [_value(a) for a in node[3]]
        return lambda scope: act(of(scope), *(a(scope) for a in arguments))
    if kind == "unary":
        of = _value(node[2])
        return (lambda scope: not of(scope)) if node[1] == "not" else (lambda scope: -of(scope))
    if kind == "choice":
        test, a, b = map(_value, node[1:])
        return lambda scope: a(scope) if test(scope) else b(scope)
    a, b = _value(node[2]), _value(node[3])
    if node[1] == "and":
        return lambda scope: a(scope) and b(scope)
    if node[1] == "or":
        return lambda scope: a(scope) or b(scope)
    act = _OPERATORS[node[1]]
    return lambda scope: act(a(scope), b(scope))


def _plain(node: tuple) -> Callable[[dict, Output], None] | None:
    """A closure for nodes without a loop."""
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda scope, out: out.put(text)
    if kind == "out":
        of = _value(node[1])
        return lambda scope, out: out.put(_text(of(scope)))
    if kind == "set":
        name, of = node[1], _value(node[2])
        return lambda scope, out: scope.__setitem__(name, of(scope))
    if kind == "block":
        steps = [_plain(n) for n in node[1]]
        if None in steps:
            return None

        def block(scope: dict, out: Output) -> None:
            for s in steps:
                s(scope, out)

        return block
    if kind == "generation":
        body = _plain(node[1])
        if body is None:
            raise TemplateError("a loop inside generation")

        def generation(scope: dict, out: Output) -> None:
            start = out.size
            body(scope, out)
            if out.size > start:
                out.spans.append((start, out.size))

        return generation
    if kind == "if":
        branches, otherwise = [(_value(t), _plain(b)) for t, b in node[1]], _plain(node[2])
        if otherwise is None or any(b is None for _, b in branches):
            return None

        def either(scope: dict, out: Output) -> None:
            for test, body in branches:
                if test(scope):
                    return body(scope, out)
            otherwise(scope, out)

        return either
    return None


def _statement(node: tuple) -> Callable[[dict, Output], Iterator[None]]:
    """A generator closure; it pauses behind each turn of a loop, where the output may be cut."""
    plain = _plain(node)
    if plain is not None:
        def simple(scope: dict, out: Output) -> Iterator[None]:
            plain(scope, out)
            return iter(())

        return simple
    kind = node[0]
    if kind == "block":
        steps = [_statement(n) for n in node[1]]

        def block(scope: dict, out: Output) -> Iterator[None]:
            for s in steps:
                yield from s(scope, out)

        return block
    if kind == "if":
        branches, otherwise = [(_value(t), _statement(b)) for t, b in node[1]], _statement(node[2])

        def either(scope: dict, out: Output) -> Iterator[None]:
            for test, body in branches:
                if test(scope):
                    yield from body(scope, out)
                    return
            yield from otherwise(scope, out)

        return either
    name, of, body = node[1], _value(node[2]), _statement(node[3])

    def loop(scope: dict, out: Output) -> Iterator[None]:
        items = iter(of(scope) or ())
        index, missing = 0, object()
        now = next(items, missing)
        while now is not missing:
            then = next(items, missing)
            own = dict(scope, **{name: now, "loop": {"index0": index, "first": index == 0, "last": then is missing}})
            yield from body(own, out)
            yield
            now, index = then, index + 1

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self._run = _statement(self.tree)

    def pieces(self, turns: Iterable[dict], limit: int = PIECE) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """(text, generated spans) pieces of one conversation, cut between turns."""
        out = Output()
        for _ in self._run({"turns": turns}, out):
            if out.size >= limit:
                yield out.cut()
        if out.size:
            yield out.cut()

    def by_turn(self) -> TurnRenderer | None:
        """The template as text before the loop over ``turns``, one turn, and text behind it; None for other shapes."""
        nodes = self.tree[1]
        loops = [i for i, n in enumerate(nodes) if n[0] == "for" and n[2] == ("name", "turns")]
        if len(loops) != 1:
            return None
        i = loops[0]
        before, after = ("block", nodes[:i]), ("block", nodes[i + 1:])
        if _plain(before) is None or _plain(after) is None or _mentions((before, after, nodes[i][3]), ("name", "turns")):
            return None
        return TurnRenderer(_plain(before), nodes[i][1], _statement(nodes[i][3]), _plain(after),
                            bool(after[1]) or _mentions(nodes[i][3], ("value", "last")))

    def render(self, turns: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        text, spans, size = [], [], 0
        for t, s in self.pieces(turns):
            text.append(t)
            spans += [(a + size, b + size) for a, b in s]
            size += len(t)
        return "".join(text), spans


def _mentions(tree: tuple, node: tuple) -> bool:
    return tree == node or any(_mentions(x, node) for x in tree if isinstance(x, tuple))


class TurnRenderer:
    """Renders one turn by itself, given its number and whether it is the last."""

    def __init__(self, before, name: str, body, after, needs_last: bool):
        self._before, self._name, self._body, self._after, self.needs_last = before, name, body, after, needs_last

    def __call__(self, out: Output, turn: dict, index: int, last: bool) -> None:
        scope: dict = {}
        self._before(scope, out if index == 0 else Output())
        own = dict(scope, **{self._name: turn, "loop": {"index0": index, "first": index == 0, "last": last}})
        for _ in self._body(own, out):
            pass
        if last:
            self._after(scope, out)


@lru_cache(maxsize=16)
def template(source: str) -> Template:
    return Template(source)


_TURN = re.compile(r"### ([^:]*):\n([^\n]*?)</turn>\n")


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of text written with the default template (whole turns)."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not a formatted conversation")
        out.append((unescape(m.group(1)), unescape(m.group(2))))
        at = m.end()
    return out


# ------------------------------------------------------------------ operators

_PIECES = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("formatted", pa.string()),
                     ("loss", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])


def _conversations(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Runs of rows with one conv_id out of sorted batches, each as a stream."""
    rows = (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in columns)))
    return ((key, run) for key, run in groupby(rows, key=lambda r: r[0]))


def format_conversations(turns: DataFrame, source: str = DEFAULT) -> DataFrame:
    """conv_id, piece, formatted, loss (spans inside the piece) of every conversation; pieces in order make the text.

    ``turns`` has conv_id, turn, role, text.  A template that is one loop over the turns, with fixed text
    around it, is rendered turn by turn: turns get their number by a running count over ranges of
    (conv_id, turn), so a conversation with a third of all rows is rendered by many tasks (the count
    runs at the time of the call).  Any other template needs the conversation as a stream: a task then
    reads it in order, a piece at a time.
    """
    prepare(turns.sparkSession)
    renderer = template(source).by_turn()                   # a bad template fails here, not in a task
    rows = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    ddl = "conv_id long, piece long, formatted string, loss array<struct<start: bigint, end: bigint>>"
    if renderer is None:
        return (rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
                .mapInArrow(_streamed(source), ddl))
    numbered = running_sum(rows.withColumn("_one", F.lit(1).cast("long")), ["conv_id"], ["turn", "role", "text"], "_one", "index")
    if renderer.needs_last:
        size = numbered.groupBy(F.col("conv_id").alias("_of")).agg(F.count("*").alias("_turns"))
        numbered = numbered.join(size, F.col("conv_id").eqNullSafe(F.col("_of"))).withColumn("last", F.col("index") == F.col("_turns") - 1)
    else:
        numbered = numbered.withColumn("last", F.lit(False))
    return numbered.select("conv_id", "index", "role", "text", "last").mapInArrow(_turn_by_turn(source), ddl)


def _turn_by_turn(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = template(source).by_turn()
        out, at, nxt, held = Output(), None, None, []

        def close() -> None:
            text, spans = out.cut()
            held.append((*at, text, [{"start": a, "end": b} for a, b in spans]))

        for batch in batches:
            for conv, index, role, text, last in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "index", "role", "text", "last"))):
                if at is not None and (nxt != (conv, index) or out.size >= PIECE):
                    close()
                    at = None
                at = at or (conv, index)
                nxt = (conv, index + 1)
                render(out, {"role": role or "", "text": text or ""}, index, last)
            if held:
                yield _batch(held)
                held.clear()
        if at is not None:
            close()
            yield _batch(held)

    return run


def _streamed(source: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = template(source)
        held: list[tuple] = []
        for conv, rows in _conversations(batches, ["conv_id", "role", "text"]):
            for n, (text, spans) in enumerate(compiled.pieces({"role": r or "", "text": t or ""} for _, r, t in rows)):
                held.append((conv, n, text, [{"start": a, "end": b} for a, b in spans]))
                if len(held) >= 64:
                    yield _batch(held)
                    held = []
        if held:
            yield _batch(held)

    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(zip(*rows), _PIECES)], schema=_PIECES)


_READ = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                   ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of what formatted conversations (default template) hold, read from their text and spans alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv, pieces in _conversations(batches, ["conv_id", "formatted", "loss"]):
            turns, loss = hashlib.sha256(), hashlib.sha256()
            n_turns = loss_chars = chars = 0
            for _, text, spans in pieces:
                chars += len(text)
                for role, said in read_turns(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))
                for s in spans:
                    own = unescape(text[s["start"]:s["end"]])
                    loss_chars += len(own)
                    loss.update(own.encode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(
                (conv, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars), _READ)], schema=_READ)

    return (formatted.repartition("conv_id").sortWithinPartitions("conv_id", "piece").select("conv_id", "formatted", "loss")
            .mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"))
