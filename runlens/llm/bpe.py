"""Byte-level BPE encoding and decoding with vectorised pre-tokenisation.

Pre-tokenisation finds the matches of the public byte-level pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

without a regex engine: every code point becomes a class (numpy table), the
look-ahead of the pattern (next code point blank or not, contraction endings)
is folded into the class by shifted comparisons, and a small automaton over
these classes says where a match begins.  The automaton is not stepped code
point by code point: the functions "state before -> state after" of all class
sequences form a finite monoid, and an associative prefix scan over monoid
elements (blocked: within blocks, then across blocks) yields the state in front
of every code point.  The slices feed pair merging by rank, cached per slice;
the offsets stay available for decoding and for token spans.

Texts: null is encoded as the empty text, an empty text has no tokens.  Any
length works: a long text is scanned in the same array passes and a long slice
is merged with a heap in O(n log n).  Repeated rows are encoded row by row (ties
of ranks go to the leftmost pair); an empty table gives no rows; only doc_id and
text are read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterable, Iterator
from functools import cached_property, lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm._common import rows_batch, text_slices
from runlens.llm._slices import SliceTable

# Classes of a code point in its context.
_LETTER, _NUMBER, _OTHER, _SHORT, _LONG, _LEAD, _LAST, _BLANK, _RESET = range(9)
# States: what the match in front of the code point is.
_START, _IN_L, _IN_N, _IN_O, _IN_S, _AFTER_SPACE, _ONE_MORE, _TWO_MORE = range(8)
_SCAN_BLOCK = 64
_SHORT_SLICE = 96      # bytes; longer slices are merged one by one with a heap
_MERGE_CELLS = 1 << 18  # bytes (with filling) that are merged in one pass
_NO_PAIR = np.iinfo(np.int32).max


def _step(state: int, cls: int) -> tuple[int, bool]:
    """(next state, does a match begin here) of the pattern's automaton."""
    if cls == _RESET:
        return _START, True
    if state == _TWO_MORE:
        return _ONE_MORE, False
    if state == _ONE_MORE:
        return _START, False
    if cls in (_LETTER, _NUMBER):
        own = _IN_L if cls == _LETTER else _IN_N
        return own, state not in (own, _AFTER_SPACE)
    if cls in (_OTHER, _SHORT, _LONG):
        if state in (_IN_O, _AFTER_SPACE):
            return _IN_O, False
        return {_OTHER: _IN_O, _SHORT: _ONE_MORE, _LONG: _TWO_MORE}[cls], True
    if cls == _LEAD:
        return _AFTER_SPACE, True
    if cls == _LAST:
        return _START, True
    return _IN_S, state != _IN_S


@lru_cache(maxsize=1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(element of each class, product table, state reached from START, begins[state, class])."""
    classes = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    while todo:
        f = todo.pop()
        for g in classes:
            h = tuple(g[x] for x in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    names = list(elements)
    product = np.array([[elements[tuple(g[x] for x in f)] for g in names] for f in names], dtype=np.uint16)
    begins = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)], dtype=bool)
    return (np.array([elements[c] for c in classes], dtype=np.uint16), product,
            np.array([f[_START] for f in names], dtype=np.uint8), begins)


def _scan(elements: np.ndarray, product: np.ndarray) -> np.ndarray:
    """Inclusive prefix products of monoid elements: in blocks, across blocks, and put together."""
    n = len(elements)
    if n <= _SCAN_BLOCK:
        out = elements.copy()
        for i in range(1, n):
            out[i] = product[out[i - 1], elements[i]]
        return out
    blocks = -(-n // _SCAN_BLOCK)
    width = len(product)
    flat = product.ravel()
    grid = np.zeros(blocks * _SCAN_BLOCK, dtype=np.uint16)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(blocks, _SCAN_BLOCK).T)
    for i in range(1, _SCAN_BLOCK):
        np.take(flat, grid[i - 1].astype(np.int32) * width + grid[i], out=grid[i])
    before = np.zeros(blocks, dtype=np.int32)
    before[1:] = _scan(grid[-1], product)[:-1]
    grid = np.take(flat, before[None, :] * width + grid)
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


@lru_cache(maxsize=1)
def _class_table() -> np.ndarray:
    """Class of every code point: letter, number, blank or other, as the tiktoken library's own Unicode tables say."""
    import tiktoken

    everything = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
    table = np.full(0x110000, _OTHER, dtype=np.uint8)
    bytes_only = {bytes([i]): i for i in range(256)}
    for pattern, cls in ((r"\p{L}", _LETTER), (r"\p{N}", _NUMBER), (r"\s", _BLANK)):
        enc = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=bytes_only, special_tokens={})
        found = enc.decode(enc.encode_ordinary(everything))
        table[np.frombuffer(found.encode("utf-32-le"), dtype=np.uint32)] = cls
    return table


def boundaries(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Match starts of all texts at once.

    Returns the code points of the texts joined by one U+0000 each, the starts of matches in them
    (ascending, the joining places excluded) and the start of each text.
    """
    joined = "\0".join(texts)
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    first = np.concatenate(([0], np.cumsum(lengths + 1)[:-1])).astype(np.int64)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    if not len(points):
        return points, np.empty(0, dtype=np.int64), first
    cls = _class_table()[points]
    joints = first[1:] - 1
    cls[joints] = _RESET
    blank = cls == _BLANK
    end = np.ones(len(cls) + 1, dtype=bool)        # end of text behind this place
    end[:-1] = cls == _RESET
    before_word = blank & ~np.append(blank[1:], True) & ~end[1:]
    cls[before_word] = _LAST
    cls[before_word & (points == 0x20)] = _LEAD
    quote = np.flatnonzero(points == 0x27)
    if len(quote):
        padded = np.concatenate((points, np.zeros(2, dtype=np.uint32)))
        one, two = padded[quote + 1], padded[quote + 2]
        cls[quote[np.isin(one, [ord(c) for c in "stmd"])]] = _SHORT
        cls[quote[(np.isin(one, [ord("r"), ord("v")]) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]] = _LONG
    element, product, from_start, begins = _monoid()
    states = from_start[_scan(element[cls], product)]
    state_before = np.empty_like(states)
    state_before[0] = _START
    state_before[1:] = states[:-1]
    start = begins[state_before, cls] & (cls != _RESET)
    return points, np.flatnonzero(start), first


def _slots(keys: np.ndarray, shift: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(shift)).astype(np.int64)


class ByteBpe:
    """Encoder and decoder for one rank file (base64 token and rank a line)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self._table = SliceTable(np.dtype(np.int32))

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, int]:
        """Open-addressing table (keys left id * 2^32 + right id, rank of the joined token, shift)."""
        ranks = self.ranks
        keys, values = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                if (a := ranks.get(token[:i])) is not None and (b := ranks.get(token[i:])) is not None:
                    keys.append(a << 32 | b)
                    values.append(rank)
        bits = max(4, (2 * len(keys)).bit_length())
        held = np.full(1 << bits, -1, dtype=np.int64)
        rank_of = np.full(1 << bits, _NO_PAIR, dtype=np.int32)
        todo = np.array(keys, dtype=np.int64)
        value = np.array(values, dtype=np.int32)
        slot = _slots(todo, 64 - bits)
        while len(todo):
            free = held[slot] == -1
            held[slot[free]] = todo[free]
            placed = held[slot] == todo
            rank_of[slot[placed]] = value[placed]
            todo, value, slot = todo[~placed], value[~placed], (slot[~placed] + 1) & (len(held) - 1)
        return held, rank_of, 64 - bits

    def _pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        held, rank_of, shift = self._pairs
        key = left.astype(np.int64) << 32 | right
        slot = _slots(key, shift)
        out = np.where(held[slot] == key, rank_of[slot], _NO_PAIR).astype(np.int32)
        open_ = np.flatnonzero((held[slot] != key) & (held[slot] != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & (len(held) - 1)
            at, want = held[slot[open_]], key[open_]
            hit = at == want
            out[open_[hit]] = rank_of[slot[open_[hit]]]
            open_ = open_[~hit & (at != -1)]
        return out

    def merge_many(self, pieces: list[bytes]) -> list[bytes]:
        """``merge`` for many short slices (int32 ids), slices of like length together, in bounded batches."""
        order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
        out: list[bytes] = [b""] * len(pieces)
        at = 0
        while at < len(order):
            # As many as fit if all were as long as the longest of them: lengths ascend.
            end = min(len(order), at + _MERGE_CELLS // max(1, len(pieces[order[at]])))
            while end - at > 1 and (end - at) * len(pieces[order[end - 1]]) > _MERGE_CELLS:
                end = at + max(1, min(end - at - 1, _MERGE_CELLS // len(pieces[order[end - 1]])))
            some = order[at:end]
            for i, ids in zip(some, self._merge_rows([pieces[i] for i in some])):
                out[i] = ids
            at += len(some)
        return out

    def _merge_rows(self, pieces: list[bytes]) -> list[bytes]:
        """One row per slice; every pass merges the best pair of all rows."""
        n = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        width = int(n.max(initial=1))
        column = np.arange(width)
        inside = column < n[:, None]
        part = np.zeros((len(pieces), width + 1), dtype=np.int32)
        byte_ids = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        part[:, :width][inside] = byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        alive = inside.copy()
        right = np.tile(np.arange(1, width + 2, dtype=np.int16), (len(pieces), 1))
        left = np.tile(np.arange(-1, width, dtype=np.int16), (len(pieces), 1))
        rank = np.full((len(pieces), width), _NO_PAIR, dtype=np.int32)
        paired = column + 1 < n[:, None]
        r, c = np.nonzero(paired)
        rank[r, c] = self._pair_ranks(part[r, c], part[r, c + 1])
        rows = np.arange(len(pieces))
        while len(rows):
            at = rank[rows].argmin(axis=1)
            best = rank[rows, at]
            go = best != _NO_PAIR
            rows, at, best = rows[go], at[go], best[go]
            gone = right[rows, at].astype(np.int64)
            then = right[rows, gone].astype(np.int64)
            part[rows, at] = best
            right[rows, at] = then
            left[rows, np.minimum(then, width)] = at
            alive[rows, gone] = False
            rank[rows, gone] = _NO_PAIR
            more = then < n[rows]
            rank[rows, at] = _NO_PAIR
            rank[rows[more], at[more]] = self._pair_ranks(best[more], part[rows[more], then[more]])
            prev = left[rows, at].astype(np.int64)
            back = prev >= 0
            rank[rows[back], prev[back]] = self._pair_ranks(part[rows[back], prev[back]], best[back])
        ids = part[:, :width][alive].tobytes()
        cut = (np.concatenate(([0], np.cumsum(alive.sum(axis=1)))) * 4).tolist()
        return list(map(ids.__getitem__, map(slice, cut, cut[1:])))

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one slice: the adjacent pair of the lowest rank is merged, leftmost first, until none is left."""
        ranks = self.ranks
        if piece in ranks:
            return (ranks[piece],)
        n = len(piece)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        stop = list(range(1, n + 1))                # end of the part that begins here
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            rank, i, end = heapq.heappop(heap)
            if not alive[i] or nxt[i] >= n or stop[nxt[i]] != end:
                continue
            j = nxt[i]
            if ranks.get(piece[i:end]) != rank:
                continue
            alive[j] = False
            stop[i] = end
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                e = stop[nxt[i]]
                if (r := ranks.get(piece[i:e])) is not None:
                    heapq.heappush(heap, (r, i, e))
            if prv[i] >= 0:
                p = prv[i]
                if (r := ranks.get(piece[p:end])) is not None:
                    heapq.heappush(heap, (r, p, end))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:stop[i]]])
            i = nxt[i]
        return tuple(out)

    def _merged(self, slices: list[bytes]) -> list[bytes]:
        """int32 ids of slices."""
        short = iter(self.merge_many([x for x in slices if len(x) <= _SHORT_SLICE]))
        return [next(short) if len(x) <= _SHORT_SLICE else np.array(self.merge(x), dtype=np.int32).tobytes() for x in slices]

    def encode(self, texts: list[str], offsets: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(ids of all texts, tokens of each text, code point offset in its text of the slice of each token)."""
        points, starts, first = boundaries(texts)
        if not len(starts):
            return np.empty(0, dtype=np.int32), np.zeros(len(texts), dtype=np.int64), np.empty(0, dtype=np.int64)
        joined = "\0".join(texts).encode("utf-8", "surrogatepass")
        data = np.frombuffer(joined, dtype=np.uint8)
        owner = np.searchsorted(first, starts, side="right") - 1
        text_end = np.append(first[1:] - 1, len(points))
        ends = np.minimum(np.append(starts[1:], len(points)), text_end[owner])
        if len(data) == len(points):
            begin, end = starts, ends
        else:
            width = np.ones(len(points) + 1, dtype=np.int64)
            width[0] = 0
            for limit in (0x80, 0x800, 0x10000):
                width[1:] += points >= limit
            at = np.cumsum(width)
            begin, end = at[starts], at[ends]
        ids, each = self._table.values(data, begin, end, self._merged)
        counts = np.bincount(owner, weights=each, minlength=len(texts)).astype(np.int64)
        return ids, counts, np.repeat(starts - first[owner], each) if offsets else None

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def _codec(path: str) -> ByteBpe:
    return ByteBpe(path)


_ENCODED = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())),
                      ("offsets", pa.list_(pa.int32()))])


def encode(docs: DataFrame, path: str, offsets: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids and (optionally) the code point offset of each token's slice; one row per input row."""
    schema = _ENCODED if offsets else pa.schema([f for f in _ENCODED if f.name != "offsets"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for part in text_slices(batches, limit=1 << 20):
            ids, counts, places = codec.encode([t or "" for t in part.column("text").to_pylist()], offsets)
            cut = pa.array(np.concatenate(([0], np.cumsum(counts))), type=pa.int32())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(counts),
                       pa.ListArray.from_arrays(cut, pa.array(ids))]
            if offsets:
                columns.append(pa.ListArray.from_arrays(cut, pa.array(places, type=pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, ids array<int>" + (", offsets array<int>" if offsets else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and the decoded bytes of every row of ``encoded`` (null ids decode to no bytes)."""
    schema = pa.schema([("doc_id", pa.int64()), ("bytes", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        for batch in batches:
            yield rows_batch({"doc_id": batch.column("doc_id").to_pylist(),
                              "bytes": [codec.decode(x or []) for x in batch.column("ids").to_pylist()]}, schema)

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, bytes binary")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """Encode, decode the ids again and digest both, without moving the ids between tasks.

    doc_id, n_tokens, ids_sha256 (decimal ids joined by one space) and decoded_sha256 (decoded
    bytes), with the ids themselves if asked for; one row per input row.
    """
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
              ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(path)
        decimal = [str(i) for i in range(len(codec.tokens))]
        for part in text_slices(batches, limit=1 << 20):
            ids, counts, _ = codec.encode([t or "" for t in part.column("text").to_pylist()], False)
            cut = np.concatenate(([0], np.cumsum(counts)))
            said, back = [], []
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                own = ids[a:b].tolist()
                said.append(hashlib.sha256(" ".join(map(decimal.__getitem__, own)).encode()).hexdigest())
                back.append(hashlib.sha256(codec.decode(own)).hexdigest())
            columns = [part.column("doc_id").cast(pa.int64()), pa.array(counts), pa.array(said), pa.array(back)]
            if with_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(cut, type=pa.int32()), pa.array(ids)))
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    ddl = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>" if with_ids else "")
    return docs.select("doc_id", "text").mapInArrow(run, ddl)
