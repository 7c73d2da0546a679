"""Benchmark decontamination with an FM-index per training shard.

A shard (about 2 MB of text) is a sequence of word codes: words of the
benchmark vocabulary have codes, runs of other words are one separator, a
document ends with a sentinel.  Its index is the Burrows-Wheeler transform of
that sequence in a wavelet matrix, the symbol counts, and every eighth suffix
position.  All phrases are searched backwards at once through wavelet ranks;
occurrences are located by stepping to the next sampled suffix; the spans of a
document are merged.

A word is a run of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` after lower-casing A-Z.
A window is ``window`` consecutive words of an item; a shorter item with at
least one word is a single window.

Defined cases: null and empty texts have no words; items without words or
without id have no windows; an item_id that repeats has the windows of all its
rows; documents that repeat are searched row by row; an empty benchmark hits
nothing and an empty corpus gives no rows.  ``contamination`` reads doc_id and text
only; ``remove_passages`` keeps all columns, whatever they are called, and changes
text and n_chars alone.  Spans that touch or overlap are one.  A document longer
than a shard is indexed in overlapping pieces.  The
benchmark is a stated query set: it is searched in blocks of bounded size, one
pass over the corpus per block.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import SLICE_BYTES, prepare, rows_batch, text_slices, written
from runlens.llm._slices import ragged, slice_keys
from runlens.llm.token_shards import WaveletMatrix

_END, _GAP, _FIRST = 0, 1, 2
_SAMPLE = 8
SHARD_BYTES = 2 << 20        # text of the documents of a shard
SHARD_WORDS = 1 << 20        # a shard has no more words: a longer document is indexed in pieces
GROUP_BYTES = 16 << 20       # text that a task searches for one block after another, if there are several
BLOCK_BYTES = 2 << 20        # text of the benchmark items that are searched in one pass (their windows take about 25 times this)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = {i: i + 32 for i in range(65, 91)}
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[65:91] += 32
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[48:58] = _IN_WORD[97:123] = _IN_WORD[128:] = True


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


def suffix_array(t: np.ndarray) -> np.ndarray:
    """Sorted suffixes of a sequence that ends with 0; suffixes end at their first 0, equal ones keep text order.

    Prefix doubling on packed 64-bit keys: the first sort orders by as many symbols as fit beside the
    place, later rounds sort only the places whose order is still open.
    """
    n = len(t)
    place_bits = max(1, (n - 1).bit_length())
    symbol_bits = max(1, int(t.max()).bit_length())
    h = max(1, min(12, (64 - place_bits) // symbol_bits))
    key = np.zeros(n, dtype=np.uint64)
    ended = np.zeros(n, dtype=bool)
    padded = np.concatenate((t, np.zeros(h, dtype=t.dtype)))
    for j in range(h):
        symbol = np.where(ended, 0, padded[j:j + n]).astype(np.uint64)
        key = key << np.uint64(symbol_bits) | symbol
        ended |= symbol == 0
    key = key << np.uint64(place_bits) | np.arange(n, dtype=np.uint64)
    key.sort()
    sa = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
    key >>= np.uint64(place_bits)
    new = np.ones(n, dtype=bool)
    new[1:] = (key[1:] != key[:-1]) | ended[sa[1:]]
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, dtype=np.int64)
    rank[sa] = group
    open_ = np.flatnonzero(~(new & np.append(new[1:], True)))
    while len(open_):
        p, g = sa[open_], group[open_]
        second = rank[p + h]
        if 3 * place_bits <= 64:
            b = np.uint64(place_bits)
            key = g.astype(np.uint64) << (b + b) | second.astype(np.uint64) << b | p.astype(np.uint64)
            key.sort()
            p = (key & np.uint64((1 << place_bits) - 1)).astype(np.int64)
            key >>= b
            new = np.ones(len(p), dtype=bool)
            new[1:] = key[1:] != key[:-1]
        else:
            order = np.lexsort((p, second, g))
            p, second, g = p[order], second[order], g[order]
            new = np.ones(len(p), dtype=bool)
            new[1:] = (g[1:] != g[:-1]) | (second[1:] != second[:-1])
        own = open_[np.maximum.accumulate(np.where(new, np.arange(len(p)), 0))]
        sa[open_], group[open_] = p, own
        rank[p] = own
        open_ = open_[~(new & np.append(new[1:], True))]
        h *= 2
    return sa


class FmIndex:
    """FM-index of one shard of word codes."""

    def __init__(self, t: np.ndarray, symbols: int):
        sa = suffix_array(t)
        self.n = len(t)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(t, minlength=symbols)))).astype(np.int64)
        self.bwt = WaveletMatrix.build(t[sa - 1], max(1, (symbols - 1).bit_length()))
        begins = np.concatenate(([_END], t[:-1])) == _END
        sampled = (sa % _SAMPLE == 0) | begins[sa]
        self._sampled = sampled
        self._nth = np.cumsum(sampled) - 1
        self._places = sa[sampled]
        self._zero = self._rank_raw(np.arange(symbols), np.zeros(symbols, dtype=np.int64))

    def _rank_raw(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        m = self.bwt
        for level in range(m.bits):
            ones = m._ones(level, at)
            at = np.where(symbol >> (m.bits - 1 - level) & 1, m._zeros[level] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol in front of each place of the transform."""
        return self._rank_raw(symbol, at) - self._zero[symbol]

    def search(self, phrases: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix range [start, end) of each phrase (rows of codes, filled up with any code); backward, all at once."""
        row = np.arange(len(phrases))
        last = phrases[row, sizes - 1]
        start, end = self.first[last].copy(), self.first[last + 1].copy()
        live = np.flatnonzero((start < end) & (sizes > 1))
        step = 2
        while len(live):
            symbol = phrases[live, sizes[live] - step]
            start[live] = self.first[symbol] + self.rank(symbol, start[live])
            end[live] = self.first[symbol] + self.rank(symbol, end[live])
            step += 1
            live = live[(start[live] < end[live]) & (sizes[live] >= step)]
        return start, end

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text places of suffix rows: steps back through the transform to a sampled suffix (text starts are sampled)."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        todo = np.flatnonzero(~self._sampled[rows])
        while len(todo):
            symbol = self.bwt.access(rows[todo])
            rows[todo] = self.first[symbol] + self.rank(symbol, rows[todo])
            steps[todo] += 1
            todo = todo[~self._sampled[rows[todo]]]
        return self._places[self._nth[rows]] + steps


class Phrases:
    """The windows of one block of benchmark items as word codes."""

    def __init__(self, items: list[tuple[int, str | None]], window: int):
        self.window = window
        owners: dict[tuple[str, ...], set[int]] = {}
        for item, text in items:
            w = words_of(text)
            if item is not None and w:
                for i in range(max(1, len(w) - window + 1)):
                    owners.setdefault(tuple(w[i:i + window]), set()).add(item)
        vocabulary = sorted({w.encode("utf-8", "surrogatepass") for key in owners for w in key})
        code = {w: i + _FIRST for i, w in enumerate(vocabulary)}
        self.symbols = len(vocabulary) + _FIRST
        self.blob = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)
        self.size = np.array([len(w) for w in vocabulary], dtype=np.int64)
        self.start = np.cumsum(self.size) - self.size
        keys = slice_keys(self.blob, self.start, self.start + self.size) if vocabulary else np.empty(0, dtype=np.uint64)
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        #: Most words with one key; more than one only in texts that are made so.
        self.same_key = int(np.unique(keys, return_counts=True)[1].max(initial=0))
        self.near = np.zeros(1 << 16, dtype=bool)
        self.near[(keys >> np.uint64(48)).astype(np.int64)] = True
        self.items = [sorted(x) for x in owners.values()]
        self.sizes = np.array([len(k) for k in owners], dtype=np.int64)
        self.codes = np.zeros((len(owners), window), dtype=np.int32)
        for i, key in enumerate(owners):
            self.codes[i, :len(key)] = [code[w.encode("utf-8", "surrogatepass")] for w in key]

    def code_words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Code of each word; a word found by its key is compared byte by byte with the vocabulary's."""
        out = np.full(len(starts), _GAP, dtype=np.int32)
        if not len(self.keys) or not len(starts):
            return out
        keys = slice_keys(data, starts, ends)
        maybe = np.flatnonzero(self.near[(keys >> np.uint64(48)).astype(np.int64)])
        first = np.searchsorted(self.keys, keys[maybe])
        for nth in range(self.same_key):
            at = np.minimum(first + nth, len(self.keys) - 1)
            hit = self.keys[at] == keys[maybe]
            self._confirm(out, data, starts, ends, maybe[hit], self.order[at[hit]])
        return out

    def _confirm(self, out: np.ndarray, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, maybe: np.ndarray, word: np.ndarray) -> None:
        """Give the slices ``maybe`` the codes of the words that they equal byte by byte."""
        right = self.size[word] == (ends - starts)[maybe]
        maybe, word = maybe[right], word[right]
        for i in range(0, len(maybe), 1 << 17):
            w, m = word[i:i + (1 << 17)], maybe[i:i + (1 << 17)]
            size = self.size[w]
            differs = data[ragged(starts[m], size)] != self.blob[ragged(self.start[w], size)]
            same = np.add.reduceat(differs, np.cumsum(size) - size) == 0
            out[m[same]] = w[same] + _FIRST


def _word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    turn = np.diff(inside)
    return np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)


def _chunks(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of at most about SLICE_BYTES that do not cut a word."""
    at = 0
    while at < len(data):
        end = min(len(data), at + SLICE_BYTES)
        while end < len(data) and _IN_WORD[data[end - 1]] and _IN_WORD[data[end]]:
            end += 1
        yield at, end
        at = end


class Hits:
    """Words of a batch of texts and the windows found in them."""

    def __init__(self, texts: list[str | None], phrases: Phrases):
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
        data = _BYTE[np.frombuffer(b"\n".join(raw), dtype=np.uint8)]
        first = np.cumsum([0] + [len(r) + 1 for r in raw])
        starts, ends, codes = [], [], []
        for a, b in _chunks(data):
            s, e = _word_bounds(data[a:b])
            codes.append(phrases.code_words(data[a:b], s, e))
            starts.append(s + a)
            ends.append(e + a)
        empty = np.empty(0, dtype=np.int64)
        self.raw, self.byte = raw, first
        self.starts, self.ends = np.concatenate(starts or [empty]), np.concatenate(ends or [empty])
        self.word = np.searchsorted(self.starts, first)         # first word of each text, and the end
        self.place, self.found = self._search(np.concatenate(codes or [empty.astype(np.int32)]), phrases)
        self.phrases = phrases

    def _search(self, codes: np.ndarray, phrases: Phrases) -> tuple[np.ndarray, np.ndarray]:
        """(word in front of which a window begins, window), each once."""
        places, windows = [], []
        a = 0
        while a < len(codes) and len(phrases.codes):
            b = min(len(codes), a + SHARD_WORDS)
            part = codes[a:b]
            cuts = self.word[(self.word > a) & (self.word < b)] - a     # texts end in front of these words
            keep = part != _GAP
            keep[1:] |= part[:-1] != _GAP
            keep[0] = True
            keep[cuts] = True
            kept = np.flatnonzero(keep)
            at = np.searchsorted(kept, cuts)
            t = np.append(np.insert(part[kept], at, _END), _END)
            word = np.append(np.insert(kept, at, 0), 0)
            index = FmIndex(t, phrases.symbols)
            lo, hi = index.search(phrases.codes, phrases.sizes)
            size = hi - lo
            some = np.flatnonzero(size > 0)
            if len(some):
                places.append(word[index.locate(ragged(lo[some], size[some]))] + a)
                windows.append(np.repeat(some, size[some]))
            a = b if b == len(codes) else b - phrases.window + 1        # a window lies whole in one of two pieces
        if not places:
            return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
        pair = np.unique(np.concatenate(places) * len(phrases.codes) + np.concatenate(windows))
        return pair // len(phrases.codes), pair % len(phrases.codes)

    def _covered(self) -> np.ndarray:
        turn = np.zeros(len(self.starts) + 1, dtype=np.int64)
        np.add.at(turn, self.place, 1)
        np.add.at(turn, self.place + self.phrases.sizes[self.found], -1)
        return np.cumsum(turn)[:-1] > 0

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """(words, hit words) of each text."""
        done = np.concatenate(([0], np.cumsum(self._covered())))
        return np.diff(self.word), done[self.word[1:]] - done[self.word[:-1]]

    def items(self) -> list[list[int]]:
        """Items with a window in each text, ascending."""
        out: list[set[int]] = [set() for _ in self.raw]
        doc = np.searchsorted(self.word, self.place, side="right") - 1
        for d, w in np.unique(np.stack((doc, self.found), axis=1), axis=0).tolist() if len(doc) else ():
            out[d].update(self.phrases.items[w])
        return [sorted(x) for x in out]

    def runs(self) -> list[list[tuple[int, int, int, int]]]:
        """Merged removal spans of each text: first and end word, first and end byte in its UTF-8 form."""
        covered = np.concatenate(([False], self._covered(), [False])).astype(np.int8)
        turn = np.diff(covered)
        lo, hi = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
        out: list[list[tuple[int, int, int, int]]] = [[] for _ in self.raw]
        for a, b in zip(lo.tolist(), hi.tolist()):
            while a < b:                                        # a covered run may touch the next text's
                d = int(np.searchsorted(self.word, a, side="right")) - 1
                stop, word, byte = min(b, int(self.word[d + 1])), int(self.word[d]), int(self.byte[d])
                out[d].append((a - word, stop - word, int(self.starts[a]) - byte, int(self.ends[stop - 1]) - byte))
                a = stop
        return out

    def spans(self) -> list[list[tuple[int, int]]]:
        """Merged removal spans of each text as byte offsets in its UTF-8 form."""
        return [[(a, b) for _, _, a, b in runs] for runs in self.runs()]


def _cut(raw: bytes, spans: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in spans:
        out.append(raw[at:a])
        at = b
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")


def benchmark_blocks(benchmark: DataFrame, window: int) -> list[Broadcast]:
    """The benchmark's windows in blocks of at most about BLOCK_BYTES of text, each broadcast by itself.

    Rows that repeat count once.  The driver holds one block at a time.
    """
    spark = benchmark.sparkSession
    prepare(spark)
    items = benchmark.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null").distinct()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    if blocks > 1:
        items = written(items, "benchmark-items")
    return [spark.sparkContext.broadcast(Phrases(
        [tuple(r) for r in items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).collect()], window))
        for b in range(blocks)]


def _searched(texts: list[str | None], blocks: list[Broadcast]) -> Iterator[tuple[int, Hits]]:
    """(number of the first text, hits) of every shard of the texts under every block; one block is in memory at a time."""
    shards, start, held = [], 0, 0
    for i, t in enumerate(texts):
        size = len(t or "")
        if held and held + size > SHARD_BYTES:
            shards.append((start, i))
            start, held = i, 0
        held += size + 1
    shards.append((start, len(texts)))
    for block in blocks:
        phrases = block.value
        for a, b in shards:
            yield a, Hits(texts[a:b], phrases)
        if len(blocks) > 1:
            block.__dict__.pop("_value", None)          # loaded again for the next texts


_FOUND = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()),
                    ("items_sha256", pa.string()), ("contaminated", pa.bool_())])


def digest(items: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """Per row of ``docs``: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    One pass without shuffle, whatever the number of blocks: a task searches its texts for one block after another.
    """
    blocks = benchmark_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SHARD_BYTES if len(blocks) == 1 else GROUP_BYTES):
            n_words, n_hit, items = _counted(part.column("text").to_pylist(), blocks)
            yield rows_batch({"doc_id": part.column("doc_id").to_pylist(), "n_words": n_words, "n_hit": n_hit,
                              "n_items": [len(x) for x in items], "items_sha256": [digest(x) for x in items],
                              "contaminated": n_hit > 0}, _FOUND)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        run, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def _counted(texts: list[str | None], blocks: list[Broadcast]) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Words, hit words and items with occurring windows of each text."""
    if len(blocks) == 1:
        hits = Hits(texts, blocks[0].value)
        return *hits.counts(), hits.items()
    n_words = np.zeros(len(texts), dtype=np.int64)
    spans: list[list[tuple[int, int]]] = [[] for _ in texts]
    items: list[set[int]] = [set() for _ in texts]
    for first, hits in _searched(texts, blocks):
        n_words[first:first + len(hits.raw)] = hits.counts()[0]
        for i, (runs, own) in enumerate(zip(hits.runs(), hits.items()), first):
            spans[i] += [(s, e) for s, e, _, _ in runs]
            items[i].update(own)
    return n_words, np.array([_length(x) for x in spans], dtype=np.int64), [sorted(x) for x in items]


def _length(spans: list[tuple[int, int]]) -> int:
    """Words in the union of spans."""
    total, upto = 0, 0
    for s, e in sorted(spans):
        total += max(0, e - max(s, upto))
        upto = max(upto, e)
    return total


def remove_passages(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """``docs`` (all columns) without the merged spans of benchmark windows.

    All blocks of the benchmark search the same texts and the union of their spans is cut once; what joins
    around a cut is searched again until no block hits, so no window is left.  Rows without hits stay as they
    are; a row that had hits and has no word left goes.  ``n_chars`` follows the text if the table has it.
    One pass without shuffle, whatever the number of blocks.
    """
    blocks = benchmark_blocks(benchmark, window)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=SHARD_BYTES if len(blocks) == 1 else GROUP_BYTES):
            texts = part.column("text").to_pylist()
            changed: set[int] = set()
            todo = list(range(len(texts)))
            while todo:
                runs: list[list[tuple[int, int, int, int]]] = [[] for _ in todo]
                for first, hits in _searched([texts[i] for i in todo], blocks):
                    for n, found in enumerate(hits.runs(), first):
                        runs[n] += found
                todo = [i for i, found in zip(todo, runs) if found]
                for i, found in zip(todo, filter(None, runs)):
                    texts[i] = _cut(texts[i].encode("utf-8", "surrogatepass"), _union(found))
                changed.update(todo)
            yield _with_texts(part, texts, changed)

    return docs.mapInArrow(run, docs.schema)


def _union(runs: list[tuple[int, int, int, int]]) -> list[list[int]]:
    """Byte spans of the union of removal spans; spans that touch by words are one."""
    merged: list[list[int]] = []
    upto = -1
    for s, e, a, b in sorted(runs):
        if merged and s <= upto:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
        upto = max(upto, e)
    return merged


def _with_texts(part: pa.RecordBatch, texts: list[str | None], changed: set[int]) -> pa.RecordBatch:
    """``part`` with its changed texts and their ``n_chars``; a changed row without a word left goes."""
    if not changed:
        return part
    names = part.schema.names
    part = part.set_column(names.index("text"), part.schema.field("text"), pa.array(texts, type=part.schema.field("text").type))
    if "n_chars" in names:
        sizes = part.column("n_chars").to_pylist()
        for i in changed:
            sizes[i] = len(texts[i])
        field = part.schema.field("n_chars")
        part = part.set_column(names.index("n_chars"), field, pa.array(sizes, type=field.type))
    return part.filter(pa.array([i not in changed or bool(words_of(t)) for i, t in enumerate(texts)]))
