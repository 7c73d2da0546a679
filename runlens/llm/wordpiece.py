"""Greedy word-piece counts by a linear longest-match automaton.

Longest-match word pieces are normally found by trying ever shorter prefixes
and starting over behind each piece.  Here the vocabulary is a byte trie whose
nodes carry a failure link and the number of pieces that the greedy rule emits
("pops") when the next byte does not continue the node; the link leads to the
node of what is left over.  Walking a word takes one pass, and since only the
number of popped pieces is stored, lengths come without building any piece.

Words are the maximal runs without blanks (``[^\\x20\\x09-\\x0D]+``).  A word that
greedy matching cannot cover is one unknown token.  Null and empty texts have
no words and no tokens; a word of any length is walked once; rows that repeat
are counted row by row; an empty table gives no rows; only doc_id and text are
read, so other columns may have any name.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from runlens.llm._common import rows_batch, text_slices

_WORD = re.compile("[^\x20\x09-\x0D]+")
_GENERATION = 200_000   # words in each of the two generations of a worker's cache


class LongestMatch:
    """Automaton over ``first`` pieces (a word begins with one) and ``rest`` pieces (all that follow)."""

    def __init__(self, first: Iterable[bytes], rest: Iterable[bytes]):
        # Node 0: before a word; node 1: behind a whole piece.  A node's children are keyed node * 256 + byte.
        self.edges: dict[int, int] = {}
        parent, byte = [-1, -1], [0, 0]
        whole: set[int] = set()
        for root, pieces in ((0, first), (1, rest)):
            for piece in pieces:
                if not piece:
                    continue
                node = root
                for b in piece:
                    child = self.edges.get(node << 8 | b)
                    if child is None:
                        child = len(parent)
                        self.edges[node << 8 | b] = child
                        parent.append(node)
                        byte.append(b)
                    node = child
                whole.add(node)
        self._link(parent, byte, whole)
        self._young: dict[str, int] = {}
        self._old: dict[str, int] = {}

    def _link(self, parent: list[int], byte: list[int], whole: set[int]) -> None:
        """fail[v]: node of what is left after the pops of v (-1: nothing matches); pops[v]: their number."""
        n = len(parent)
        self.fail, self.pops = [-1] * n, [0] * n
        depth = [0] * n
        for v in range(2, n):                       # children come after their parents
            depth[v] = depth[parent[v]] + 1
        for v in sorted(range(2, n), key=depth.__getitem__):
            if v in whole:
                self.fail[v], self.pops[v] = 1, 1
                continue
            z, popped = self.fail[parent[v]], self.pops[parent[v]]
            while z >= 0 and (z << 8 | byte[v]) not in self.edges:
                popped += self.pops[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.pops[v] = self.edges[z << 8 | byte[v]], popped

    def length(self, word: bytes) -> int:
        """Number of greedy pieces of one word; -1 if the vocabulary cannot cover it."""
        edges, fail, pops = self.edges, self.fail, self.pops
        node, count = 0, 0
        for b in word:
            while (child := edges.get(node << 8 | b)) is None:
                count += pops[node]
                node = fail[node]
                if node < 0:
                    return -1
            node = child
        while node > 1:
            count += pops[node]
            node = fail[node]
            if node < 0:
                return -1
        return count

    def lengths(self, words: list[str]) -> list[int]:
        young = self._young
        out = list(map(young.get, words))
        if None in out:
            for w in {w for w, k in zip(words, out) if k is None}:
                k = self._old.get(w)
                young[w] = self.length(w.encode("utf-8", "surrogatepass")) if k is None else k
            out = list(map(young.__getitem__, words))
            if len(young) > _GENERATION:
                self._old, self._young = young, {}
        return out


@lru_cache(maxsize=2)
def _automaton(path: str) -> LongestMatch:
    return LongestMatch(*pieces_of_ranks(path))


def pieces_of_ranks(path: str) -> tuple[list[bytes], list[bytes]]:
    """Word-piece vocabulary of a byte-level rank file: tokens with a leading blank begin a word, others follow.

    Every single byte may also begin a word, so that each word can be covered.
    """
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    rest = [t for t in tokens if not t.startswith(b" ")]
    return [t[1:] for t in tokens if t.startswith(b" ")] + [t for t in tokens if len(t) == 1], rest


_COUNTS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()),
                     ("n_unknown", pa.int64()), ("longest_word", pa.int64())])


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_words, n_tokens (unknown words count one), n_unknown and longest_word (most tokens in a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(path)
        for part in text_slices(batches):
            rows: dict[str, list] = {f.name: [] for f in _COUNTS}
            for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                found = automaton.lengths(_WORD.findall(text or ""))
                unknown = found.count(-1)
                for name, value in zip(rows, (doc_id, len(found), sum(found) + 2 * unknown, unknown,
                                              max(found, default=0) if unknown < len(found) else min(1, len(found)))):
                    rows[name].append(value)
            yield rows_batch(rows, _COUNTS)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_words long, n_tokens long, n_unknown long, longest_word long")
