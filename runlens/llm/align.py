"""Alignment of two tokenizers by merge-path partitioning.

Tokenizer A (byte-level BPE file) and B (piece model, which writes a blank in front) cut the same bytes,
a blank and the text, into tokens.  Places where a token of A and one of B end together cut both into
groups.  The sorted ends of A and B are merged; the merge matrix is cut by diagonals at equal distances,
a binary search on every diagonal says how many ends of A and of B lie in front of it, and so the merge
falls into independent pieces of equal work, whatever the texts' lengths.  A piece emits the overlaps of
A and B tokens and their common ends; a common end that a diagonal cuts apart is stitched afterwards.

On Spark: a task encodes texts in chunks of about ``CHUNK_BYTES`` and writes, per chunk, its documents and
its distinct linked id pairs with their numbers.  Corpus counts of pairs come from these partial counts, and
each chunk gets the counts of its own pairs back by a join, so a pair that stands in every document is one row
per chunk, nothing corpus-wide is broadcast, and texts are encoded once.

Both encoders send only *distinct* slices through their merging: the blank-led slices of B's pieces never
join (checked against its vocabulary, else whole texts go through the library); A's file must list merges in
the order of its ids (else the library is used).

Defined cases: null and empty texts, and texts whose tokens do not spell blank + text (a text with U+2581, say)
have no tokens, zeros and the digest ''; long texts make a chunk of their own; rows that repeat are aligned row
by row and count each; an empty table gives no rows; a null doc_id stays null; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import prepare, text_slices, written
from runlens.llm._slices import SliceTable
from runlens.llm.bpe import ByteBpe

CHUNK_BYTES = 1 << 20
PIECE_WORK = 1 << 16        # ends of A and B in a piece of the merge
_BLANK = "▁"


# ------------------------------------------------------------------ merge path

def diagonals(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """(ends of a, ends of b) in front of every ``work``-th place of the merged order (a first if equal), and at its end."""
    d = np.append(np.arange(0, len(a) + len(b), work), len(a) + len(b))
    low, high = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (open_ := low < high).any():
        mid = (low + high) // 2
        # Is a[mid] among the first d?  Then it stands in front of b[d - 1 - mid], the next one that would be.
        before = np.zeros(len(d), dtype=bool)
        before[open_] = a[mid[open_]] <= b[d[open_] - 1 - mid[open_]]
        low, high = np.where(open_ & before, mid + 1, low), np.where(open_ & ~before, mid, high)
    return low, d - low


def _merged(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted ends of one piece, place of each: a's first, then b's)."""
    both = np.concatenate((a, b))
    order = np.argsort(both, kind="stable")
    return both[order], order


def common_ends(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray]:
    """Places in a and in b of the ends that both have (ascending, distinct in each)."""
    i, j = diagonals(a, b, work)
    in_a, in_b = [], []
    for i0, j0, i1, j1 in zip(i.tolist(), j.tolist(), i[1:].tolist(), j[1:].tolist()):
        ends, order = _merged(a[i0:i1], b[j0:j1])
        met = np.flatnonzero(ends[1:] == ends[:-1])
        in_a.append(order[met] + i0)
        in_b.append(order[met + 1] - (i1 - i0) + j0)
        if 0 < i1 and j1 < len(b) and a[i1 - 1] == b[j1]:       # cut apart by the diagonal
            in_a.append(np.array([i1 - 1]))
            in_b.append(np.array([j1]))
    none = [np.empty(0, dtype=np.int64)]
    return np.concatenate(in_a or none), np.concatenate(in_b or none)


def overlaps(a: np.ndarray, b: np.ndarray, work: int = PIECE_WORK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place in a, place in b, bytes) of every pair of tokens that share bytes; both end at the same last place."""
    i, j = diagonals(a, b, work)
    found = []
    for i0, j0, i1, j1 in zip(i.tolist(), j.tolist(), i[1:].tolist(), j[1:].tolist()):
        ends, order = _merged(a[i0:i1], b[j0:j1])
        of_a = order < i1 - i0
        start = max(int(a[i0 - 1]) if i0 else 0, int(b[j0 - 1]) if j0 else 0)
        size = np.diff(ends, prepend=start)
        keep = size > 0                                          # no bytes between two equal ends
        found.append((i0 + (np.cumsum(of_a) - of_a)[keep], j0 + (np.cumsum(~of_a) - ~of_a)[keep], size[keep]))
    if not found:
        return (np.empty(0, dtype=np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*found))


# ------------------------------------------------------------------ the two encoders

def _byte_of_char() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable Latin-1 itself, others from U+0100."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or (b >= 0xA1 and b != 0xAD)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + k): b for k, b in enumerate(moved)}


class TokensA(ByteBpe):
    """Byte-level BPE from a tokenizer file (JSON); its special tokens inside texts are ordinary text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        byte = _byte_of_char()
        vocabulary = {bytes(map(byte.__getitem__, t)): i for t, i in model["vocab"].items() if all(c in byte for c in t)}
        joined = ["".join(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        made = [model["vocab"][t] for t in joined]
        special = set(model["vocab"].values()) - set(made)
        self.ranks = {t: i for t, i in vocabulary.items() if len(t) == 1 or i not in special}
        self.tokens = [b""] * (max(model["vocab"].values()) + 1)
        for token, i in vocabulary.items():
            self.tokens[i] = token
        self._table = SliceTable(np.dtype(np.int32))
        self.library = None
        if made != sorted(set(made)) or max(self.ranks[t] for t in self.ranks if len(t) == 1) > min(made, default=1 << 31):
            self.library = _library(path)

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, ids of each)."""
        if self.library is None:
            return self.encode(texts, False)[:2]
        lists = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        return np.array([i for own in lists for i in own], dtype=np.int32), np.array(list(map(len, lists)), dtype=np.int64)


def _library(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer
    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True
    return found


class TokensB:
    """A piece model that puts a blank in front of a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.tokens = [bytes([int(p[3:5], 16)]) if self.model.is_byte(i) else p.replace(_BLANK, " ").encode()
                       for i, p in enumerate(pieces)]
        probe = "a  b\t c \n   d  "
        self.sliced = not any(re.search(f"[^{_BLANK}]{_BLANK}", p) for p in pieces)
        self._table = SliceTable(np.dtype(np.int32))
        if self.sliced:
            ids, _ = self.encode_all([probe])
            self.sliced = ids.tolist() == self.model.encode(probe)

    def _library(self, slices: list[bytes]) -> list[bytes]:
        """Ids of slices that begin with a blank; one of blanks only is encoded behind a letter."""
        words = [x.decode("utf-8") for x in slices]
        bare = [not w.strip(" ") for w in words]
        lists = self.model.encode(["a" + w if b else w[1:] for w, b in zip(words, bare)], num_threads=1) if words else []
        first = len(self.model.encode("a"))
        return [np.array(ids[first:] if b else ids, dtype=np.int32).tobytes() for ids, b in zip(lists, bare)]

    def encode_all(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not self.sliced:
            lists = self.model.encode(texts, num_threads=1)
            return np.array([i for own in lists for i in own], dtype=np.int32), np.array(list(map(len, lists)), dtype=np.int64)
        raw = [b" " + t.encode() for t in texts]
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        first = np.cumsum([0, *map(len, raw)])
        blank = data == 0x20
        start = blank & ~np.concatenate(([False], blank[:-1]))
        for i, t in enumerate(texts):
            if _BLANK in t:                                      # the model takes it for a blank: one slice
                start[first[i]:first[i + 1]] = False
        start[first[:-1]] = True
        starts = np.flatnonzero(start)
        ids, sizes = self._table.values(data, starts, np.append(starts[1:], len(data)), self._library)
        done = np.concatenate(([0], np.cumsum(sizes)))
        return ids, np.diff(done[np.searchsorted(starts, first)])


@lru_cache(maxsize=2)
def _tokens(kind: type, path: str):
    return kind(path)


class Aligner:
    """Aligns chunks of texts under one pair of tokenizer files."""

    def __init__(self, a_path: str, b_path: str):
        self.a, self.b = _tokens(TokensA, a_path), _tokens(TokensB, b_path)
        self.size = [np.array(list(map(len, t.tokens)), dtype=np.int64) for t in (self.a, self.b)]
        self.table = [np.array(t.tokens, dtype=object) for t in (self.a, self.b)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(ids by A, number of each text, ids by B, number of each text); none where the bytes differ from blank + text (those with U+2581 do)."""
        some = [i for i, t in enumerate(texts) if t and _BLANK not in t]
        whole = [b" " + texts[i].encode() for i in some]
        encoded = [self.a.encode_all([" " + texts[i] for i in some]), self.b.encode_all([texts[i] for i in some])]
        good = np.ones(len(some), dtype=bool)
        for (ids, counts), table, size in zip(encoded, self.table, self.size):
            good &= self._spelled(table[ids], counts, np.concatenate(([0], np.cumsum(size[ids]))), whole)
        result = []
        for ids, counts in encoded:
            number = np.zeros(len(texts), dtype=np.int64)
            number[some] = np.where(good, counts, 0)
            result += [ids if good.all() else ids[np.repeat(good, counts)], number]
        return tuple(result)

    @staticmethod
    def _spelled(tokens: np.ndarray, counts: np.ndarray, ends: np.ndarray, texts: list[bytes]) -> np.ndarray:
        """Do the tokens of each text spell it?  All texts are compared at once, and one by one only if that fails."""
        cut = np.concatenate(([0], np.cumsum(counts)))
        spelled, at = b"".join(tokens.tolist()), ends[cut].tolist()
        if np.array_equal(np.diff(at), list(map(len, texts))) and spelled == b"".join(texts):
            return np.ones(len(texts), dtype=bool)
        return np.array([spelled[a:b] == t for a, b, t in zip(at, at[1:], texts)], dtype=bool)

    def groups(self, a_ids: np.ndarray, b_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of the last token of A and of B in every group, for texts one after another."""
        return common_ends(np.cumsum(self.size[0][a_ids]), np.cumsum(self.size[1][b_ids]))


class _Said:
    """Text of groups: decimal ids of A, a bar, ids of B, semicolons between groups."""

    def __init__(self, n_a: int, n_b: int):
        self.at = np.array([0, n_a, 2 * n_a, 2 * n_a + n_b])
        self.table = np.array([f"{i}{end}" for n, ends in ((n_a, ",|"), (n_b, ",;")) for end in ends for i in range(n)], dtype=object)

    def __call__(self, a_ids, b_ids, last_a, last_b) -> tuple[np.ndarray, np.ndarray]:
        """(the words of the text in order, place of each group's last word)."""
        group_a, group_b = np.zeros(len(a_ids), dtype=np.int64), np.zeros(len(b_ids), dtype=np.int64)
        group_a[last_a[:-1] + 1] = 1
        group_b[last_b[:-1] + 1] = 1
        group_a, group_b = np.cumsum(group_a), np.cumsum(group_b)
        code_a, code_b = a_ids + self.at[0], b_ids + self.at[2]
        code_a[last_a] += self.at[1] - self.at[0]
        code_b[last_b] += self.at[3] - self.at[2]
        starts_b, ends_a = np.concatenate(([0], last_b[:-1] + 1)), last_a + 1
        out = np.empty(len(a_ids) + len(b_ids), dtype=np.int64)
        out[np.arange(len(a_ids)) + starts_b[group_a]] = code_a
        out[np.arange(len(b_ids)) + ends_a[group_b]] = code_b
        return self.table[out], last_a + last_b + 1


# ------------------------------------------------------------------ operators

def _chunks(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.Table]:
    """Rows of about ``limit`` bytes of text, also across batches."""
    held, size = [], 0
    for part in text_slices(batches, limit=limit):
        held.append(part)
        size += part.column("text").nbytes
        if size >= limit // 2:
            yield pa.Table.from_batches(held)
            held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def align(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, a_ids, b_ids and the groups as a_ends, b_ends (tokens of the document up to each group's end)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = Aligner(a_path, b_path)
        for part in _chunks(batches, CHUNK_BYTES):
            a_ids, n_a, b_ids, n_b = aligner.encode(part.column("text").to_pylist())
            last_a, last_b = aligner.groups(a_ids, b_ids)
            cut_a, cut_b = np.concatenate(([0], np.cumsum(n_a))), np.concatenate(([0], np.cumsum(n_b)))
            cut = np.searchsorted(last_a, cut_a)
            n = np.diff(cut)
            lists = [(cut_a, a_ids), (cut_b, b_ids), (cut, last_a + 1 - np.repeat(cut_a[:-1], n)), (cut, last_b + 1 - np.repeat(cut_b[:-1], n))]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").combine_chunks().cast(pa.int64()),
                 *(pa.ListArray.from_arrays(pa.array(c, type=pa.int32()), pa.array(v, type=pa.int32())) for c, v in lists)],
                names=["doc_id", "a_ids", "b_ids", "a_ends", "b_ends"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_ends array<int>, b_ends array<int>")


_CHUNK = pa.schema([("chunk", pa.int64()), ("pairs", pa.list_(pa.int64())), ("times", pa.list_(pa.int64())),
                    ("doc_ids", pa.list_(pa.int64())), ("n_a", pa.list_(pa.int64())), ("n_b", pa.list_(pa.int64())),
                    ("n_groups", pa.list_(pa.int64())), ("said", pa.list_(pa.string())), ("links", pa.binary())])
_CHUNK_DDL = ("chunk long, pairs array<bigint>, times array<bigint>, doc_ids array<bigint>, n_a array<bigint>, n_b array<bigint>, "
              "n_groups array<bigint>, said array<string>, links binary")


def aligned_chunks(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """A written row per chunk of documents: its distinct linked pairs (a * 2^32 + b), how often each occurs, what is known
    of its documents, and the links of all documents in order, as places in ``pairs`` (16 or 32 bits each)."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner, said, number = Aligner(a_path, b_path), None, TaskContext.get().partitionId() << 32
        for part in _chunks(batches, CHUNK_BYTES):
            a_ids, n_a, b_ids, n_b = aligner.encode(part.column("text").to_pylist())
            last_a, last_b = aligner.groups(a_ids, b_ids)
            cut = np.searchsorted(last_a, np.concatenate(([0], np.cumsum(n_a))))
            digests = [""] * part.num_rows
            if len(last_a):
                said = said or _Said(len(aligner.a.tokens), len(aligner.b.tokens))
                words, ends = said(a_ids, b_ids, last_a, last_b)
                at = 0
                for i, k in enumerate(cut[1:].tolist()):
                    if k > cut[i]:
                        end = int(ends[k - 1]) + 1
                        digests[i] = hashlib.sha256("".join(words[at:end].tolist())[:-1].encode()).hexdigest()
                        at = end
            pairs, links, times = np.unique(a_ids[last_a].astype(np.int64) << 32 | b_ids[last_b], return_inverse=True, return_counts=True)
            values = (number, pairs, times, part.column("doc_id").cast(pa.int64()).to_pylist(), n_a, n_b, np.diff(cut), digests,
                      links.astype("<u2" if len(pairs) <= 1 << 16 else "<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(values, _CHUNK)], schema=_CHUNK)
            number += 1

    return written(docs.select("doc_id", "text").mapInArrow(run, _CHUNK_DDL), "aligned")


def pair_counts(chunks: DataFrame) -> DataFrame:
    """pair, n (links in the corpus) and best (n is the highest of the pair's B id, ties included)."""
    counts = written(chunks.select(F.explode(F.arrays_zip("pairs", "times")).alias("p"))
                     .groupBy(F.col("p.pairs").alias("pair")).agg(F.sum("p.times").alias("n")), "pair-counts")
    b = F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b")
    top = counts.groupBy(b).agg(F.max("n").alias("top"))
    return counts.withColumn("b", b).join(top, "b").select("pair", "n", (F.col("n") == F.col("top")).alias("best"))


def alignment_counts(docs: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every document.  Runs jobs."""
    chunks = aligned_chunks(docs, a_path, b_path)
    asked = chunks.select("chunk", F.posexplode("pairs").alias("place", "pair"))
    known = (asked.join(pair_counts(chunks), "pair").groupBy("chunk")
             .agg(F.collect_list(F.struct("place", "n", "best")).alias("known")))
    schema = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                        ("groups_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                def row(name: str):
                    return batch.column(name)[i].values

                n, best = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool)
                if batch.column("known")[i].is_valid:
                    found = row("known")
                    place = found.field("place").to_numpy()
                    n, best = np.empty(len(place), dtype=np.int64), np.empty(len(place), dtype=bool)
                    n[place] = found.field("n").to_numpy()
                    best[place] = found.field("best").to_numpy(zero_copy_only=False)
                links = np.frombuffer(batch.column("links")[i].as_py(), dtype="<u2" if len(n) <= 1 << 16 else "<u4")
                groups = row("n_groups")
                cut = np.concatenate(([0], np.cumsum(groups.to_numpy())))
                sums = [np.concatenate(([0], np.cumsum(v[links], dtype=np.int64))) for v in (best, n)]
                yield pa.RecordBatch.from_arrays(
                    [row("doc_ids"), row("n_a"), row("n_b"), groups, groups, *(pa.array(np.diff(s[cut])) for s in sums), row("said")], schema=schema)

    return (chunks.drop("pairs", "times").join(known, "chunk", "left").mapInArrow(
        run, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"))
