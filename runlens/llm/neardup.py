"""MinHash near-duplicates with odd sketches.

Every text becomes the set of its word shingles; two texts are linked if
``100 * |intersection| >= percent * |union|``.

1. One pass over the texts gives, per document, the set's size and 128-bit
   digest, MinHash band keys and an odd sketch: the 256 MinHash samples (sample
   number and value) are hashed into a 1,024-bit map in which each bit is the
   parity of the samples that fall on it.  The population count of the XOR of
   two maps estimates how many samples differ, hence the similarity.
2. Equal digests are one class (copies are never paired); only classes go on.
3. Classes that share a band key form a bucket.  A bucket is streamed past its
   hubs: a class far from every hub becomes a hub, any other is tied to the hubs
   whose sketch says they may share a link with it.  Two linked classes are at
   most 1 - threshold apart, so by the triangle inequality of the Jaccard
   distance both are tied to a common hub; the ties of a bucket are a spanning
   forest, not all pairs.
4. Components of the ties are candidate groups.  Inside a group links are
   confirmed on the full shingle sets, in blocks of bounded size; members already
   joined by confirmed links are not compared again.
5. Components of the confirmed links are the result.

A pair at the threshold shares no band with probability below one in a million,
by the number of bands.  Sets are compared as 64-bit shingle hashes.

Defined cases: null, empty and blank texts have an empty set and no link; a
text with fewer words than a shingle is one shingle; rows that repeat a doc_id
are one document with the links of all its texts; a row without doc_id takes no
part (component null, kept); an empty table gives no rows.  Only doc_id and text
are read; ``keep_one`` hands on all columns, whatever they are called.  The
smallest doc_id names a component, so ties inside it change nothing; a text of
any length is compared by its whole set.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm._common import IdFilter, prepare, text_slices, written
from runlens.llm._components import components
from runlens.llm._slices import word_keys

SAMPLES = 256
SKETCH_BITS = 1024
HUB = 0.9                       # estimate from which a class is represented by a hub
BLOCK_SHINGLES = 1 << 19        # shingles of a group that are compared in one task (twice as many for two blocks)
_MISS = 1e-6
_BYTE = np.arange(256, dtype=np.uint8)
_BYTE[65:91] += 32
_IN_WORD = np.ones(256, dtype=bool)
_IN_WORD[[9, 10, 11, 12, 13, 32]] = False
_MIX = np.uint64(0xBF58476D1CE4E5B9)


@dataclass(frozen=True)
class Rule:
    """Words in a shingle and the least similarity in per cent."""

    words: int = 5
    percent: int = 80

    @property
    def bands(self) -> tuple[int, int]:
        """(bands, samples in a band): the steepest choice that fits the samples and misses a pair with less than _MISS."""
        t = self.percent / 100
        for rows in range(8, 0, -1):
            bands = math.ceil(math.log(_MISS) / math.log(1 - t ** rows)) if t < 1 else 1
            if bands * rows <= SAMPLES // 2:
                return bands, rows
        return SAMPLES // 2, 1

    @property
    def tie(self) -> float:
        """Least estimate that ties a class to a hub: linked to something the hub stands for, with 6 standard errors on both."""
        error = lambda j: 6 * math.sqrt(j * (1 - j) / SAMPLES)
        least = max(0.05, self.percent / 100 - (1 - HUB) - error(HUB))
        return max(0.02, least - error(least))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: list[str | None], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _BYTE[np.frombuffer(b" ".join(raw), dtype=np.uint8)]
    first = np.cumsum([0] + [len(r) + 1 for r in raw])
    inside = np.zeros(len(data) + 2, dtype=np.int8)
    inside[1:-1] = _IN_WORD[data]
    turn = np.diff(inside)
    starts, ends = np.flatnonzero(turn == 1), np.flatnonzero(turn == -1)
    keys = word_keys(data, starts, ends)
    cut = np.searchsorted(starts, first).tolist()
    rolled = np.zeros(max(0, len(keys) - words + 1), dtype=np.uint64)
    for j in range(words):
        rolled = _mix(rolled + keys[j:j + len(rolled)] + np.uint64(j + 1))
    out = []
    for a, b in zip(cut, cut[1:]):
        if b - a >= words:
            out.append(np.unique(rolled[a:b - words + 1]))
        elif b > a:
            h = np.full(1, 0x5851F42D4C957F2D * (b - a) & 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
            for k in keys[a:b]:
                h = _mix(h + k)
            out.append(h)
        else:
            out.append(np.empty(0, dtype=np.uint64))
    return out


def _parameters() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(97)
    return (rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1),
            rng.integers(0, 1 << 63, SAMPLES, dtype=np.uint64))


_FACTOR, _SHIFT = _parameters()


def minhash(shingles: np.ndarray) -> np.ndarray:
    """The SAMPLES least values of a set under random linear maps of its hashes."""
    best = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(shingles), 512):
        part = shingles[i:i + 512]
        np.minimum(best, (part[:, None] * _FACTOR + _SHIFT).min(axis=0), out=best)
    return best


def odd_sketch(samples: np.ndarray) -> np.ndarray:
    """Parity map of (sample number, value) pairs, as bytes."""
    place = _mix(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(54)
    return np.packbits((np.bincount(place.astype(np.int64), minlength=SKETCH_BITS) & 1).astype(bool))


def similarity(sketch: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Similarity estimates of one sketch and many (rows of 64-bit words), from the XOR's population count."""
    odd = np.bitwise_count(others ^ sketch).sum(axis=1, dtype=np.int64)
    share = np.minimum(2 * odd / SKETCH_BITS, 1 - 1e-9)
    return 1 + SKETCH_BITS / 2 * np.log(1 - share) / (2 * SAMPLES)


_SIGNED = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()),
                     ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])


def signatures(docs: DataFrame, rule: Rule) -> DataFrame:
    """doc_id, n_shingles, digest, bands, sketch of every row (no bands for an empty set)."""
    n_bands, n_rows = rule.bands

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        salt = np.arange(n_bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for part in text_slices(batches, limit=1 << 20):
            sizes, digests, bands, sketches = [], [], [], []
            for s in shingle_sets(part.column("text").to_pylist(), rule.words):
                sizes.append(len(s))
                digests.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
                if len(s):
                    samples = minhash(s)
                    key = salt.copy()
                    for j in range(n_rows):
                        key = _mix(key + samples[j:n_bands * n_rows:n_rows])
                    bands.append(key.view(np.int64))
                    sketches.append(odd_sketch(samples).tobytes())
                else:
                    bands.append([])
                    sketches.append(b"")
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64())] + [
                pa.array(v, type=_SIGNED.field(n).type) for v, n in
                ((sizes, "n_shingles"), (digests, "digest"), (bands, "bands"), (sketches, "sketch"))], schema=_SIGNED)

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, digest binary, bands array<long>, sketch binary")


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, list[pa.RecordBatch]]]:
    """Runs of rows with equal keys in sorted batches; a run is handed on as slices."""
    current, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.ones(batch.num_rows, dtype=bool)
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
        cut = np.append(np.flatnonzero(new), batch.num_rows).tolist()
        for a, b in zip(cut, cut[1:]):
            key = tuple(int(c[a]) for c in columns)
            if key != current:
                if held:
                    yield current, held
                current, held = key, []
            held.append(batch.slice(a, b - a))
    if held:
        yield current, held


class _Forest:
    """Union-find over a few members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while up.setdefault(x, x) != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def _ties(tie: float):
    """Stream buckets (rows sorted by key) past their hubs; emits the ties of a spanning forest of each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = [], []
        key, hubs, hub_nodes, forest = None, np.empty((0, SKETCH_BITS // 64), dtype=np.uint64), [], _Forest()
        for batch in batches:
            sketches = np.frombuffer(b"".join(batch.column("sketch").to_pylist()), dtype=np.uint64).reshape(batch.num_rows, -1)
            for i, (k, node) in enumerate(zip(batch.column("key").to_pylist(), batch.column("node").to_pylist())):
                if k != key:
                    key, n_hubs, hub_nodes, forest = k, 0, [], _Forest()
                near = similarity(sketches[i], hubs[:n_hubs]) if n_hubs else np.empty(0)
                for h in np.flatnonzero(near >= tie).tolist():
                    if hub_nodes[h] != node and forest.join(hub_nodes[h], node):
                        a.append(node)
                        b.append(hub_nodes[h])
                if not len(near) or near.max() < HUB:
                    if n_hubs == len(hubs):
                        hubs = np.concatenate((hubs, np.empty((max(4, n_hubs), hubs.shape[1]), dtype=np.uint64)))
                    hubs[n_hubs] = sketches[i]
                    n_hubs += 1
                    hub_nodes.append(node)
            yield pa.RecordBatch.from_arrays([pa.array(a, type=pa.int64()), pa.array(b, type=pa.int64())], names=["a", "b"])
            a, b = [], []

    return run


def exact_links(nodes: list[int], sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among some sets.

    Breadth first: a reached set is compared with all sets that are not reached yet, at once, by
    counting its shingles in their concatenation.
    """
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    starts = np.cumsum(sizes) - sizes
    own = [codes[s:s + n] for s, n in zip(starts.tolist(), sizes.tolist())]
    left = np.arange(len(sets))
    flat, at = codes, starts
    mark = np.zeros(len(values), dtype=bool)
    out: list[tuple[int, int]] = []
    while len(left):
        queue, left = [int(left[0])], left[1:]
        flat, at = _rest(own, sizes, left)
        while queue and len(left):
            x = queue.pop()
            mark[own[x]] = True
            common = np.add.reduceat(mark[flat], at, dtype=np.int64)
            mark[own[x]] = False
            linked = 100 * common >= percent * (sizes[x] + sizes[left] - common)
            if linked.any():
                reached = left[linked].tolist()
                out.extend((nodes[x], nodes[y]) for y in reached)
                queue.extend(reached)
                left = left[~linked]
                flat, at = _rest(own, sizes, left)
    return out


def _rest(own: list[np.ndarray], sizes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(left):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate([own[i] for i in left.tolist()]), np.cumsum(sizes[left]) - sizes[left]


def _confirm(percent: int):
    """Exact links inside (group, block, block) runs of sorted rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, parts in _groups(batches, ["grp", "i", "j"]):
            nodes = [n for p in parts for n in p.column("node").to_pylist()]
            sets = [np.frombuffer(s, dtype=np.uint64) for p in parts for s in p.column("shingles").to_pylist()]
            links = exact_links(nodes, sets, percent) if len(nodes) > 1 else []
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], type=pa.int64()),
                                                  pa.array([y for _, y in links], type=pa.int64())], names=["a", "b"])

    return run


def _full_sets(words: int):
    """Rows (grp, blocks, node, digest, text) to (grp, blocks, node, shingles); rows of another text of the node go."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches):
            sets = [s.tobytes() for s in shingle_sets(part.column("text").to_pylist(), words)]
            same = [hashlib.blake2b(s, digest_size=16).digest() == d for s, d in zip(sets, part.column("digest").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column("grp"), part.column("blocks"), part.column("node"), pa.array(sets, type=pa.binary())],
                names=["grp", "blocks", "node", "shingles"]).filter(pa.array(same))

    return run


def links(docs: DataFrame, signed: DataFrame, rule: Rule) -> DataFrame:
    """Confirmed links (a, b) between class representatives (smallest doc_id of each distinct set), enough to connect all that are linked."""
    classes = written(signed.where("doc_id is not null and n_shingles > 0").groupBy("digest")
                      .agg(F.min("doc_id").alias("node"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"),
                           F.first("sketch").alias("sketch")), "classes")
    by_key = Window.partitionBy("key").orderBy("node")
    shared = (classes.select(F.explode("bands").alias("key"), "node", "digest")
              .withColumn("more", F.lead("node").over(by_key).isNotNull() | F.lag("node").over(by_key).isNotNull())
              .where("more").drop("more"))
    tied = (shared.join(classes.select("digest", "sketch"), "digest").select("key", "node", "sketch")
            .repartition("key").sortWithinPartitions("key", "node").mapInArrow(_ties(rule.tie), "a long, b long").distinct())
    groups = components(tied)
    members = classes.join(groups, "node").select(F.col("component").alias("grp"), "node", "digest", "n")
    members = written(members, "members")
    blocks = members.groupBy("grp").agg(F.ceil(F.sum("n") / F.lit(BLOCK_SHINGLES)).cast("int").alias("blocks"))
    # Only texts that may be a member's are shuffled.
    _, perhaps = IdFilter(members, "node").split(docs.select(F.col("doc_id").cast("long").alias("node"), "text"), "node")
    texts = (perhaps.join(members.join(blocks, "grp").hint("merge"), "node").select("grp", "blocks", "node", "digest", "text"))
    sets = texts.mapInArrow(_full_sets(rule.words), "grp long, blocks int, node long, shingles binary")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    paired = (sets.withColumn("own", own)
              .withColumn("other", F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(
                  F.array_except(F.sequence(F.lit(0), F.col("blocks") - 1), F.array("own")))))
              .select("grp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "shingles"))
    return (paired.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j", "node")
            .mapInArrow(_confirm(rule.percent), "a long, b long"))


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, n_shingles, component_id, kept: one row per input row."""
    prepare(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    signed = written(signatures(docs, rule), "signatures")
    found = links(docs, signed, rule)
    keyed = signed.where("doc_id is not null and n_shingles > 0").select("doc_id", "digest")
    classes = keyed.groupBy("digest").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last"))
    # A doc_id that stands for several texts ties their classes.
    several = (keyed.groupBy("doc_id").agg(F.min("digest").alias("d"), F.max("digest").alias("e")).where("d <> e").select("doc_id")
               .join(keyed, "doc_id").join(classes, "digest").select(F.col("doc_id").alias("a"), F.col("node").alias("b")))
    labels = components(found.union(several))
    named = (classes.join(labels, "node", "left").where("component is not null or last <> node")
             .select("digest", F.coalesce("component", "node").alias("component")))
    return (signed.select("doc_id", "n_shingles", "digest").join(named, "digest", "left")
            .select("doc_id", "n_shingles",
                    F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n_shingles") > 0, F.col("component")), "doc_id")).alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))))


def keep_one(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """``docs`` (all columns) with one document of each group: the one with the smallest doc_id.

    Rows that repeat a kept doc_id are reduced to the one with the least text (null first); rows without doc_id stay.
    """
    marked = written(near_duplicates(docs, rule), "near-duplicates")
    gone = marked.where("not kept").select("doc_id").distinct()
    again = marked.where("kept and doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    special = written(gone.withColumn("again", F.lit(False)).union(again.withColumn("again", F.lit(True))), "not-kept")
    plain, perhaps = IdFilter(special, "doc_id").split(docs, "doc_id")
    kept = plain.union(perhaps.join(special.hint("merge"), "doc_id", "left_anti").select(docs.columns))
    if special.where("again").isEmpty():
        return kept
    once = perhaps.join(special.where("again").hint("merge"), "doc_id", "left_semi")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    least = once.groupBy("doc_id").agg(F.min_by(row, F.struct("text", F.xxhash64(*[F.col(f"`{c}`") for c in docs.columns]))).alias("_row"))
    return kept.union(least.select("_row.*"))
