"""Approximate nearest neighbours by a hierarchical k-means tree, best bin first.

Nearness is the inner product.  Vectors are lifted by one coordinate,
``sqrt(M^2 - |x|^2)`` with M the largest norm (queries by 0), which turns largest
inner product into smallest Euclidean distance.

1. The tree is fitted by k-means, node by node, on a bounded sample (SAMPLE
   vectors, chosen by a hash of the id).  Then it grows with the table: every
   leaf that holds more than CELL_ROWS rows is split further in a task of its
   own, on a sample of its own rows, round by round, until no leaf is too large
   or the tree has MAX_LEAVES leaves (every task holds the tree).
2. A query walks the tree with a priority queue: the nearest open node is opened
   next, leaves are visited in the order in which they come up.  How many leaves
   are visited is calibrated against the whole table: the exact neighbours of
   CALIBRATION sample queries among all rows are found, the number is widened
   until RECALL of them lie in visited leaves, and for each query it is widened
   further until the visited leaves hold enough ids.
3. Leaves are packed into cells of about CELL_ROWS rows; a leaf that holds more
   rows (a hot one) is spread over several cells.  Rows move once to their cell,
   a query moves to each cell that has a visited leaf, and the matrix product
   there gives the best K of the cell by exact double-precision scores.

Only vec_id and embedding are read, whatever other columns are called; an empty
table gives no rows.  Rows without id, and vectors that are null,
zero, of another than the most common length or that hold null or non-finite
components, take no part.  Rows that repeat a vec_id stand for one vector (its
best row counts); equal scores go to the smaller vec_id.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm._common import prepare, written

SAMPLE = 20_000
BRANCH = 8
LEAF_SAMPLE = 100           # a node with at most so many sample vectors is a leaf
PART_SAMPLE = 4096          # rows on which a leaf that is too large is split further
PART_ROWS = 512             # rows below which such a split does not go
MAX_LEAVES = 32_768         # about so many leaves at most, since every task holds the tree
CALIBRATION = 300           # sample queries
RECALL = 0.95
CELL_ROWS = 4096
_QUERY_BATCH = 256


@dataclass
class Tree:
    """children[node] and centres of all nodes; leaf[node] is the leaf's number or -1."""

    centres: np.ndarray
    children: list[list[int]]
    leaf: np.ndarray
    largest: float
    visits: int = 1
    _stacked: dict = field(default_factory=dict, repr=False)

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.largest ** 2 - (x * x).sum(axis=1), 0))
        return np.concatenate((x, rest[:, None]), axis=1)

    def assign(self, x: np.ndarray) -> np.ndarray:
        """Leaf of each vector: the nearest child at every level."""
        lifted = self.lift(x)
        node = np.zeros(len(x), dtype=np.int64)
        todo = np.arange(len(x)) if self.children[0] else np.empty(0, dtype=np.int64)
        while len(todo):
            for n in np.unique(node[todo]).tolist():
                some = todo[node[todo] == n]
                kids = self.children[n]
                node[some] = np.array(kids)[_nearest(lifted[some], self.centres[kids])]
            todo = todo[self.leaf[node[todo]] < 0]
        return self.leaf[node]

    def graft(self, leaf: int, part: Tree) -> None:
        """Put a tree in the place of a leaf; its first leaf takes the old number, the others follow the last one."""
        at, shift = int(np.flatnonzero(self.leaf == leaf)[0]), len(self.leaf) - 1       # the part's root is the old leaf
        numbers = np.where(part.leaf > 0, part.leaf + self.leaves - 1, np.where(part.leaf == 0, leaf, -1))
        kids = [[k + shift for k in own] for own in part.children]
        self.centres = np.concatenate((self.centres, part.centres[1:]))
        self.children[at] = kids[0]
        self.children += kids[1:]
        self.leaf = np.concatenate((self.leaf, numbers[1:]))
        self.leaf[at] = -1

    def visit(self, query: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order."""
        lifted = np.append(query, 0.0)
        heap = [(0.0, 0)]
        while heap:
            _, node = heapq.heappop(heap)
            if self.leaf[node] >= 0:
                yield int(self.leaf[node])
                continue
            kids = self.children[node]
            away = self.centres[kids] - lifted
            for d, k in zip((away * away).sum(axis=1).tolist(), kids):
                heapq.heappush(heap, (d, k))


def _nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((centres * centres).sum(axis=1) - 2 * (x @ centres.T)).argmin(axis=1)


def fit_tree(sample: np.ndarray, largest: float, seed: int = 11, leaf_sample: int = LEAF_SAMPLE) -> Tree:
    rng = np.random.default_rng(seed)
    tree = Tree(np.empty((0, sample.shape[1] + 1)), [[]], np.empty(0, dtype=np.int64), largest)
    lifted = tree.lift(sample)
    centres, children, leaf = [lifted.mean(axis=0)], [[]], [-1]
    todo, leaves = [(0, np.arange(len(lifted)))], 0
    while todo:
        node, own = todo.pop()
        parts = _split(lifted[own], rng) if len(own) > leaf_sample else []
        if len(parts) < 2:
            leaf[node] = leaves
            leaves += 1
            continue
        for centre, members in parts:
            children[node].append(len(centres))
            centres.append(centre)
            children.append([])
            leaf.append(-1)
            todo.append((len(centres) - 1, own[members]))
    tree.centres, tree.children, tree.leaf = np.array(centres), children, np.array(leaf)
    return tree


def _split(x: np.ndarray, rng: np.random.Generator) -> list[tuple[np.ndarray, np.ndarray]]:
    """k-means of one node; no split if all its vectors are alike."""
    centres = np.unique(x[rng.choice(len(x), BRANCH, replace=False)], axis=0)
    for _ in range(12):
        own = _nearest(x, centres)
        centres = np.array([x[own == i].mean(axis=0) for i in range(len(centres)) if (own == i).any()])
    own = _nearest(x, centres)
    return [(centres[i], np.flatnonzero(own == i)) for i in range(len(centres)) if (own == i).any()]


def calibrate(tree: Tree, sample: np.ndarray, k: int, recall: float = RECALL) -> int:
    """Leaf visits at which the exact k nearest of sample queries are found at the wanted recall."""
    step = max(1, len(sample) // CALIBRATION)
    leaf = tree.assign(sample)
    places = []
    for q in range(0, len(sample), step):
        score = sample @ sample[q]
        score[q] = -np.inf
        best = np.argsort(-score, kind="stable")[:min(k, len(sample) - 1)]
        order = np.empty(tree.leaves, dtype=np.int64)
        order[list(tree.visit(sample[q]))] = np.arange(tree.leaves)
        places.append(order[leaf[best]])
    return widened(np.concatenate(places), tree.leaves, recall)


def widened(place: np.ndarray, leaves: int, recall: float = RECALL) -> int:
    """Leaf visits, widened until the wanted part of the neighbours, given by the visit that finds each, is found."""
    visits = 1
    while visits < leaves and (place < visits).mean() < recall:
        visits += max(1, visits // 16)
    return min(visits, leaves)


def _matrix(column: pa.Array, dim: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(rows that take part, their vectors in double precision); with no dim, one list of lengths and norms is enough."""
    sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    taken = column.take(pa.array(rows))
    flat = taken.flatten()
    values = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), dim)     # null components come as NaN
    good = np.isfinite(values).all(axis=1)
    good[good] = (values[good] != 0).any(axis=1)
    return rows[good], values[good]


def _profile(vectors: DataFrame) -> tuple[int, int, float] | None:
    """(most common length, rows, largest norm) of the vectors that take part."""
    schema = pa.schema([("dim", pa.int32()), ("n", pa.int64()), ("norm", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            for dim in np.unique(sizes[sizes > 0]).tolist():
                _, x = _matrix(column, int(dim))
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array([v], type=f.type) for v, f in zip(
                        (dim, len(x), float(np.sqrt((x * x).sum(axis=1)).max())), schema)], schema=schema)

    rows = (vectors.select("embedding").mapInArrow(run, "dim int, n long, norm double")
            .groupBy("dim").agg(F.sum("n").alias("n"), F.max("norm").alias("norm"))
            .orderBy(F.desc("n"), F.desc("dim")).limit(1).collect())
    return (rows[0].dim, rows[0].n, rows[0].norm) if rows else None


@dataclass
class Index:
    """The calibrated tree, the rows beside their leaf, and rows and ids of each leaf."""

    tree: Tree
    dim: int
    placed: DataFrame
    held: np.ndarray
    ids_held: np.ndarray


def build(vectors: DataFrame, is_query: Column, k: int, sample: int = SAMPLE) -> Index | None:
    """Index of all vectors that take part; None without any.  Runs several jobs."""
    prepare(vectors.sparkSession)
    vectors = vectors.select(F.col("vec_id").cast("long"), "embedding", is_query.alias("query")).where("vec_id is not null and embedding is not null")
    profile = _profile(vectors)
    if profile is None:
        return None
    dim, rows, norm = profile
    rate = min(1.0, 1.1 * sample / rows)
    chosen = (vectors.where((F.size("embedding") == dim) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) < int(rate * (1 << 30))))
              .select("vec_id", "embedding").limit(sample + sample // 5).toArrow())
    _, order = np.unique(chosen.column("vec_id").to_numpy(), return_index=True)     # copies are no neighbours of their own
    at, x = _matrix(chosen.column("embedding").combine_chunks().take(pa.array(order)), dim)
    ids = chosen.column("vec_id").to_numpy()[order][at]
    if not len(x):                                          # a few odd rows and none of them in the sample
        ids, x = np.zeros(1, dtype=np.int64), np.zeros((1, dim))
    tree = grown(vectors, fit_tree(x, norm), dim)
    placed = written(_placed(vectors, tree, dim), "ann-leaves")
    held, ids_held = (_by_leaf(p, tree) for p in (placed, placed.groupBy("vec_id").agg(F.min("leaf").alias("leaf"))))  # an id counts in one leaf
    step = max(1, len(x) // CALIBRATION)
    place = _visit_places(placed, tree, dim, ids[::step], x[::step], k)
    tree.visits = widened(place, tree.leaves) if len(place) else 1
    return Index(tree, dim, placed, held, ids_held)


def _placed(vectors: DataFrame, tree: Tree, dim: int) -> DataFrame:
    """vec_id, leaf, x, query of the vectors that take part."""
    shared = vectors.sparkSession.sparkContext.broadcast(tree)          # bounded by MAX_LEAVES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, x = _matrix(batch.column("embedding"), dim)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(rows)), pa.array(shared.value.assign(x), type=pa.int32()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, type=pa.int32()), pa.array(x.ravel())), batch.column("query").take(pa.array(rows))],
                names=["vec_id", "leaf", "x", "query"])

    return vectors.select("vec_id", "embedding", "query").mapInArrow(run, "vec_id long, leaf int, x array<double>, query boolean")


def _by_leaf(placed: DataFrame, tree: Tree) -> np.ndarray:
    held = np.zeros(tree.leaves, dtype=np.int64)
    for r in placed.groupBy("leaf").agg(F.count("*").alias("n")).collect():     # one row per leaf
        held[r.leaf] = r.n
    return held


def grown(vectors: DataFrame, tree: Tree, dim: int) -> Tree:
    """The tree with every leaf of more than CELL_ROWS rows split further, the largest first if there is no room for all.

    A round counts the rows of the leaves and splits each leaf that is too large in one task, on about PART_SAMPLE of its
    rows.  A leaf of vectors that k-means does not part (copies, say) stays as it is; its rows are spread over cells later.
    """
    whole: set[int] = set()
    while True:
        placed = _placed(vectors, tree, dim)
        held = _by_leaf(placed.select("leaf"), tree)
        large = [leaf for leaf in np.argsort(-held, kind="stable").tolist() if held[leaf] > CELL_ROWS and leaf not in whole]
        large = large[:max(0, MAX_LEAVES - tree.leaves) // BRANCH ** 2]
        if not large:
            return tree
        rates = vectors.sparkSession.createDataFrame([(leaf, PART_SAMPLE / int(held[leaf]), int(held[leaf])) for leaf in large],
                                                     "leaf int, rate double, n long")
        drawn = placed.select("leaf", "x").join(F.broadcast(rates), "leaf").where(F.rand(17) < F.col("rate"))   # rows, so copies of an id too

        largest = tree.largest

        def fit(part: pa.Table) -> pa.Table:
            x = part.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            least = math.ceil(PART_ROWS * len(x) / part.column("n")[0].as_py())
            found = fit_tree(x, largest, leaf_sample=max(LEAF_SAMPLE, least))
            return pa.table({"leaf": part.column("leaf").slice(0, 1), "part": pa.array([pickle.dumps(found)], type=pa.binary())})

        parts = {r.leaf: r.part for r in drawn.groupBy("leaf").applyInArrow(fit, "leaf int, part binary").collect()}    # bounded by MAX_LEAVES
        for leaf in large:
            part = pickle.loads(parts[leaf]) if leaf in parts else None
            if part is None or part.leaves < 2:
                whole.add(leaf)
            else:
                tree.graft(leaf, part)


def _visit_places(placed: DataFrame, tree: Tree, dim: int, ids: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """For each exact neighbour, among all rows, of the few queries: how many leaves are visited before its own."""
    spark = placed.sparkSession
    shared = spark.sparkContext.broadcast((tree, ids, queries))

    def nearest_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, own, q = shared.value
        best = [(np.empty(0), np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64))] * len(q)
        least = np.full(len(q), -np.inf)
        for batch in batches:
            names, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            score = q @ batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim).T
            score[own[:, None] == names[None, :]] = -np.inf
            for i in np.flatnonzero((score > least[:, None]).any(axis=1)).tolist():
                some = np.flatnonzero(score[i] > least[i])
                s, n, f = (np.concatenate(c) for c in zip(best[i], (score[i, some], names[some], leaf[some])))
                order = np.lexsort((n, -s))
                order = order[np.sort(np.unique(n[order], return_index=True)[1])][:k]       # an id once, by its best row
                best[i] = (s[order], n[order], f[order])
                least[i] = s[order][-1] if len(order) == k else -np.inf
        for i, (s, n, f) in enumerate(best):
            yield pa.RecordBatch.from_arrays([pa.array([i] * len(s), type=pa.int32()), pa.array(n, type=pa.int64()), pa.array(s, type=pa.float64()),
                                              pa.array(f, type=pa.int32())], names=["q", "vec_id", "score", "leaf"])

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walker, _, q = shared.value
        for batch in batches:
            wanted: dict[int, list[int]] = {}
            for i, leaf in zip(batch.column("q").to_pylist(), batch.column("leaf").to_pylist()):
                wanted.setdefault(i, []).append(leaf)
            for i, leaves in wanted.items():
                left, found = set(leaves), {}
                for n, leaf in enumerate(walker.visit(q[i])):
                    if leaf in left:
                        found[leaf] = n
                        left.remove(leaf)
                        if not left:
                            break
                yield pa.RecordBatch.from_arrays([pa.array([found[leaf] for leaf in leaves], type=pa.int64())], names=["place"])

    of_tasks = placed.select("vec_id", "leaf", "x").mapInArrow(nearest_of_task, "q int, vec_id long, score double, leaf int")
    of_all = (of_tasks.groupBy("q", "vec_id").agg(F.max(F.struct("score", "leaf")).alias("b"))
              .withColumn("n", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("b.score"), "vec_id"))).where(F.col("n") <= k))
    found = of_all.select("q", F.col("b.leaf").alias("leaf")).repartition("q").mapInArrow(places, "place long")
    return np.array([r.place for r in found.collect()], dtype=np.int64)       # k numbers for each of a few hundred queries


def nearest(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score of the k nearest rows found for each row for which ``is_query`` holds."""
    index = build(vectors, is_query, k)
    if index is None:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return search(index, k)


def search(index: Index, k: int = 20) -> DataFrame:
    """The k nearest rows found for each query of the index, with the visits calibrated for k."""
    dim, placed, ids_held = index.dim, index.placed, index.ids_held
    shared = placed.sparkSession.sparkContext.broadcast(index.tree)
    first_cell, cells = _cells(index.held)

    def to_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows to their cell (probe null), queries to every cell with a visited leaf (probe: those leaves)."""
        for batch in batches:
            ids, leaf = batch.column("vec_id").to_numpy(), batch.column("leaf").to_numpy()
            cell = first_cell[leaf] + (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % cells[leaf]
            yield _rows(cell, ids, batch.column("x"), [None] * len(ids), leaf)
            asked = np.flatnonzero(batch.column("query").fill_null(False).to_numpy(zero_copy_only=False))
            for i in range(0, len(asked), 64):
                out_cell, out_row, out_probe = [], [], []
                for r in asked[i:i + 64].tolist():
                    wanted: dict[int, list[int]] = {}
                    seen = found_ids = 0
                    for leaf_no in shared.value.visit(np.array(batch.column("x")[r].as_py())):
                        seen += 1
                        found_ids += int(ids_held[leaf_no])
                        for c in range(int(first_cell[leaf_no]), int(first_cell[leaf_no] + cells[leaf_no])):
                            wanted.setdefault(c, []).append(leaf_no)
                        if seen >= shared.value.visits and found_ids > k:
                            break
                    for c, probe in wanted.items():
                        out_cell.append(c)
                        out_row.append(r)
                        out_probe.append(probe)
                at = np.array(out_row, dtype=np.int64)
                yield _rows(np.array(out_cell), ids[at], batch.column("x").take(pa.array(at)), out_probe, leaf[at])

    moved = (placed.mapInArrow(to_cells, "cell long, id long, x array<double>, probe array<int>, leaf int")
             .repartition("cell").sortWithinPartitions("cell", F.col("probe").isNotNull(), "id"))
    found = moved.mapInArrow(_search(k, dim), "query_id long, vec_id long, score double")
    best = (found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
            .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))))
    return best.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _cells(held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first cell, cells) of each leaf: neighbouring leaves share a cell, a leaf above CELL_ROWS has several of its own."""
    first, cells = np.zeros(len(held), dtype=np.int64), np.ones(len(held), dtype=np.int64)
    cell, filled = 0, 0
    for leaf, n in enumerate(held.tolist()):
        if filled and filled + n > CELL_ROWS:
            cell, filled = cell + 1, 0
        first[leaf] = cell
        filled += n
        if n > CELL_ROWS:
            cells[leaf] = -(-n // CELL_ROWS)
            cell, filled = cell + int(cells[leaf]), 0
    return first, cells


def _rows(cell: np.ndarray, ids: np.ndarray, x: pa.Array, probe: list, leaf: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(cell, type=pa.int64()), pa.array(ids, type=pa.int64()), x, pa.array(probe, type=pa.list_(pa.int32())),
         pa.array(leaf, type=pa.int32())], names=["cell", "id", "x", "probe", "leaf"])


def _search(k: int, dim: int):
    """The best k ids of a cell for each query sent to it (rows of a cell come first, those of an id together)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts = None, []
        base: tuple[np.ndarray, np.ndarray, np.ndarray] | None = None
        for batch in batches:
            cells = batch.column("cell").to_numpy()
            probes = batch.column("probe")
            asks = probes.is_valid().to_numpy(zero_copy_only=False)
            ids, leaf = batch.column("id").to_numpy(), batch.column("leaf").to_numpy()
            x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
            turn = np.flatnonzero((cells[1:] != cells[:-1]) | (asks[1:] != asks[:-1])) + 1
            cut = [0, *turn.tolist(), len(cells)] if len(cells) else []
            for a, b in zip(cut, cut[1:]):
                if cells[a] != cell:
                    cell, parts, base = cells[a], [], None
                if not asks[a]:
                    parts.append((ids[a:b], leaf[a:b], x[a:b]))
                    continue
                if parts:
                    base = tuple(np.concatenate(c) for c in zip(*parts))
                    parts = []
                if base is not None:
                    for i in range(a, b, _QUERY_BATCH):
                        j = min(b, i + _QUERY_BATCH)
                        yield from _best(ids[i:j], x[i:j], probes[i:j].to_pylist(), *base, k)

    return run


def _best(queries: np.ndarray, q: np.ndarray, probes: list[list[int]], ids: np.ndarray, leaf: np.ndarray, x: np.ndarray,
          k: int) -> Iterator[pa.RecordBatch]:
    low = int(leaf.min())
    asked = np.zeros((len(queries), int(leaf.max()) - low + 2), dtype=bool)
    for i, p in enumerate(probes):
        own = np.array(p) - low
        asked[i, own[(own >= 0) & (own < asked.shape[1] - 1)]] = True
    score = q @ x.T
    score[~asked[:, leaf - low] | (ids[None, :] == queries[:, None])] = -np.inf
    begin = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
    repeats = len(begin) < len(ids)
    nth = np.cumsum(np.append(False, ids[1:] != ids[:-1]))
    best = np.maximum.reduceat(score, begin, axis=1) if repeats else score       # an id's best row counts
    out_q, out_id, out_score = [], [], []
    for i in range(len(queries)):
        own = np.flatnonzero(best[i] > -np.inf)
        least = -np.inf
        if len(own) > k:
            least = np.partition(best[i, own], len(own) - k)[len(own) - k]
            least -= 1e-9 * max(1.0, abs(least))
            own = own[best[i, own] >= least]
        if repeats:
            own = np.flatnonzero((score[i] >= least) & (score[i] > -np.inf))
        exact = (x[own] * q[i]).sum(axis=1)
        order = np.lexsort((ids[own], -exact))
        if repeats:
            order = order[np.sort(np.unique(nth[own][order], return_index=True)[1])]
        order = order[:k]
        out_q.append(np.full(len(order), queries[i]))
        out_id.append(ids[own][order])
        out_score.append(exact[order])
    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out_q), type=pa.int64()), pa.array(np.concatenate(out_id), type=pa.int64()),
                                      pa.array(np.concatenate(out_score), type=pa.float64())], names=["query_id", "vec_id", "score"])
