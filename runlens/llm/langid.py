"""Language identification with a byte convolutional network.

Network: byte embedding, filters of widths 2, 3 and 4 with a rectifier, max
pooling over a fixed-length window, one dense layer, softmax.  It is trained in
numpy (Adam, hand-written gradients) on a bounded sample of labelled texts and
applied to *all* windows of every whole text; a text's probabilities are the
mean over its windows, weighted by their bytes.

For prediction the embedding and the filters are folded into tables indexed by
byte pairs (a filter over k bytes is a sum of one or two table rows), so a
window costs five gathers instead of a matrix product per position.

Defined cases: a text that is null or has no letter is ``und`` with score 0;
without any labelled text everything is ``und``; rows that repeat are predicted
row by row; other columns are never read by the prediction, and
``keep_identified`` hands them on, whatever they are called; languages of equal
probability go to the first by name; an empty table gives no model and no rows;
a text of any length is predicted from all its windows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm._common import prepare, rows_batch, text_slices

WINDOW = 256
DIM = 8
FILTERS = 16
WIDTHS = (2, 3, 4)
#: Bounds of the training sample: documents per language, windows per document.  With more than FULL_LANGUAGES
#: languages each has an equal part of TRAIN_DOCS * FULL_LANGUAGES documents, one at least.
TRAIN_DOCS = 1000
TRAIN_WINDOWS = 4
FULL_LANGUAGES = 64
EPOCHS = 4
_BATCH = 64
_CELLS = 1 << 22            # probabilities (windows x languages) held at a time
_ASCII_LETTER = re.compile("[A-Za-z]")
#: Labels that a model can learn, the most frequent ones (the softmax has one row for each).
MAX_LANGUAGES = 4096


def has_letter(text: str) -> bool:
    """Does a text hold a code point of category L?"""
    return _ASCII_LETTER.search(text) is not None or any(map(str.isalpha, text))


@dataclass
class Model:
    languages: list[str]
    weights: dict[str, np.ndarray]
    _tables: tuple | None = field(default=None, repr=False)

    def __getstate__(self):
        return {"languages": self.languages, "weights": self.weights, "_tables": None}

    def tables(self) -> tuple[np.ndarray, ...]:
        """Filter sums by byte pair: width 2; width 3 (pair, third byte); width 4 (first and last pair)."""
        if self._tables is None:
            w = self.weights

            def single(width: int, j: int) -> np.ndarray:
                return w["embed"] @ w[f"conv{width}"][j * DIM:(j + 1) * DIM]

            def pair(width: int, j: int) -> np.ndarray:
                return (single(width, j)[:, None] + single(width, j + 1)[None]).reshape(65536, FILTERS).astype(np.float32)

            self._tables = (pair(2, 0) + w["bias2"], pair(3, 0) + w["bias3"], single(3, 2).astype(np.float32),
                            pair(4, 0) + w["bias4"], pair(4, 2))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax of each window (rows of WINDOW bytes)."""
        out = np.empty((len(windows), len(self.languages)))
        t2, t3, t3c, t4, t4b = self.tables()
        for i in range(0, len(windows), 16):
            some = windows[i:i + 16]
            code = some[:, :-1].astype(np.int32) * 256 + some[:, 1:]
            pooled = np.concatenate((t2[code].max(axis=1), (t3[code[:, :-1]] + t3c[some[:, 2:]]).max(axis=1),
                                     (t4[code[:, :-2]] + t4b[code[:, 2:]]).max(axis=1)), axis=1)
            out[i:i + 16] = _softmax(np.maximum(pooled, 0) @ self.weights["dense"] + self.weights["bias"])
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: bytes) -> np.ndarray:
    """All windows of a text, the last one filled up with zero bytes."""
    n = max(1, -(-len(data) // WINDOW))
    out = np.zeros(n * WINDOW, dtype=np.uint8)
    out[:len(data)] = np.frombuffer(data, dtype=np.uint8)
    return out.reshape(n, WINDOW)


def train(texts: list[str], labels: list[str], seed: int = 7) -> Model:
    """Fit the network on labelled texts: a few windows of each, some cut short so that short texts are known too."""
    languages = sorted(set(labels))
    number = {name: i for i, name in enumerate(languages)}
    rng = np.random.default_rng(seed)
    x, y = [], []
    for text, label in zip(texts, labels):
        data = text.encode("utf-8", "surrogatepass")
        for k in range(TRAIN_WINDOWS):
            size = WINDOW if k % 2 == 0 else int(rng.integers(12, WINDOW))
            start = int(rng.integers(0, max(1, len(data) - size + 1)))
            x.append(windows_of(data[start:start + size])[0])
            y.append(number[label])
            if len(data) <= 12:
                break
    xs, ys = np.array(x, dtype=np.uint8), np.array(y)
    share = np.bincount(ys, minlength=len(languages)) / len(ys)
    w = {"embed": rng.normal(0, 0.5, (256, DIM)), "dense": rng.normal(0, 0.1, (FILTERS * len(WIDTHS), len(languages))),
         "bias": np.zeros(len(languages))}
    for k in WIDTHS:
        w[f"conv{k}"] = rng.normal(0, 1 / np.sqrt(k * DIM), (k * DIM, FILTERS))
        w[f"bias{k}"] = np.zeros(FILTERS)
    w = {name: v.astype(np.float32) for name, v in w.items()}
    first, second, step = {n: np.zeros_like(v) for n, v in w.items()}, {n: np.zeros_like(v) for n, v in w.items()}, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(ys))
        rate = 0.01 / (1 + epoch)
        for i in range(0, len(order), _BATCH):
            some = order[i:i + _BATCH]
            grads = _gradients(w, xs[some], ys[some], 1 / np.maximum(share[ys[some]] * len(languages), 0.1))
            step += 1
            for name, g in grads.items():
                first[name] = 0.9 * first[name] + 0.1 * g
                second[name] = 0.999 * second[name] + 0.001 * g * g
                w[name] -= (rate * (first[name] / (1 - 0.9 ** step)) / (np.sqrt(second[name] / (1 - 0.999 ** step)) + 1e-7)).astype(np.float32)
    return Model(languages, w)


def _gradients(w: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the weighted cross entropy; the maximum passes its gradient to the place it came from."""
    embedded = w["embed"][x]
    n = len(x)
    pooled, at = [], {}
    for k in WIDTHS:
        columns = np.concatenate([embedded[:, j:WINDOW - k + 1 + j] for j in range(k)], axis=2)
        value = columns @ w[f"conv{k}"]
        at[k] = value.argmax(axis=1)
        pooled.append(np.take_along_axis(value, at[k][:, None], axis=1)[:, 0] + w[f"bias{k}"])
    raw = np.concatenate(pooled, axis=1)
    hidden = np.maximum(raw, 0)
    p = _softmax(hidden @ w["dense"] + w["bias"])
    p[np.arange(n), y] -= 1
    p *= (weight / n)[:, None]
    out = {"dense": hidden.T @ p, "bias": p.sum(axis=0), "embed": np.zeros_like(w["embed"])}
    back = (p @ w["dense"].T) * (raw > 0)
    rows = np.arange(n)[:, None]
    for c, k in enumerate(WIDTHS):
        g = back[:, c * FILTERS:(c + 1) * FILTERS]
        out[f"bias{k}"] = g.sum(axis=0)
        grad = np.zeros_like(w[f"conv{k}"])
        for j in range(k):
            byte = x[rows, at[k] + j]                                   # (n, FILTERS)
            block = w[f"conv{k}"][j * DIM:(j + 1) * DIM]                # (DIM, FILTERS)
            grad[j * DIM:(j + 1) * DIM] = np.einsum("nfd,nf->df", w["embed"][byte], g)
            np.add.at(out["embed"], byte, g[:, :, None] * block.T[None])
        out[f"conv{k}"] = grad
    return out


def held_out(doc_id: Column | str) -> Column:
    """True for documents that no training may see: crc32 of the decimal doc_id leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2,
                      F.lit(False))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model | None:
    """Train on at most ``train_docs`` labelled, not held-out documents of each language found.

    A first pass counts the labelled documents with letters of each language; a second takes those whose
    hash of (doc_id, text) falls below the language's rate, and at least the one with the least hash.
    Rows that repeat count once in the sample; ties of the hash go to the lesser text.  Only sampled
    rows are shuffled by language.  With more than FULL_LANGUAGES languages each has fewer documents,
    beyond MAX_LANGUAGES the rarer ones are not learned.  None if no document has both text and language.
    """
    prepare(docs.sparkSession)
    usable = docs.select("doc_id", "text", "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out("doc_id"))
    place = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 30))
    stretches = usable.select("lang", _around("text").alias("text"), place.alias("place")).where(F.col("text").rlike(r"\p{L}"))
    counts = (stretches.groupBy("lang").agg(F.count("*").alias("n"), F.min("place").alias("least"))
              .orderBy(F.col("n").desc(), "lang").limit(MAX_LANGUAGES).collect())
    if not counts:
        return None
    train_docs = max(1, min(train_docs, train_docs * FULL_LANGUAGES // len(counts)))
    wanted = max(1.2 * train_docs, train_docs + 20)
    rates = docs.sparkSession.createDataFrame(
        [(r.lang, max(r.least + 1, int(min(1.0, wanted / r.n) * (1 << 30)))) for r in counts], "lang string, rate long")
    sample = (stretches.join(F.broadcast(rates), "lang").where("place < rate")          # MAX_LANGUAGES rows at most
              .select("lang", "text", "place").distinct()
              .withColumn("nth", F.row_number().over(Window.partitionBy("lang").orderBy("place", "text")))
              .where(F.col("nth") <= train_docs).collect())
    chosen: dict[str, list[str]] = {}
    for r in sorted(sample, key=lambda r: (r.place, r.lang, r.text)):
        if has_letter(r.text):
            chosen.setdefault(r.lang, []).append(r.text)
    pairs = [(t, lang) for lang in sorted(chosen) for t in chosen[lang]]
    return train([t for t, _ in pairs], [lang for _, lang in pairs]) if pairs else None


def _around(text: str) -> Column:
    """A stretch of 2,000 code points from the middle of a training text, so that the sample's size is bounded."""
    return F.substring(F.col(text), F.greatest(F.lit(1), (F.length(text) / 2).cast("int") - 1000), F.lit(2000))


_PREDICTED = pa.schema([("doc_id", pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64())])


def _most_likely(model: Model, data: list[bytes]) -> Iterator[tuple[int, float]]:
    """(language, mean probability) of each text; at most about _CELLS probabilities are held at a time."""
    most = max(16, _CELLS // len(model.languages) // 16 * 16)
    at = 0
    while at < len(data):
        end, held = at, 0
        while end < len(data) and (end == at or held + max(1, -(-len(data[end]) // WINDOW)) <= most):
            held += max(1, -(-len(data[end]) // WINDOW))
            end += 1
        if held > most:                                                     # one long text
            total = np.zeros(len(model.languages))
            for a in range(0, len(data[at]), most * WINDOW):
                part = data[at][a:a + most * WINDOW]
                weight = np.minimum(WINDOW, len(part) - WINDOW * np.arange(-(-len(part) // WINDOW)))
                total += weight @ model.probabilities(windows_of(part))
            mean = total[None] / len(data[at])
        else:
            parts = [windows_of(d) for d in data[at:end]]
            probabilities = model.probabilities(np.concatenate(parts))
            weight = np.concatenate([np.minimum(WINDOW, len(d) - WINDOW * np.arange(len(p))) for d, p in zip(data[at:end], parts)])
            first = np.cumsum([0] + [len(p) for p in parts[:-1]])
            mean = np.add.reduceat(probabilities * weight[:, None], first) / np.add.reduceat(weight, first)[:, None]
        best = mean.argmax(axis=1)
        yield from zip(best.tolist(), mean[np.arange(len(best)), best].tolist())
        at = end


def predict_batch(model: Model | None, texts: list[str | None]) -> tuple[list[str], list[float]]:
    known = [bool(t) and has_letter(t) for t in texts]
    data = [t.encode("utf-8", "surrogatepass") for t, k in zip(texts, known) if k]
    if model is None or not data:
        return ["und"] * len(texts), [0.0] * len(texts)
    found = ((model.languages[i], min(1.0, p)) for i, p in _most_likely(model, data))
    pairs = [next(found) if k else ("und", 0.0) for k in known]
    return [p[0] for p in pairs], [p[1] for p in pairs]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred, score: one row per input row, from the text alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 20):
            languages, scores = predict_batch(model, part.column("text").to_pylist())
            yield rows_batch({"doc_id": part.column("doc_id").to_pylist(), "lang_pred": languages, "score": scores}, _PREDICTED)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


#: A text is identified if its best language has at least this many times the share that guessing would give it.
STANDS_OUT = 1.2


def least_score(model: Model | None) -> float:
    return STANDS_OUT / len(model.languages) if model is not None and len(model.languages) > 1 else 0.0


def keep_identified(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of ``docs`` (all columns) whose language was identified.

    Rejected are texts without any letter (or without text) and texts for which no language stands
    out from guessing.
    """
    least = least_score(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in text_slices(batches, limit=1 << 20):
            languages, scores = predict_batch(model, part.column("text").to_pylist())
            yield part.filter(pa.array([x != "und" and s >= least for x, s in zip(languages, scores)]))

    return docs.mapInArrow(run, docs.schema)
