"""Token ids in wavelet-matrix shards.

``write_shards`` encodes every text, puts the documents in ascending order of
doc_id and writes their ids as shards of about a million tokens.  A shard is
one compressed image: a wavelet matrix (one bit-plane per bit of the token id,
each plane the ids stably partitioned by the bits above) with the documents'
ids and lengths.  Planes answer ``access`` (the id at a place), ``rank`` and
``count`` (occurrences in a range) and ``select`` (place of the k-th
occurrence) without unpacking the shard.

Image layout (little endian): ``WMX1``, tokens, documents, bits (three u64);
then per section a u64 length and a zstd frame: document ids (i64, and a bit
for null), document lengths (u64), and one section per plane, most
significant bit first, bits packed from the high end of each byte.  Images are
stored as binary rows of a Parquet table, so that Spark's commit protocol makes
retried and speculative tasks harmless on any store.

Defined cases: a null text is an empty text and still gets the end id, an empty
table gives no shard, a null doc_id sorts first, repeated doc_ids are ordered
by length and ids, and a document longer than a shard makes a shard of its own.
Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import struct
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlens.llm._common import prepare, text_slices, written
from runlens.llm._slices import SliceTable

_MAGIC = b"WMX1"
_NULL_ID = np.iinfo(np.int64).min
SHARD_TOKENS = 1 << 20
MAX_PARTS = 4096            # ranges of doc_id; the driver holds one count for each
PART_DOCS = 2048            # documents in a range as long as there are fewer than MAX_PARTS ranges


class WaveletMatrix:
    """Bit-planes of a sequence of token ids with rank directories (popcounts in front of each 64-bit word)."""

    def __init__(self, n: int, planes: list[np.ndarray]):
        self.n, self.bits, self.planes = n, len(planes), planes

    @cached_property
    def _words(self) -> list[np.ndarray]:
        """The planes in 64-bit words, and a spare one for the place behind the end."""
        out = []
        for plane in self.planes:
            raw = np.zeros((self.n // 64 + 1) * 8, dtype=np.uint8)
            raw[:len(plane)] = plane
            out.append(raw.view(">u8").astype(np.uint64))
        return out

    @cached_property
    def _before(self) -> list[np.ndarray]:
        return [np.concatenate(([0], np.cumsum(np.bitwise_count(w), dtype=np.int64))) for w in self._words]

    @cached_property
    def _zeros(self) -> list[int]:
        return [self.n - int(np.bitwise_count(p).sum(dtype=np.int64)) for p in self.planes]

    @classmethod
    def build(cls, ids: np.ndarray, bits: int) -> WaveletMatrix:
        now, planes = ids, []
        for shift in range(bits - 1, -1, -1):
            bit = (now >> now.dtype.type(shift)) & now.dtype.type(1)
            planes.append(np.packbits(bit.astype(bool)))
            now = np.concatenate((now.take(np.flatnonzero(bit == 0)), now.take(np.flatnonzero(bit))))
        return cls(len(ids), planes)

    def _ones(self, level: int, at: np.ndarray) -> np.ndarray:
        """Ones in front of each place of a plane."""
        word = at >> 6
        keep = ~(np.uint64(0xFFFFFFFFFFFFFFFF) >> (at & 63).astype(np.uint64))
        return self._before[level][word] + np.bitwise_count(self._words[level][word] & keep)

    def access(self, at: np.ndarray) -> np.ndarray:
        at = np.asarray(at, dtype=np.int64).copy()
        out = np.zeros(len(at), dtype=np.int64)
        for level in range(self.bits):
            bit = (self._words[level][at >> 6] >> (63 - (at & 63)).astype(np.uint64)) & np.uint64(1)
            ones = self._ones(level, at)
            at = np.where(bit == 1, self._zeros[level] + ones, at - ones)
            out = out << 1 | bit.astype(np.int64)
        return out

    def _bounds(self, token: int, start: int, end: int) -> tuple[int, int]:
        lo, hi = np.array([start]), np.array([end])
        for level in range(self.bits):
            a, b = self._ones(level, lo), self._ones(level, hi)
            if token >> (self.bits - 1 - level) & 1:
                lo, hi = self._zeros[level] + a, self._zeros[level] + b
            else:
                lo, hi = lo - a, hi - b
        return int(lo[0]), int(hi[0])

    def count(self, token: int, start: int = 0, end: int | None = None) -> int:
        """Occurrences of a token id in [start, end)."""
        if not 0 <= token < 1 << self.bits:
            return 0
        lo, hi = self._bounds(token, start, self.n if end is None else end)
        return hi - lo

    def rank(self, token: int, end: int) -> int:
        return self.count(token, 0, end)

    def _select_bit(self, level: int, one: bool, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) ones or zeros of a plane."""
        ones = self._before[level]
        before = ones if one else np.arange(len(ones)) * 64 - ones
        word = np.searchsorted(before, k, side="right") - 1
        word = np.minimum(word, len(self._words[level]) - 1)
        held = self._words[level][word] if one else ~self._words[level][word]
        left = k - before[word]
        bits = np.unpackbits(held.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        inside = (np.cumsum(bits, axis=1, dtype=np.int16) > left[:, None]).argmax(axis=1)
        return word * 64 + inside

    def select(self, token: int, k: np.ndarray) -> np.ndarray:
        """Places of the k-th (from 0) occurrences of a token id, climbing from the deepest plane."""
        lo, _ = self._bounds(token, 0, self.n)
        at = np.asarray(k, dtype=np.int64) + lo
        for level in range(self.bits - 1, -1, -1):
            one = bool(token >> (self.bits - 1 - level) & 1)
            at = self._select_bit(level, one, at - self._zeros[level] if one else at)
        return at

    def locate(self, token: int) -> np.ndarray:
        return self.select(token, np.arange(self.count(token)))

    def unpack(self) -> np.ndarray:
        """All ids in order: the partitions undone from the deepest plane upwards."""
        now = np.zeros(self.n, dtype=np.uint32 if self.bits > 16 else np.uint16)
        for level in range(self.bits - 1, -1, -1):
            bit = np.unpackbits(self.planes[level], count=self.n)
            out = np.empty_like(now)
            zeros = self._zeros[level]
            out[np.flatnonzero(bit == 0)] = now[:zeros]
            out[np.flatnonzero(bit)] = now[zeros:] | now.dtype.type(1 << (self.bits - 1 - level))
            now = out
        return now


def pack_image(doc_ids: list[int | None], lengths: list[int], ids: np.ndarray, bits: int) -> bytes:
    matrix = WaveletMatrix.build(ids, bits)
    keys = np.array([0 if d is None else d for d in doc_ids], dtype="<i8")
    nulls = np.packbits(np.array([d is None for d in doc_ids], dtype=bool))
    sections = [keys.tobytes() + nulls.tobytes(), np.array(lengths, dtype="<u8").tobytes(),
                *(p.tobytes() for p in matrix.planes)]
    out = [_MAGIC, struct.pack("<QQQ", len(ids), len(doc_ids), bits)]
    for raw in sections:
        squeezed = pa.compress(raw, codec="zstd", asbytes=True)
        out += [struct.pack("<QQ", len(raw), len(squeezed)), squeezed]
    return b"".join(out)


def open_image(image: bytes) -> tuple[list[int | None], np.ndarray, WaveletMatrix]:
    """(doc ids, document lengths, wavelet matrix) of one shard image."""
    if image[:4] != _MAGIC:
        raise ValueError("not a token shard")
    n, docs, bits = struct.unpack_from("<QQQ", image, 4)
    at, sections = 28, []
    while at < len(image):
        size, squeezed = struct.unpack_from("<QQ", image, at)
        sections.append(pa.decompress(image[at + 16:at + 16 + squeezed], decompressed_size=size, codec="zstd", asbytes=True))
        at += 16 + squeezed
    keys = np.frombuffer(sections[0][:docs * 8], dtype="<i8").tolist()
    nulls = np.unpackbits(np.frombuffer(sections[0][docs * 8:], dtype=np.uint8), count=docs)
    for i in np.flatnonzero(nulls).tolist():
        keys[i] = None
    planes = [np.frombuffer(s, dtype=np.uint8) for s in sections[2:]]
    return keys, np.frombuffer(sections[1], dtype="<u8").astype(np.int64), WaveletMatrix(n, planes[:bits])


# ------------------------------------------------------------------ encoding

_GAP, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def _latin() -> tuple[np.ndarray, np.ndarray]:
    """(lower case, class) of the code points below U+0100."""
    lower = np.array([ord(chr(i).lower()) for i in range(256)], dtype=np.uint8)
    cls = np.full(256, _OTHER, dtype=np.uint8)
    for i in range(256):
        if unicodedata.category(chr(i)).startswith("L"):
            cls[i] = _LETTER
        elif unicodedata.category(chr(i)).startswith("N"):
            cls[i] = _NUMBER
    cls[[9, 10, 11, 12, 13, 32, 0x85, 0xA0]] = _GAP
    return lower, cls


def _latin_slices(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pre-tokeniser's slices in lower-case single-byte text.

    Contractions ('s 't 'm 'd 're 've 'll), runs of letters, single numbers, runs of anything else but blanks.
    """
    cls = _latin()[1][data]
    before = np.concatenate(([_GAP], cls[:-1])).astype(np.uint8)
    start = (cls != _GAP) & ((cls != before) | (cls == _NUMBER))
    quote = np.flatnonzero((data == 0x27) & (before != _OTHER))
    if len(quote):
        padded = np.concatenate((data, np.zeros(3, dtype=np.uint8)))
        classes = np.concatenate((cls, np.zeros(3, dtype=np.uint8)))
        start = np.concatenate((start, np.zeros(3, dtype=bool)))
        one, two = padded[quote + 1], padded[quote + 2]
        short = quote[np.isin(one, np.frombuffer(b"stmd", dtype=np.uint8))]
        long = quote[(np.isin(one, np.frombuffer(b"rv", dtype=np.uint8)) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))]
        start[short + 1] = start[long + 1] = start[long + 2] = False
        start[short + 2] |= classes[short + 2] != _GAP
        start[long + 3] |= classes[long + 3] != _GAP
        start = start[:len(data)]
    starts = np.flatnonzero(start)
    gaps = np.append(np.flatnonzero(cls == _GAP), len(data))
    ends = np.minimum(np.append(starts[1:], len(data)), gaps[np.searchsorted(gaps, starts)])
    return starts, ends


class WordTokenizer:
    """A tokenizer file of the tokenizers library, whose library calls are kept per distinct slice.

    The library's own pre-tokeniser drops blanks and encodes each slice alone, so the ids of a text
    are the ids of its slices in order.  Texts of code points below U+0100 (lower-casing and
    normalisation act on them character by character) are cut here and each *distinct* slice goes
    through the library once; any other text, and one that holds a control string, goes through the library whole.
    """

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # The library finds the file's control strings inside a text; such texts go through it whole.
        added = self.tokenizer.get_added_tokens_decoder().values()
        self._control = sorted({t.content for t in added})
        self._normalized = any(t.normalized for t in added)     # such strings are found in lower-cased text
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bits = max(1, max(vocabulary.values()).bit_length())
        self.dtype = np.dtype("<u2") if self.bits <= 16 else np.dtype("<u4")
        self._ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        for token, i in vocabulary.items():
            self._ends[i] = token.endswith("</w>")
        self._table = SliceTable(self.dtype)

    def _library(self, slices: list[bytes]) -> Iterator[bytes]:
        """Ids of distinct slices: a thousand joined by blanks per call, cut at the ids that end a word."""
        words = [x.decode("latin-1") for x in slices]
        for i in range(0, len(words), 1000):
            some = words[i:i + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids,
                           dtype=self.dtype)
            cut = np.flatnonzero(self._ends[ids]) + 1
            if len(cut) == len(some):
                raw, ends = ids.tobytes(), (cut * self.dtype.itemsize).tolist()
                yield from map(raw.__getitem__, map(slice, [0, *ends[:-1]], ends))
            else:                                       # a slice that isn't one word to the library
                for w in some:
                    own = self.tokenizer.encode_batch_fast([w], add_special_tokens=False)[0].ids
                    yield np.array(own, dtype=self.dtype).tobytes()

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out: list[np.ndarray | None] = [None] * len(texts)
        latin, which = [], []
        for i, text in enumerate(texts):
            try:
                if any(c in text for c in self._control) or self._normalized:
                    raise ValueError("for the library")
                latin.append(text.encode("latin-1"))
                which.append(i)
            except ValueError:                          # UnicodeEncodeError is one
                ids = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids
                out[i] = np.array(ids, dtype=self.dtype)
        if latin:
            data = _latin()[0][np.frombuffer(b"\n".join(latin), dtype=np.uint8)]
            first = np.cumsum([0] + [len(x) + 1 for x in latin])
            starts, ends = _latin_slices(data)
            ids, sizes = self._table.values(data, starts, ends, lambda slices: list(self._library(slices)))
            done = np.concatenate(([0], np.cumsum(sizes)))
            cut = done[np.searchsorted(starts, first)].tolist()
            for i, a, b in zip(which, cut, cut[1:]):
                out[i] = ids[a:b]
        return out


@lru_cache(maxsize=2)
def _tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


# ------------------------------------------------------------------ operators

def write_shards(docs: DataFrame, path: str, end_id: int | None = 1) -> DataFrame:
    """Encode, order by doc_id and write shard images; returns the table of shards read back.

    Columns: part (range of doc_id), first (tokens of the part in front of the shard), n_tokens,
    n_docs and image.  Only ids move in the one shuffle; ranges come from quantiles of doc_id, so
    that the texts are encoded once.
    """
    spark = docs.sparkSession
    prepare(spark)
    keyed = docs.select("doc_id", "text")
    total = keyed.count()
    parts = max(1, min(MAX_PARTS, -(-total // PART_DOCS)))
    cuts = np.array(keyed.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.1 / parts)
                    if parts > 1 else [], dtype=np.float64)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        tail = b"" if end_id is None else np.array([end_id], dtype=tok.dtype).tobytes()
        for part in text_slices(batches, limit=1 << 20):
            raw = [x.tobytes() + tail for x in tok.encode([t or "" for t in part.column("text").to_pylist()])]
            keys = part.column("doc_id").cast(pa.int64())
            at = np.searchsorted(cuts, np.array([_NULL_ID if k is None else k for k in keys.to_pylist()],
                                                dtype=np.float64), side="left")
            yield pa.RecordBatch.from_arrays(
                [pa.array(at, type=pa.int32()), keys, pa.array([len(x) // tok.dtype.itemsize for x in raw], type=pa.int64()),
                 pa.array(raw, type=pa.binary())], names=["part", "doc_id", "n", "ids"])

    image_schema = pa.schema([("part", pa.int32()), ("first", pa.int64()), ("n_tokens", pa.int64()),
                              ("n_docs", pa.int64()), ("image", pa.binary())])

    def images(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = _tokenizer(path)
        part, first, held, docs_held, raw = None, 0, 0, [], []

        def flush() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(raw), dtype=tok.dtype)
            image = pack_image([d for d, _ in docs_held], [n for _, n in docs_held], ids, tok.bits)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], type=f.type) for x, f in zip((part, first, held, len(docs_held), image), image_schema)],
                schema=image_schema)

        for batch in batches:
            for p, d, n, ids in zip(*(batch.column(c).to_pylist() for c in ("part", "doc_id", "n", "ids"))):
                if docs_held and (p != part or held + n > SHARD_TOKENS):
                    yield flush()
                    first, held, docs_held, raw = (first + held if p == part else 0), 0, [], []
                if p != part:
                    part, first = p, 0
                held += n
                docs_held.append((d, n))
                raw.append(ids)
        if docs_held:
            yield flush()

    ids = keyed.mapInArrow(encoded, "part int, doc_id long, n long, ids binary")
    shards = (ids.repartitionById(parts, F.col("part")).sortWithinPartitions("part", "doc_id", "n", "ids")
              .mapInArrow(images, "part int, first long, n_tokens long, n_docs long, image binary"))
    return written(shards, "token-shards")


def part_starts(shards: DataFrame) -> dict[int, int]:
    """Tokens in front of each part (at most MAX_PARTS rows come to the driver)."""
    starts, at = {}, 0
    for part, n in sorted((r.part, r.n) for r in shards.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()):
        starts[part] = at
        at += n
    return starts


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, unpacked from the shard images."""
    starts = part_starts(shards)
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, first, image in zip(*(batch.column(c) for c in ("part", "first", "image"))):
                keys, lengths, matrix = open_image(image.as_py())
                ids = memoryview(matrix.unpack().astype("<u4")).cast("B")
                cut = np.concatenate(([0], np.cumsum(lengths))).tolist()
                start = starts[part.as_py()] + first.as_py()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, type=pa.int64()), pa.array([start + c for c in cut[:-1]], type=pa.int64()),
                     pa.array(lengths, type=pa.int64()),
                     pa.array([zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(cut, cut[1:])], type=pa.int64())], schema=schema)

    return shards.select("part", "first", "image").mapInArrow(
        run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_occurrences(shards: DataFrame, token: int) -> DataFrame:
    """doc_id and place (inside the document) of every occurrence of one token id, by select on the planes."""
    schema = pa.schema([("doc_id", pa.int64()), ("place", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for image in batch.column("image"):
                keys, lengths, matrix = open_image(image.as_py())
                at = matrix.locate(token)
                first = np.concatenate(([0], np.cumsum(lengths)))
                doc = np.searchsorted(first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in doc.tolist()], type=pa.int64()),
                                                  pa.array(at - first[doc], type=pa.int64())], schema=schema)

    return shards.select("image").mapInArrow(run, "doc_id long, place long")
