"""Distinct byte slices of a buffer by vectorised hashing.

``slice_keys`` is a polynomial modulo 2^64: fast, but different slices can be made to have one key.  It only
*finds* slices that may be equal; ``distinct`` and ``SliceTable`` compare bytes, and ``word_keys`` gives each
distinct slice a keyed digest.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np

_BLOCK = 1 << 18
_PRIME = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@lru_cache(maxsize=1)
def _constants() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(random word of each byte, powers of an odd number, powers of its inverse), all modulo 2^64."""
    rng = np.random.default_rng(20240229)
    words = rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    inverse = pow(_PRIME, -1, 1 << 64)
    def powers(of: int) -> np.ndarray:
        factors = np.full(2 * _BLOCK + 1, of, dtype=np.uint64)
        factors[0] = 1
        return np.cumprod(factors, dtype=np.uint64)

    up, down = powers(_PRIME), powers(pow(_PRIME, -1, 1 << 64))
    return words, up, down


def slice_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit key of each slice ``data[start:end]`` (ascending starts); equal slices have equal keys.

    A slice's polynomial is a difference of prefix sums times an inverse power, so the cost is a few
    array passes over the bytes whatever the slices' lengths.
    """
    words, up, down = _constants()
    keys = np.empty(len(starts), dtype=np.uint64)
    i = 0
    with np.errstate(over="ignore"):
        while i < len(starts):
            base = int(starts[i])
            j = max(i + 1, int(np.searchsorted(ends, base + 2 * _BLOCK, side="right")))
            if int(ends[j - 1]) - base > 2 * _BLOCK:            # one slice longer than the power table
                total, at = 0, base
                while at < int(ends[i]):
                    part = words[data[at:min(at + _BLOCK, int(ends[i]))]]
                    own = int((part * up[:len(part)]).sum(dtype=np.uint64))
                    total = (total + own * pow(_PRIME, at - base, 1 << 64)) & _MASK
                    at += len(part)
                keys[i] = total
            else:
                span = words[data[base:int(ends[j - 1])]]
                sums = np.empty(len(span) + 1, dtype=np.uint64)
                sums[0] = 0
                np.cumsum(span * up[:len(span)], out=sums[1:])
                lo, hi = starts[i:j] - base, ends[i:j] - base
                keys[i:j] = (sums[hi] - sums[lo]) * down[lo]
            i = j
        keys += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
        keys *= np.uint64(0xD6E8FEB86659FD93)
        keys ^= keys >> np.uint64(32)
    return keys


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indices start, start+1, ... of every piece, one after another."""
    ends = np.cumsum(sizes)
    out = np.repeat(starts - (ends - sizes), sizes)
    out += np.arange(len(out), dtype=out.dtype)
    return out


def distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(a slice of each distinct content, number of its content for every slice); compared byte by byte, not by key alone."""
    _, first, inverse = np.unique(slice_keys(data, starts, ends), return_index=True, return_inverse=True)
    sizes, model = ends - starts, first[inverse]
    same = np.array_equal(sizes, sizes[model])
    for i in range(0, len(starts) if same else 0, 1 << 16):
        part = slice(i, i + (1 << 16))
        if int(sizes[part].max()) > _BLOCK:
            same = all(np.array_equal(data[s:s + n], data[m:m + n]) for s, n, m in
                       zip(starts[part].tolist(), sizes[part].tolist(), starts[model[part]].tolist()))
        else:
            own = data[ragged(starts[part], sizes[part])]
            same = np.array_equal(own, data[ragged(starts[model[part]], sizes[part])])
        if not same:
            break
    if same:
        return first, inverse
    seen: dict[bytes, int] = {}
    first_seen, numbers = [], []
    for i, (s, e) in enumerate(zip(starts.tolist(), ends.tolist())):
        content = data[s:e].tobytes()
        if content not in seen:
            seen[content] = len(seen)
            first_seen.append(i)
        numbers.append(seen[content])
    return np.array(first_seen, dtype=np.int64), np.array(numbers, dtype=np.int64)


class SliceTable:
    """Values (integer sequences) of slices seen before, looked up for many slices at once.

    An open-addressing table in arrays: a slice's key leads to an entry, whose bytes are compared with
    the slice's.  When the table is full it starts over, so its memory is bounded by SLOTS / 2 entries and
    BYTES of slices and values each (plus what one batch adds).
    """

    SLOTS = 1 << 21
    BYTES = 48 << 20

    def __init__(self, dtype: np.dtype):
        self.dtype = np.dtype(dtype)
        self.clear()

    def clear(self) -> None:
        self._slot_entry = np.full(self.SLOTS, -1, dtype=np.int32)
        self._slot_key = np.zeros(self.SLOTS, dtype=np.uint64)
        self._n = self._blob_n = self._pool_n = 0
        self._blob, self._pool = np.empty(1 << 16, dtype=np.uint8), np.empty(1 << 16, dtype=self.dtype)
        # Per entry: start and size of its slice, start and size of its value.
        self._entry = np.empty((1 << 14, 4), dtype=np.int32)

    def _find(self, keys: np.ndarray) -> np.ndarray:
        slot = (keys >> np.uint64(43)).astype(np.int64)                 # 21 bits
        out = self._slot_entry[slot]
        open_ = np.flatnonzero((out >= 0) & (self._slot_key[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & (self.SLOTS - 1)
            entry = self._slot_entry[slot]
            out[open_] = entry
            more = (entry >= 0) & (self._slot_key[slot] != keys[open_])
            open_, slot = open_[more], slot[more]
        return out

    def _same(self, entry: np.ndarray, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Is the entry's slice the given one, byte by byte?"""
        same = self._entry[entry, 1] == sizes
        for i in range(0, len(entry), 1 << 16):
            part = np.flatnonzero(same[i:i + (1 << 16)]) + i
            if not len(part):
                continue
            size = sizes[part]
            differs = data[ragged(starts[part], size)] != self._blob[ragged(self._entry[entry[part], 0].astype(np.int64), size)]
            if differs.any():
                same[part[np.unique(np.searchsorted(np.cumsum(size), np.flatnonzero(differs), side="right"))]] = False
        return same

    def _add(self, keys: np.ndarray, slices: list[bytes], values: list[bytes]) -> np.ndarray:
        """New entries; keys that are taken by other bytes get an entry that no key leads to."""
        blob, pool = np.frombuffer(b"".join(slices), dtype=np.uint8), np.frombuffer(b"".join(values), dtype=self.dtype)
        self._blob, self._blob_n = _grown(self._blob, self._blob_n, blob)
        self._pool, self._pool_n = _grown(self._pool, self._pool_n, pool)
        sizes = np.fromiter(map(len, slices), dtype=np.int64, count=len(slices))
        lengths = np.fromiter(map(len, values), dtype=np.int64, count=len(values)) // self.dtype.itemsize
        new = np.stack((self._blob_n - len(blob) + np.cumsum(sizes) - sizes, sizes,
                        self._pool_n - len(pool) + np.cumsum(lengths) - lengths, lengths), axis=1).astype(np.int32)
        entries = np.arange(self._n, self._n + len(new))
        self._entry, self._n = _grown(self._entry, self._n, new)
        todo = np.flatnonzero(self._find(keys) < 0)
        slot = (keys[todo] >> np.uint64(43)).astype(np.int64)
        while len(todo):
            free = self._slot_entry[slot] < 0
            self._slot_entry[slot[free]] = entries[todo[free]]          # of several for one slot the last stays
            placed = self._slot_entry[slot] == entries[todo]
            self._slot_key[slot[placed]] = keys[todo[placed]]
            todo, slot = todo[~placed], (slot[~placed] + 1) & (self.SLOTS - 1)
        return entries

    def values(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, make) -> tuple[np.ndarray, np.ndarray]:
        """(values of all slices one after another, size of each); ``make`` gives the values of new distinct slices."""
        if not len(starts):
            return np.empty(0, dtype=self.dtype), np.empty(0, dtype=np.int64)
        most = self.SLOTS // 4                                          # so that the new slices of one turn always find slots
        if len(starts) > most:
            parts = [self.values(data, starts[i:i + most], ends[i:i + most], make) for i in range(0, len(starts), most)]
            return np.concatenate([v for v, _ in parts]), np.concatenate([n for _, n in parts])
        keys, sizes = slice_keys(data, starts, ends), ends - starts
        entry = self._find(keys).astype(np.int64)
        known = np.flatnonzero(entry >= 0)
        entry[known[~self._same(entry[known], data, starts[known], sizes[known])]] = -1
        missing = np.flatnonzero(entry < 0)
        if len(missing):
            model, number = distinct(data, starts[missing], ends[missing])
            model = missing[model]
            if self._n and (self._n + len(model) > self.SLOTS // 2 or max(self._blob_n, self._pool.itemsize * self._pool_n) > self.BYTES):
                self.clear()
                return self.values(data, starts, ends, make)
            base = int(starts[model].min())
            raw = data[base:int(ends[model].max())].tobytes()
            slices = list(map(raw.__getitem__, map(slice, (starts[model] - base).tolist(), (ends[model] - base).tolist())))
            entry[missing] = self._add(keys[model], slices, make(slices))[number]
        lengths = self._entry[entry, 3].astype(np.int64)
        return self._pool[ragged(self._entry[entry, 2].astype(np.int64), lengths)], lengths


@lru_cache(maxsize=1)
def _digests() -> SliceTable:
    return SliceTable(np.dtype(np.uint64))


def word_keys(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit digest (keyed BLAKE2b) of each slice, computed once per distinct slice."""
    def make(slices: list[bytes]) -> list[bytes]:
        return [hashlib.blake2b(x, digest_size=8, key=b"word").digest() for x in slices]

    return _digests().values(data, starts, ends, make)[0]


def _grown(held: np.ndarray, n: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    if n + len(more) > len(held):
        held = np.concatenate((held[:n], np.empty((max(n, len(more)) + len(more), *held.shape[1:]), dtype=held.dtype)))
    held[n:n + len(more)] = more
    return held, n + len(more)
