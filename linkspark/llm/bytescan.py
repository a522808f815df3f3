"""Vectorised work on the UTF-8 bytes of Arrow text columns.

A *slice* is a run of documents whose texts lie one after the other in one
byte array. Words are ``[^\\x20\\x09-\\x0D]+``; as all separators are single
bytes below 0x80, byte positions and code-point positions agree on words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 1 << 20
_HASH_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C55)
_ODD = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165, 0x9FB21C651E98DF25], np.uint64)
_powers = np.ones(1, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> _U(27))
    x = x * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _power(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        out = np.full(max(n, 1 << 12), _BASE, np.uint64)
        out[0] = 1
        _powers = np.multiply.accumulate(out)
    return _powers[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and n+1 offsets of a text column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(column: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) in runs of about ``limit`` bytes; a longer text stands alone."""
    raw, at = text_buffers(column)
    i, n = 0, len(at) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(at, at[i] + limit, "right")) - 1)
        yield i, j, raw[at[i] : at[j]], at[i : j + 1] - at[i]
        i = j


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes, broken at every cut."""
    n = len(inside)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def words(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each document where its words begin in those (n+1 numbers)."""
    starts, ends = runs(~SPACE[raw], at)
    return starts, ends, np.searchsorted(starts, at)


def hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each byte range; the ranges ascend and don't overlap."""
    out = np.zeros(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + _HASH_BYTES, "right")))
        a = int(starts[i])
        part = raw[a : ends[j - 1]]
        part = (LOWER[part] if lower else part).astype(np.uint64) + _U(1)
        s, size = starts[i:j] - a, ends[i:j] - starts[i:j]
        owner = np.repeat(s, size)
        if len(owner) == len(part):
            inside, value = np.arange(len(part)) - owner, part
        else:
            inside = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
            value = part[owner + inside]
        if len(size):
            value = value * _power(int(size.max()) if len(size) else 1)[inside]
            begins = np.cumsum(size) - size
            filled = size > 0
            sums = np.zeros(j - i, np.uint64)
            if filled.any():
                sums[filled] = np.add.reduceat(value, begins[filled])
            out[i:j] = mix(sums + size.astype(np.uint64) * _ODD[7])
        i = j
    return out


def windows(word: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of ``size`` words that lie inside a document, and their start words."""
    if len(word) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    count = len(word) - size + 1
    total = np.zeros(count, np.uint64)
    for k in range(size):
        total += word[k : k + count] * (_ODD[k] + _U(2 * (k // 8)))
    fits = np.ones(count, bool)
    for k in range(1, size):
        edge = first[1:-1] - k
        fits[edge[(edge >= 0) & (edge < count)]] = False
    at = np.flatnonzero(fits)
    return mix(total[at]), at


def shingle_sets(raw: np.ndarray, at: np.ndarray, size: int = 5) -> list[np.ndarray]:
    """For each document the ascending distinct hashes of its lower-cased word shingles.

    A document with fewer words has its whole sequence as one shingle; one without words has none.
    """
    starts, ends, first = words(raw, at)
    word = hashes(raw, starts, ends, lower=True)
    value, where = windows(word, first, size)
    cut = np.searchsorted(where, first)
    out = []
    for d in range(len(at) - 1):
        a, b = int(first[d]), int(first[d + 1])
        if b - a >= size:
            out.append(np.unique(value[cut[d] : cut[d + 1]]))
        elif b > a:
            whole = (word[a:b] * _ODD[: b - a]).sum(dtype=np.uint64) + _U(b - a)
            out.append(mix(np.array([whole], np.uint64) ^ _ODD[6]))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def char_starts(raw: np.ndarray) -> np.ndarray:
    """Running count of code points before each byte (n+1 numbers)."""
    out = np.zeros(len(raw) + 1, np.int64)
    np.cumsum((raw & 0xC0) != 0x80, out=out[1:])
    return out
