"""Vectorised text kernels shared by the corpus operators.

A batch of texts is one UTF-8 byte buffer plus offsets, as Arrow holds it. Words
are found with byte tables and hashed with a polynomial over the buffer, so a
batch needs no Python loop per word. All hashes are 64 bits wide.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash

PIECE = 1 << 20
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0x5851F42D4C957F2D

SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True
#: Separators for models that ignore punctuation: all ASCII but letters and digits.
PUNCTUATION = np.array([not (chr(b).isalnum() or b >= 128) for b in range(256)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_TABLE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_TABLE_LOWER = _TABLE[LOWER]


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWERS: list[np.ndarray] = []


def _power_tables() -> list[np.ndarray]:
    if not _POWERS:
        _POWERS.extend((_powers(_BASE), _powers(pow(_BASE, -1, 1 << 64))))
    return _POWERS


class Texts(NamedTuple):
    """buf: all bytes; off: where each text begins, and the end of the last."""

    buf: np.ndarray
    off: np.ndarray

    def __len__(self) -> int:
        return len(self.off) - 1


class Words(NamedTuple):
    """hash, start, end: of each word; off: where each text's words begin."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    off: np.ndarray

    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.off) - 1), np.diff(self.off))


def texts(column: pa.Array | pa.ChunkedArray) -> Texts:
    """The bytes of a string column; nulls count as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return Texts(np.zeros(0, np.uint8), np.zeros(1, np.int64))
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    off = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    data = column.buffers()[2]
    buf = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)
    return Texts(buf, off - off[0])


def blocks(t: Texts, limit: int = 2 << 20) -> Iterator[tuple[int, int, Texts]]:
    """Runs of whole texts of up to ``limit`` bytes; a longer text stands alone."""
    i = 0
    while i < len(t):
        j = max(i + 1, int(np.searchsorted(t.off, t.off[i] + limit, "right")) - 1)
        yield i, j, Texts(t.buf[t.off[i] : t.off[j]], t.off[i : j + 1] - t.off[i])
        i = j


def words(t: Texts, *, lower: bool = True, separators: np.ndarray = SPACES) -> Words:
    """Maximal runs of other bytes than separators; no word spans two texts."""
    n = len(t.buf)
    inside = ~separators[t.buf]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = t.off[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last[cuts - 1] = inside[cuts - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return Words(_hash_spans(t.buf, start, end, _TABLE_LOWER if lower else _TABLE, lower), start, end, np.searchsorted(start, t.off))


def _hash_spans(buf: np.ndarray, start: np.ndarray, end: np.ndarray, table: np.ndarray, lower: bool) -> np.ndarray:
    power, inverse = _power_tables()
    out = np.empty(len(start), np.uint64)
    i = 0
    while i < len(start):
        at = start[i]
        j = int(np.searchsorted(end, at + PIECE, "right"))
        if j <= i:  # one word longer than a piece
            word = LOWER[buf[at : end[i]]] if lower else buf[at : end[i]]
            out[i] = xxhash.xxh3_64_intdigest(word.tobytes())
            i += 1
            continue
        part = table[buf[at : end[j - 1]]]
        part *= power[: len(part)]
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(part, out=sums[1:])
        s, e = start[i:j] - at, end[i:j] - at
        out[i:j] = (sums[e] - sums[s]) * inverse[s]
        i = j
    return mix(out)


def runs(off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For windows of n items that don't span texts: their first items and their texts' offsets."""
    size = np.diff(off)
    count = np.maximum(size - n + 1, 0)
    new = np.concatenate(([0], np.cumsum(count)))
    first = np.arange(new[-1]) + np.repeat(off[:-1] - new[:-1], count)
    return first, new


def windows(h: np.ndarray, off: np.ndarray, n: int, salt: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows, and where each text's windows begin."""
    first, new = runs(off, n)
    out = np.full(len(first), np.uint64((n * 0x1000193 + salt) & (2**64 - 1)))
    for k in range(n):
        out *= np.uint64(0xD6E8FEB86659FD93)
        out += h[first + k]
    return mix(out), new


def pairs_apart(h: np.ndarray, off: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of word pairs with ``gap`` words between them (skip-grams), and their texts' offsets."""
    first, new = runs(off, gap + 2)
    return mix(h[first] * np.uint64(0xC2B2AE3D27D4EB4F) + h[first + gap + 1] + np.uint64(gap)), new


def byte_grams(t: Texts, n: int, *, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """32-bit hashes of all n-byte windows, and their texts' offsets."""
    table = ((_TABLE_LOWER if lower else _TABLE) >> np.uint64(32)).astype(np.uint32)
    codes = table[t.buf]
    if len(codes) < n:
        return np.zeros(0, np.uint32), np.zeros(len(t) + 1, np.int64)
    out = np.full(len(codes) - n + 1, n, np.uint32)
    for k in range(n):
        out *= np.uint32(0x01000193)
        out += codes[k : len(codes) - n + 1 + k]
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    out ^= out >> np.uint32(13)
    if len(t) == 1:
        return out, np.array([0, len(out)])
    first, new = runs(t.off, n)
    return out[first], new


def sums(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """The sum of each text's values."""
    total = np.zeros((len(off) - 1,) + values.shape[1:], np.float64)
    full = np.flatnonzero(np.diff(off))
    if len(full):
        total[full] = np.add.reduceat(values, off[full], axis=0, dtype=np.float64)
    return total


def repeated(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Which items equal another item of the same text."""
    out = np.zeros(len(h), bool)
    for a, b in zip(off[:-1], off[1:], strict=True):
        if b - a > 1:
            part = h[a:b]
            order = np.argsort(part)
            same = part[order[1:]] == part[order[:-1]]
            out[a + order[1:][same]] = True
            out[a + order[:-1][same]] = True
    return out
