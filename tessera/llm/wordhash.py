"""Vectorised word and shingle hashing over Arrow text columns.

A chunk of documents is one byte buffer with offsets.  Words are maximal runs
of bytes other than U+0020 and U+0009..U+000D; their 64-bit hashes come from a
prefix sum of a polynomial, so a chunk costs a few passes over its bytes
whatever the number of documents or words in it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
SHINGLE_WORDS = 5

_SEP = np.zeros(256, dtype=bool)
_SEP[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_SAME = np.arange(256, dtype=np.uint8)
_LOWER = _SAME.copy()
_LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15
_MULT = np.array(
    [0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3],
    dtype=np.uint64,
)
_powers: tuple[np.ndarray, np.ndarray] | None = None


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers
    if _powers is None or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + 1)
        inverse = pow(_BASE, -1, 1 << 64)
        tables = []
        for base in (_BASE, inverse):
            row = np.full(size, base, dtype=np.uint64)
            row[0] = 1
            tables.append(np.cumprod(row, dtype=np.uint64))
        _powers = tables[0], tables[1]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective finaliser on uint64, so equal inputs and only they agree."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges holding at most ``size`` bytes, or a single longer row."""
    n, a = len(offsets) - 1, 0
    while a < n:
        b = int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1
        b = min(n, max(b, a + 1))
        yield a, b
        a = b


class Words:
    """Words of a chunk: start, end (byte positions), doc, and per-document bounds."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets
        inside = ~_SEP[data]
        edge = np.zeros(len(data) + 1, dtype=bool)
        edge[offsets] = True
        before = np.concatenate(([False], inside[:-1])) & ~edge[:-1]
        after = np.concatenate((inside[1:], [False])) & ~edge[1:]
        self.start = np.flatnonzero(inside & ~before)
        self.end = np.flatnonzero(inside & ~after) + 1
        self.bounds = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.bounds)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def hashes(self, lower: bool = True) -> np.ndarray:
        power, inverse = _power_tables(len(self.data) + 1)
        return span_hashes((_LOWER if lower else _SAME)[self.data], self.start, self.end, power, inverse)


def span_hashes(data, start, end, power=None, inverse=None) -> np.ndarray:
    """64-bit hashes of the byte spans [start, end)."""
    if power is None:
        power, inverse = _power_tables(len(data) + 1)
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    term = data.astype(np.uint64)
    term += np.uint64(1)
    term *= power[: len(data)]
    np.cumsum(term, out=total[1:])
    return mix((total[end] - total[start]) * inverse[start])


def shingles(words: Words, n: int = SHINGLE_WORDS, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending: (values, bounds).

    A document with fewer than ``n`` words has its whole word sequence as its
    one shingle, and a document without words has none.
    """
    h, total, count = words.hashes(lower), len(words), words.count
    first = words.bounds[:-1]
    per_doc = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    at = np.repeat(first, per_doc) + _ranks(per_doc)
    short = np.repeat((count < n) & (count > 0), per_doc)
    length = np.where(short, np.repeat(count, per_doc), n)
    acc = length.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D)
    for j in range(n):
        w = h[np.minimum(at + j, max(total - 1, 0))] if total else h[:0]
        acc += np.where(j < length, w * _MULT[j % 5] + np.uint64(j // 5), np.uint64(0))
    values = mix(acc)
    bounds = np.concatenate(([0], np.cumsum(per_doc)))
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        values[a:b].sort()
    keep = np.ones(len(values), dtype=bool)
    if len(values):
        keep[1:] = values[1:] != values[:-1]
        keep[bounds[:-1][per_doc > 0]] = True
    kept = np.concatenate(([0], np.cumsum(keep)))
    return values[keep], kept[bounds]


def _ranks(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of consecutive runs of the given lengths."""
    total = int(counts.sum())
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts)
