"""Words of many texts at once, with numpy over the bytes of an Arrow column.

A word is a run of bytes other than space and 0x09-0x0D, so whole UTF-8 characters stay together. A word's
64-bit hash is a polynomial over random byte values modulo 2**64, mixed at the end: equal words have equal
hashes, and among n different words a collision has odds of about n * n / 2**65.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SPAN = 1 << 22
_R = 0x9E3779B97F4A7C15 // 8 * 8 + 5
_RI = pow(_R, -1, 1 << 64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True


@functools.cache
def _table(lower: bool) -> np.ndarray:
    values = np.random.default_rng(20240517).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    return values


@functools.cache
def _powers(size: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for r in (_R, _RI):
        a = np.full(size, r, np.uint64)
        a[0] = 1
        out.append(np.cumprod(a, dtype=np.uint64))
    return out[0], out[1]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


@dataclass
class Words:
    """first: the first text's place in the batch; texts: how many; start, end: byte places; doc: which text."""

    first: int
    texts: int
    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    count: np.ndarray

    def hashes(self, lower: bool) -> np.ndarray:
        return hashes(self.data, self.start, self.end, lower)

    def base(self) -> np.ndarray:
        """Place of every text's first word."""
        return np.concatenate(([0], np.cumsum(self.count)))


def hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool) -> np.ndarray:
    """Hash of every word; works span by span, so scratch memory follows SPAN or the longest word."""
    out, table = np.empty(len(start), np.uint64), _table(lower)
    at = 0
    while at < len(start):
        to = max(at + 1, int(np.searchsorted(end, start[at] + SPAN, "right")))
        lo, hi = int(start[at]), int(end[to - 1])
        p, q = _powers(SPAN if hi - lo <= SPAN else hi - lo)
        total = np.cumsum(table[data[lo:hi]] * p[: hi - lo], dtype=np.uint64)
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (total[e - 1] - np.where(s > 0, total[s - 1], np.uint64(0))) * q[s]
        at = to
    return mix(out)


def strings(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null is empty."""
    column = pc.fill_null(column, "")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    _, offsets, data = column.buffers()
    if offsets is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def spans(offsets: np.ndarray, limit: int = SPAN) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about limit bytes together, one text at least."""
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, min(to, n)
        at = min(to, n)


def words(column: pa.Array, limit: int = SPAN, inside: np.ndarray | Callable = ~SPACE) -> Iterator[Words]:
    """Maximal runs of the bytes that inside marks, by value or by a function of the bytes; by default all but white space."""
    data, offsets = strings(column)
    for i, j in spans(offsets, limit):
        part = data[offsets[i] : offsets[j]]
        edges = offsets[i : j + 1] - offsets[i]
        inner = edges[:-1][edges[:-1] < len(part)]
        word = inside(part) if callable(inside) else inside[part]
        before = np.zeros(len(part), bool)
        before[1:] = word[:-1]
        before[inner] = False
        start = np.flatnonzero(word & ~before)
        after = np.zeros(len(part), bool)
        after[:-1] = word[1:]
        after[inner[inner > 0] - 1] = False
        end = np.flatnonzero(word & ~after) + 1
        doc = np.searchsorted(edges, start, "right") - 1
        yield Words(i, j - i, part, start, end, doc, np.bincount(doc, minlength=j - i))
