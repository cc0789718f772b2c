"""Many needles looked for in many texts at once, with arrays over the texts' bytes.

Every needle of one length is looked up at every place of a text by its words of eight bytes, so the work grows with the
bytes of the texts, the different lengths and the hits, not with the number of needles. Bytes of UTF-8 hold a needle where the text does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

WORD = 8
#: Places of the texts that are looked at together; arrays of this length stay in the cache.
CHUNK = 1 << 18
_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)


def _offsets(length: int) -> list[int]:
    """Where the words of a needle begin; the last one ends with it."""
    return [0] if length <= WORD else [*range(0, length - WORD, WORD), length - WORD]


def _masked(words: np.ndarray, length: int) -> np.ndarray:
    return words if length >= WORD else words & np.uint64((1 << 8 * length) - 1)


def _different(numbers: np.ndarray) -> np.ndarray:
    numbers = np.sort(numbers)
    return numbers[np.r_[True, numbers[1:] != numbers[:-1]]] if len(numbers) else numbers


class _Filter:
    """Says of words whether they may be among those given; a few others pass."""

    def __init__(self, words: np.ndarray):
        bits = min(24, max(10, int(8 * len(words)).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[self._slot(words)] = True

    def _slot(self, words: np.ndarray) -> np.ndarray:
        return ((words * np.uint64(_MIX[0])) >> self.shift).astype(np.intp)

    def places(self, words: np.ndarray) -> np.ndarray:
        return np.flatnonzero(self.table[self._slot(words)])


class _Length:
    """The needles of one length in bytes: their numbers, their words and, in order, one key for each."""

    def __init__(self, length: int, numbers: list[int], needles: list[bytes]):
        self.length, self.at = length, _offsets(length)
        padded = np.frombuffer(b"".join(s.ljust(WORD, b"\0") for s in needles), np.uint8).reshape(len(needles), -1)
        words = np.stack([np.ascontiguousarray(padded[:, o : o + WORD]).view("<u8")[:, 0] for o in self.at], axis=1)
        for self.mix in map(np.uint64, _MIX):
            keys = self._key([words[:, k] for k in range(len(self.at))])
            if len(_different(keys)) == len(keys):
                break
        else:
            raise ValueError("needles have to be different")
        order = np.argsort(keys, kind="stable")
        self.numbers, self.words, self.keys = np.asarray(numbers, np.int64)[order], words[order], keys[order]
        self.filter = _Filter(self.keys)
        self.direct = None
        if length <= 2:
            self.direct = np.full(1 << 8 * length, -1, np.int32)
            self.direct[self.keys.astype(np.intp)] = np.arange(len(self.keys))

    def _key(self, words: list[np.ndarray]) -> np.ndarray:
        key = words[0]
        for w in words[1:]:
            key = ((key ^ (key >> np.uint64(29))) * self.mix) ^ w
        return key

    def hits(self, words: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of places, those where a needle is, and which one (its rank by key)."""
        if self.direct is not None:
            rank = self.direct[_masked(words[places], self.length).astype(np.intp)]
            return places[rank >= 0], rank[rank >= 0]
        found = [_masked(words[places + o], self.length) for o in self.at]
        key = self._key(found)
        some = self.filter.places(key)
        rank = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
        same = np.ones(len(some), bool)
        for k, f in enumerate(found):
            same &= f[some] == self.words[rank, k]
        return places[some[same]], rank[same]


class Needles:
    """Different needles, numbered as they come; the empty one is in every text."""

    def __init__(self, needles: list[bytes]):
        by: dict[int, list[int]] = {}
        for k, s in enumerate(needles):
            by.setdefault(len(s), []).append(k)
        self.n, self.empty = len(needles), by.pop(0, [])
        self.lengths = [_Length(n, ks, [needles[k] for k in ks]) for n, ks in sorted(by.items())]
        self.whole = [x for x in self.lengths if x.length >= WORD]
        self.first = _Filter(_different(np.concatenate([x.words[:, 0] for x in self.whole]))) if self.whole else None

    def find(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Rows of texts and the numbers of the needles they hold, each pair once, in order. A null holds none."""
        wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
        ends = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
        begin, size = int(ends[0]), int(ends[-1] - ends[0])
        ends = ends - begin
        data = np.zeros(size + WORD, np.uint8)
        if size:
            data[:size] = np.frombuffer(texts.buffers()[2], np.uint8)[begin : begin + size]
        longest = max((x.length for x in self.lengths), default=0)
        step = max(CHUNK, longest)
        held = [self._chunk(data, ends, lo, min(size, lo + step), longest) for lo in range(0, size, step)] if self.lengths else []
        there = np.flatnonzero(~np.asarray(texts.is_null())) if self.empty else []
        held += [there * self.n + k for k in self.empty]
        both = _different(np.concatenate(held)) if held else np.zeros(0, np.int64)  # a text of several chunks has a needle in more than one
        return both // max(self.n, 1), both % max(self.n, 1)

    def _chunk(self, data: np.ndarray, ends: np.ndarray, lo: int, hi: int, longest: int) -> np.ndarray:
        """Row times n plus number of what begins at lo to hi."""
        size = len(data) - WORD
        upto = min(size, hi + longest)
        words = np.ndarray((upto - lo,), "<u8", data, lo, (1,)).copy()
        first = int(np.searchsorted(ends, lo, "right")) - 1
        last = int(np.searchsorted(ends, hi, "left"))
        lens = np.minimum(ends[first + 1 : last + 1], hi) - np.maximum(ends[first:last], lo)
        row = np.repeat(np.arange(last - first), lens)
        rest = ends[first + 1 : last + 1] - lo
        out, near = [], self.first.places(words[: hi - lo]) if self.first else None
        for x in self.lengths:
            if x.length >= WORD:
                places = near
            elif x.direct is not None:
                places = np.flatnonzero((x.direct >= 0)[_masked(words[: hi - lo], x.length).astype(np.intp)])
            else:
                places = x.filter.places(_masked(words[: hi - lo], x.length))
            places = places[places + x.length <= rest[row[places]]]
            places, rank = x.hits(words, places)
            rows, n = row[places], len(x.keys)
            if (last - first) * n <= 8 * CHUNK:
                mark = np.zeros((last - first) * n, bool)
                mark[rows * n + rank] = True
                pair = np.flatnonzero(mark)
            else:
                pair = _different(rows * n + rank)
            out.append((first + pair // n) * self.n + x.numbers[pair % n])
        return np.concatenate(out)
