"""FM-index over sequences of small integers: wavelet matrix of the Burrows-Wheeler transform, in numpy.

Suffixes are sorted by their first `depth` symbols only, which is all that a backward search for patterns of up to
that length needs.
"""

from __future__ import annotations

import numpy as np

_COUNT = np.array([bin(x).count("1") for x in range(1 << 16)], np.uint8)


class Bits:
    """A bit vector in 16-bit words with counts before each word: rank in one look-up and one popcount."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 16) * 16, bool)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u2")
        self.before = np.concatenate(([0], np.cumsum(_COUNT[self.words], dtype=np.int64)))[:-1].astype(np.int32)
        self.ones = int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 4
        return self.before[word] + _COUNT[self.words[word] & ((1 << (at & 15)) - 1).astype(np.uint16)]


class Wavelet:
    """Wavelet matrix: rank of any symbol in a number of steps that is the logarithm of the alphabet."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels, self.zeros = [], []
        self.height = max(1, int(sigma - 1).bit_length())
        now = symbols
        for k in range(self.height - 1, -1, -1):
            bit = (now >> k & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(len(now) - self.levels[-1].ones)
            now = np.concatenate((now[~bit], now[bit]))
        starts = np.bincount(symbols, minlength=sigma)
        order = np.argsort(self._order(np.arange(sigma)), kind="stable")
        self.begin = np.empty(sigma, np.int64)
        self.begin[order] = np.concatenate(([0], np.cumsum(starts[order])[:-1]))

    def _order(self, symbol: np.ndarray) -> np.ndarray:
        """Where the last level puts a symbol: its bits, lowest first."""
        out = np.zeros_like(symbol)
        for k in range(self.height):
            out = out << 1 | (symbol >> k & 1)
        return out

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often the symbol stands before the place, for arrays of both."""
        for level, (bits, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (symbol >> (self.height - 1 - level) & 1).astype(bool)
            ones = bits.rank(at)
            at = np.where(one, zeros + ones, at - ones)
        return at - self.begin[symbol]


def suffixes(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, rank of every suffix by its first 2**k >= depth symbols); equal prefixes share a rank."""
    n = len(text)
    _, rank = np.unique(text, return_inverse=True)
    rank = rank.astype(np.int64)
    order, step = np.argsort(rank, kind="stable"), 1
    while step < depth and rank[order[-1]] < n - 1:
        second = np.zeros(n, np.int64)
        second[: n - step] = rank[step:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        fresh = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        step *= 2
    return order, rank


class FMIndex:
    """text: symbols, in which 0 separates sequences and never stands in a pattern."""

    def __init__(self, text: np.ndarray, window: int):
        self.window = window
        depth = 1 << (window - 1).bit_length()
        self.sa, _ = suffixes(text, depth)
        self.sigma = int(text.max()) + 1 if len(text) else 1
        self.wavelet = Wavelet(text[self.sa - 1], self.sigma)
        self.base = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=self.sigma))))
        # rows of the index whose suffixes share their first `window` symbols: first row and the one after the last
        n, same = len(text), np.zeros(len(text), bool)
        same[1:] = True
        a, b = self.sa[:-1].copy(), self.sa[1:].copy()
        live = np.arange(1, n)
        for _ in range(window):
            ok = (a < n) & (b < n)
            ok[ok] = text[a[ok]] == text[b[ok]]
            same[live[~ok]] = False
            live, a, b = live[ok], a[ok] + 1, b[ok] + 1
        heads = np.flatnonzero(~same)
        group = np.cumsum(~same) - 1
        self.lo, self.hi = heads[group], np.append(heads[1:], n)[group]

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the patterns with the symbol put before them."""
        base = self.base[symbol]
        return base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)

    def statistics(self, patterns: np.ndarray, starts: np.ndarray, lengths: np.ndarray):
        """Matching statistics capped at the window, for all patterns side by side, from their ends backwards.

        Yields (which patterns, place, length matched from that place, rows lo, hi of the match). A longer match is
        cut to the window by widening its interval to the rows that share it; a match that can't be extended starts
        again at the place itself.
        """
        n = len(self.sa)
        lo, hi = np.zeros(len(starts), np.int64), np.full(len(starts), n, np.int64)
        matched = np.zeros(len(starts), np.int64)
        which = np.argsort(-lengths, kind="stable")
        for back in range(1, int(lengths.max(initial=0)) + 1):
            which = which[: np.searchsorted(-lengths[which], -back, "right")]
            symbol = patterns[starts[which] + lengths[which] - back]
            known = symbol < self.sigma
            symbol = np.where(known, symbol, 0)
            a, b = self.step(symbol, lo[which], hi[which])
            lost = (a >= b) | ~known
            if lost.any():
                a0, b0 = self.base[symbol], self.base[symbol + 1]
                a, b = np.where(lost, a0, a), np.where(lost, b0, b)
                matched[which] = np.where(lost, 0, matched[which])
                none = ~known | (a >= b)
                a, b = np.where(none, 0, a), np.where(none, n, b)
                matched[which] -= none
            length = matched[which] + 1
            full = length >= self.window
            row = np.minimum(a, n - 1)
            a, b = np.where(full, self.lo[row], a), np.where(full, self.hi[row], b)
            matched[which] = np.minimum(length, self.window)
            lo[which], hi[which] = a, b
            yield which, lengths[which] - back, matched[which], a, b
