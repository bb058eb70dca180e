"""A compressed FM-index over sequences of words: BWT in a wavelet matrix, backward search."""

from __future__ import annotations

import numpy as np


class Wavelet:
    """Rank over symbols: one bit vector per binary digit, packed, with counts per 64 bits."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.words, self.counts, self.zeros = [], [], []
        cur, n = symbols, len(symbols)
        for b in range(self.levels - 1, -1, -1):
            bit = ((cur >> b) & 1).astype(bool)
            packed = np.packbits(np.concatenate([bit, np.zeros(-n % 64 + 64, bool)]), bitorder="little")
            words = packed.view(np.uint64)
            self.words.append(words)
            counts = np.zeros(len(words), np.uint32)
            counts[1:] = np.cumsum(np.bitwise_count(words[:-1]), dtype=np.uint32)
            self.counts.append(counts)
            self.zeros.append(n - int(bit.sum()))
            cur = np.concatenate([cur[~bit], cur[bit]])
        self.begin = self._walk(np.arange(sigma), np.zeros(sigma, np.int64))

    def _walk(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            block = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][block].astype(np.int64) + np.bitwise_count(self.words[k][block] & mask)
            at = np.where((c >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, c: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each position."""
        return self._walk(c, at) - self.begin[c]


class FMIndex:
    """Over texts of symbols 1.., each closed by 0; suffixes are in order to a depth of 16.

    That is enough for patterns of up to 16 symbols, since backward search over a pattern only
    needs the order of as many symbols.
    """

    DEPTH = 16

    def __init__(self, text: np.ndarray, sigma: int):
        n = len(text)
        rank, width = text.astype(np.int64), 1
        while width < self.DEPTH:
            behind = np.concatenate([rank[width:], rank[:width]])
            _, rank = np.unique(rank * (int(rank.max()) + 1) + behind, return_inverse=True)
            width *= 2
        self.suffix = np.argsort(rank, kind="stable")
        self.bwt = Wavelet(text[self.suffix - 1].astype(np.int64), sigma)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))]).astype(np.int64)
        self.n = n

    def intervals(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(lo, hi, length) per row: the suffixes that begin with its longest ending that still
        occurs more than once, and how long that is (the matching statistic against the others).

        Each pattern occurs at least once itself; a row is done when its interval has one suffix.
        """
        m = patterns.shape[1]
        c = patterns[:, m - 1]
        lo, hi = self.first[c].copy(), self.first[c + 1].copy()
        length = np.where(hi - lo > 1, 1, 0)
        live = np.flatnonzero(hi - lo > 1)
        for t in range(m - 2, -1, -1):
            if not len(live):
                break
            c = patterns[live, t]
            lo[live] = self.first[c] + self.bwt.rank(c, lo[live])
            hi[live] = self.first[c] + self.bwt.rank(c, hi[live])
            live = live[hi[live] - lo[live] > 1]
            length[live] += 1
        return lo, hi, length
