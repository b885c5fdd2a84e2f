"""A numpy FM-index over many short sequences, searched and located in batches.

The sequences are runs of symbols 1..sigma-1, each closed by a separator. Separators
are pairwise different in the suffix order (by place) but are all symbol 0 in the
transform, so sorting never looks past the end of a run. Ranks come from a wavelet matrix (bit planes with block
counts); locating walks back to sampled places, which include each run's start.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector with constant-time rank."""

    def __init__(self, flags: np.ndarray):
        n = len(flags)
        padded = np.zeros((n // 64 + 1) * 64, bool)
        padded[:n] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        low = (np.uint64(1) << bit) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)

    def __getitem__(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) != 0


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, sigma: int):
        self.n, self.levels = len(symbols), max(1, int(sigma - 1).bit_length())
        self.planes: list[Bits] = []
        self.zeros: list[int] = []
        s = symbols
        for level in range(self.levels - 1, -1, -1):
            one = (s >> level) & 1 != 0
            self.planes.append(Bits(one))
            self.zeros.append(int(len(s) - one.sum()))
            s = np.concatenate([s[~one], s[one]])
        # where the symbols equal to c begin after the last level
        self.begin = np.searchsorted(self._paths(s), self._paths(np.arange(1 << self.levels)))

    def _paths(self, c: np.ndarray) -> np.ndarray:
        """Order in which symbols stand after the last level: bits reversed."""
        out = np.zeros(len(c), np.int64)
        for level in range(self.levels):
            out = (out << 1) | ((c >> level) & 1)
        return out

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of c before place i, elementwise."""
        for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
            ones = plane.rank(i)
            i = np.where((c >> (self.levels - 1 - k)) & 1 != 0, zeros + ones, i - ones)
        return i - self._start(c)

    def _start(self, c: np.ndarray) -> np.ndarray:
        if not hasattr(self, "_starts"):
            every = np.arange(1 << self.levels)
            i = np.zeros(len(every), np.int64)
            for k, (plane, zeros) in enumerate(zip(self.planes, self.zeros, strict=True)):
                ones = plane.rank(i)
                i = np.where((every >> (self.levels - 1 - k)) & 1 != 0, zeros + ones, i - ones)
            self._starts = i
        return self._starts[c]

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at place i and its occurrences before i."""
        c = np.zeros(len(i), np.int64)
        for plane, zeros in zip(self.planes, self.zeros, strict=True):
            one, ones = plane[i], plane.rank(i)
            c = (c << 1) | one
            i = np.where(one, zeros + ones, i - ones)
        return c, i - self._start(c)


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Order of all suffixes by prefix doubling; equal separators (0) differ by place."""
    n = len(seq)
    separators = seq == 0
    n_sep = int(separators.sum())
    first = np.where(separators, np.cumsum(separators) - 1, n_sep + seq.astype(np.int64))
    _, rank = np.unique(first, return_inverse=True)
    rank, k = rank.astype(np.int64), 1
    while int(rank.max(initial=-1)) + 1 < n:
        second = np.zeros(n, np.int64)
        second[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        fresh = np.ones(n, bool)
        fresh[1:] = key[order][1:] != key[order][:-1]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(fresh) - 1
        k *= 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class FMIndex:
    def __init__(self, seq: np.ndarray, sigma: int, sample: int = 8):
        """seq: symbols, 0 after each run (so the last is 0); runs may be empty."""
        self.n, self.sigma = len(seq), sigma
        sa = suffix_array(seq)
        bwt = seq[sa - 1]  # the run before the first is closed by the last separator
        self.wavelet = WaveletMatrix(bwt.astype(np.int64), sigma)
        counts = np.bincount(seq, minlength=sigma + 1)
        self.less = np.concatenate([[0], np.cumsum(counts)])[: sigma + 1]
        marked = (bwt == 0) | (sa % sample == 0)
        self.marks, self.places = Bits(marked), sa[marked]

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: one per row, right-aligned, -1 before the first symbol -> suffix intervals [lo, hi)."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        for t in range(patterns.shape[1] - 1, -1, -1):
            c = patterns[:, t]
            go = np.flatnonzero((c >= 0) & (lo < hi))
            if not len(go):
                continue
            s = c[go].astype(np.int64)
            lo[go] = self.less[s] + self.wavelet.rank(s, lo[go])
            hi[go] = self.less[s] + self.wavelet.rank(s, hi[go])
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Places in seq of suffix rows."""
        out = np.empty(len(rows), np.int64)
        at, row, steps = np.arange(len(rows)), rows, 0
        while len(at):
            done = self.marks[row]
            out[at[done]] = self.places[self.marks.rank(row[done])] + steps
            at, row = at[~done], row[~done]
            if len(at):
                c, before = self.wavelet.access(row)
                row = self.less[c] + before
            steps += 1
        return out
