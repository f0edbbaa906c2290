"""A full-text index over one shard: suffix order, Burrows-Wheeler transform, wavelet ranks, sampled positions."""

from __future__ import annotations

import numpy as np

#: Bits of a symbol class; classes are 1 .. 2**BITS - 1, class 0 parts the texts.
BITS = 4
#: Every so many text positions one is kept with its rank; the others are reached by walking back.
SAMPLE = 16
#: Largest shard: three ranks must fit one 63-bit sort key.
MAX_SHARD = (1 << 21) - 4


def classes(codes: np.ndarray) -> np.ndarray:
    """Symbol classes of code points: the index is kept over classes, hits are compared exactly afterwards."""
    return ((codes.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)).astype(np.int64) % ((1 << BITS) - 1) + 1


def suffix_array(x: np.ndarray) -> np.ndarray:
    """Suffix array by sorting packed prefixes, then tripling the sorted depth of what is still tied."""
    n = len(x)
    k = 62 // BITS
    key = np.zeros(n, dtype=np.int64)
    padded = np.concatenate([x, np.zeros(k, dtype=np.int64)])
    for j in range(k):
        key <<= BITS
        key |= padded[j : j + n]
    sa = np.argsort(key)
    ordered = key[sa]
    starts = np.empty(n, dtype=bool)
    starts[0] = True
    np.not_equal(ordered[1:], ordered[:-1], out=starts[1:])
    rank = np.empty(n + 1, dtype=np.int64)
    rank[sa] = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
    rank[n] = -1
    tied = np.flatnonzero(~(starts & np.append(starts[1:], True)))
    depth = k
    while len(tied):
        own = sa[tied]
        key = rank[own] << 42
        key |= (rank[np.minimum(own + depth, n)] + 1) << 21
        key |= rank[np.minimum(own + 2 * depth, n)] + 1
        order = np.argsort(key)
        own, key = own[order], key[order]
        sa[tied] = own
        starts = np.empty(len(tied), dtype=bool)
        starts[0] = True
        np.not_equal(key[1:], key[:-1], out=starts[1:])
        rank[own] = tied[np.maximum.accumulate(np.where(starts, np.arange(len(tied)), 0))]
        tied = tied[~(starts & np.append(starts[1:], True))]
        depth *= 3
    return sa


class FMIndex:
    """FM-index of a text of symbol classes; the text must end with class 0."""

    def __init__(self, x: np.ndarray):
        if len(x) > MAX_SHARD:
            raise ValueError(f"a shard holds at most {MAX_SHARD} signs")
        sa = suffix_array(x)
        self.n = len(x)
        last = x[sa - 1]
        self.first = np.concatenate([[0], np.cumsum(np.bincount(x, minlength=1 << BITS))])
        # Wavelet matrix: per level the ones before each position, and the number of zeros.
        self.ones, self.zeros, self.begin = [], [], []
        level = last
        for bit in range(BITS - 1, -1, -1):
            b = (level >> bit) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(b)]).astype(np.int32))
            self.zeros.append(self.n - int(self.ones[-1][-1]))
            level = np.concatenate([level[b == 0], level[b == 1]])
        self.start = np.zeros(1 << BITS, dtype=np.int64)
        self.start = self._descend(np.arange(1 << BITS), np.zeros(1 << BITS, dtype=np.int64))
        kept = sa % SAMPLE == 0
        self.kept = kept
        self.kept_before = np.concatenate([[0], np.cumsum(kept)]).astype(np.int32)
        self.positions = sa[kept].astype(np.int32)

    def _descend(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        for level, bit in enumerate(range(BITS - 1, -1, -1)):
            ones = self.ones[level][i]
            i = np.where((c >> bit) & 1, self.zeros[level] + ones, i - ones)
        return i

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of class ``c`` among the first ``i`` signs of the transform."""
        return self._descend(c, i) - self.start[c]

    def _access(self, i: np.ndarray) -> np.ndarray:
        c = np.zeros(len(i), dtype=np.int64)
        for level in range(BITS):
            ones = self.ones[level][i]
            b = self.ones[level][i + 1] - ones
            c = (c << 1) | b
            i = np.where(b, self.zeros[level] + ones, i - ones)
        return c

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals ``[low, high)`` of phrases (one per row, equal length) by backward search."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.n, dtype=np.int64)
        live = np.arange(len(phrases))
        for j in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, j]
            low[live] = self.first[c] + self.rank(c, low[live])
            high[live] = self.first[c] + self.rank(c, high[live])
            live = live[low[live] < high[live]]
            if not len(live):
                break
        high = np.maximum(high, low)
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of rows, by walking back to a sampled position."""
        rows = rows.copy()
        steps = np.zeros(len(rows), dtype=np.int64)
        away = np.flatnonzero(~self.kept[rows])
        while len(away):
            c = self._access(rows[away])
            rows[away] = self.first[c] + self.rank(c, rows[away])
            steps[away] += 1
            away = away[~self.kept[rows[away]]]
        return self.positions[self.kept_before[rows]] + steps
