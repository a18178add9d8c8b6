"""A word-level FM-index of one bounded shard: suffix order, wavelet ranks, backward search, sampled locate."""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Order of all suffixes. Symbol 0 separates; each 0 ends the comparison and ties break by position.

    Prefix doubling from four packed symbols; only suffixes that still tie are sorted again.
    """
    n = len(symbols)
    padded = np.concatenate((symbols, np.zeros(4, symbols.dtype))).astype(np.uint64)
    stop = np.zeros(n + 4, bool)
    stop[:n] = symbols == 0
    stop[n:] = True
    key = np.zeros(n, np.uint64)
    ended = np.zeros(n, bool)
    for k in range(4):
        part = np.where(ended, 0, padded[k : n + k])
        key = (key << np.uint64(16)) | part
        ended |= stop[k : n + k]
    order = np.argsort(key, kind="stable")
    ranked = key[order]
    fresh = np.ones(n, bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    # a suffix whose key holds a separator is complete: equal ones keep the order of their positions
    fresh[1:] |= ended[order[1:]]
    head = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = head
    depth = 4
    tied = np.zeros(n, bool)
    tied[1:] |= ~fresh[1:]
    tied[:-1] |= ~fresh[1:]
    rows = np.flatnonzero(tied)
    while len(rows):
        at = order[rows]
        group, nxt = rank[at], rank[np.minimum(at + depth, n)]
        again = np.lexsort((nxt, group))
        at, group, nxt = at[again], group[again], nxt[again]
        order[rows] = at
        new = np.ones(len(rows), bool)
        new[1:] = (group[1:] != group[:-1]) | (nxt[1:] != nxt[:-1])
        rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
        still = np.zeros(len(rows), bool)
        still[1:] |= ~new[1:]
        still[:-1] |= ~new[1:]
        rows = rows[still]
        depth *= 2
    return order


class FMIndex:
    """Index of ``symbols`` (0 separates, 1..sigma are words; sigma under 65536)."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        n = len(symbols)
        order = suffix_order(symbols)
        before = symbols[order - 1]
        before[order == 0] = 0
        self.n, self.levels = n, max(1, int(sigma).bit_length())
        counts = np.bincount(symbols, minlength=sigma + 1)
        self.first = np.concatenate(([0], np.cumsum(counts)))
        self.ones: list[np.ndarray] = []
        self.zeros: list[int] = []
        self.bits: list[np.ndarray] = []
        rest = before
        for level in range(self.levels - 1, -1, -1):
            bit = ((rest >> level) & 1).astype(bool)
            rank = np.zeros(n + 1, np.int32)
            np.cumsum(bit, out=rank[1:])
            self.bits.append(bit)
            self.ones.append(rank)
            self.zeros.append(n - int(rank[n]))
            rest = np.concatenate((rest[~bit], rest[bit]))
        start = self._down(np.arange(sigma + 1), np.zeros(sigma + 1, np.int64))
        self.base = self.first[: sigma + 1] - start
        # sampled suffix positions: every 16th, and each that follows a separator, so no walk crosses one
        kept = (order % SAMPLE == 0) | (before == 0)
        self.kept, self.kept_rank = kept, np.cumsum(kept) - 1
        self.samples = order[kept].astype(np.int64)

    def _down(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            bit = (symbol >> (self.levels - 1 - k)) & 1
            ones = self.ones[k][at]
            at = np.where(bit == 1, self.zeros[k] + ones, at - ones)
        return at

    def step(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """first[symbol] + number of ``symbol`` before row ``at`` of the BWT."""
        return self.base[symbol] + self._down(symbol, at)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row ranges of phrases, each right-aligned in a row of ``phrases``; empty where it does not occur."""
        lo = np.zeros(len(phrases), np.int64)
        hi = np.full(len(phrases), self.n, np.int64)
        width = phrases.shape[1]
        live = np.arange(len(phrases))
        for k in range(width):
            live = live[(lo[live] < hi[live])]
            go = live[lengths[live] > k]
            if not len(go):
                break
            symbol = phrases[go, width - 1 - k]
            lo[go] = self.step(symbol, lo[go])
            hi[go] = self.step(symbol, hi[go])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions in the shard of the suffixes in these rows."""
        rows = rows.astype(np.int64).copy()
        walked = np.zeros(len(rows), np.int64)
        open_ = np.flatnonzero(~self.kept[rows])
        while len(open_):
            at = rows[open_]
            symbol = np.zeros(len(at), np.int64)
            for k in range(self.levels):
                bit = self.bits[k][at]
                ones = self.ones[k][at]
                at = np.where(bit, self.zeros[k] + ones, at - ones)
                symbol = (symbol << 1) | bit
            rows[open_] = self.base[symbol] + at
            walked[open_] += 1
            open_ = open_[~self.kept[rows[open_]]]
        return self.samples[self.kept_rank[rows]] + walked
