"""A full-text index of word numbers: suffix order, wavelet tree over the last column, sampled positions."""

from __future__ import annotations

import numpy as np


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffixes of `text` in order, by prefix doubling. Zeros end a text and differ from each other."""
    n = len(text)
    zeros = text == 0
    rank = np.where(zeros, np.cumsum(zeros) - 1, text.astype(np.int64) + zeros.sum())
    _, rank = np.unique(rank, return_inverse=True)
    width = 1
    while True:
        follow = np.zeros(n, np.int64)
        follow[: n - width] = rank[width:] + 1
        order = np.lexsort((follow, rank))
        new = np.ones(n, bool)
        new[1:] = (rank[order][1:] != rank[order][:-1]) | (follow[order][1:] != follow[order][:-1])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        if new.all() or width >= n:
            return order
        width *= 2


class WaveletTree:
    """Ranks in a sequence of small numbers; one level a bit, without pointers."""

    def __init__(self, values: np.ndarray, top: int):
        self.levels = []
        for level in range(max(1, int(top).bit_length()) - 1, -1, -1):
            bit = (values >> level) & 1
            ones = np.append(0, np.cumsum(bit)).astype(np.int64)
            zeros = len(values) - ones[-1]
            self.levels.append((level, ones, zeros))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each position."""
        low = np.zeros_like(at)
        for level, ones, zeros in self.levels:
            bit = (symbol >> level) & 1 == 1
            low = np.where(bit, zeros + ones[low], low - ones[low])
            at = np.where(bit, zeros + ones[at], at - ones[at])
        return at - low


class FMIndex:
    """Backward search over texts that end in zeros; `sample` is the distance of stored positions."""

    def __init__(self, text: np.ndarray, symbols: int, sample: int = 8):
        order = suffix_order(text)
        self.last = text[order - 1]
        self.tree = WaveletTree(self.last, symbols)
        self.before = np.append(0, np.cumsum(np.bincount(text, minlength=symbols + 1)))
        # a walk to the left never crosses the border of a text: its first word is stored
        starts = np.append(0, np.flatnonzero(text == 0)[:-1] + 1)
        begin = np.repeat(starts, np.diff(np.append(starts, len(text))))
        self.stored = ((np.arange(len(text)) - begin) % sample == 0)[order]
        self.position = np.where(self.stored, order, -1)
        self.size = len(text)

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows [low, high) of suffixes that start with each phrase (a row of equal-length phrases)."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.size, np.int64)
        alive = np.arange(len(phrases))
        for k in range(phrases.shape[1] - 1, -1, -1):
            symbol = phrases[alive, k]
            low[alive] = self.before[symbol] + self.tree.rank(symbol, low[alive])
            high[alive] = self.before[symbol] + self.tree.rank(symbol, high[alive])
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by steps to the left until a stored one."""
        out = np.empty(len(rows), np.int64)
        open_, at, steps = np.arange(len(rows)), rows.copy(), 0
        while len(open_):
            done = self.stored[at]
            out[open_[done]] = self.position[at[done]] + steps
            open_, at = open_[~done], at[~done]
            symbol = self.last[at]
            at = self.before[symbol] + self.tree.rank(symbol, at)
            steps += 1
        return out
