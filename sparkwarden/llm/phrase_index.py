"""An FM-index over a run of word ids: which phrases occur, and where.

Text positions hold small integers; 0 ends every document run and matches nothing.
The Burrows-Wheeler transform is kept in a wavelet matrix (one bit vector per binary
digit), backward search narrows all phrases at once, and positions come from suffixes
sampled at every ``SAMPLE``-th place.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


def suffix_order(text: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ``text`` ends with its only smallest symbol."""
    n = len(text)
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    width = 1
    while True:
        later = np.full(n, -1, dtype=np.int64)
        later[: n - width] = rank[width:]
        key = rank * (n + 1) + later + 1
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        new = np.empty(n, dtype=np.int64)
        new[order] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        rank, width = new, 2 * width
        if rank[order[-1]] == n - 1 or width >= n:
            return order


class WaveletMatrix:
    """rank(symbol, i): occurrences of a symbol before i; access(i): the symbol at i."""

    def __init__(self, values: np.ndarray, symbols: int):
        self.levels = max(1, int(symbols - 1).bit_length())
        self.ones: list[np.ndarray] = []  # ones before each position
        self.zeros: list[int] = []
        current = values
        for level in reversed(range(self.levels)):
            bit = (current >> level) & 1
            self.ones.append(np.concatenate([[0], np.cumsum(bit)]).astype(np.int32))
            self.zeros.append(len(bit) - int(bit.sum()))
            current = np.concatenate([current[bit == 0], current[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        begin, end = np.zeros_like(at), at
        for level, ones, zeros in zip(reversed(range(self.levels)), self.ones, self.zeros):
            one = (symbol >> level) & 1
            b, e = ones[begin], ones[end]
            begin = np.where(one == 1, zeros + b, begin - b)
            end = np.where(one == 1, zeros + e, end - e)
        return end - begin

    def access_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(symbol at i, occurrences of that symbol before i)."""
        symbol = np.zeros_like(at)
        begin, here = np.zeros_like(at), at
        for ones, zeros in zip(self.ones, self.zeros):
            b, h = ones[begin], ones[here]
            one = ones[here + 1] - h
            begin = np.where(one == 1, zeros + b, begin - b)
            here = np.where(one == 1, zeros + h, here - h)
            symbol = 2 * symbol + one
        return symbol, here - begin


class PhraseIndex:
    """Index over ``text``, positive symbols below ``symbols`` and 0 as separator."""

    def __init__(self, text: np.ndarray, symbols: int):
        # Symbols move up by one so that a single 0 ends the whole text.
        text = np.concatenate([text.astype(np.int64) + 1, [0]])
        order = suffix_order(text)
        last = text[order - 1]
        self.wavelet = WaveletMatrix(last, symbols + 1)
        counts = np.bincount(text, minlength=symbols + 2)
        self.before = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
        self.size = len(text)
        sampled = order % SAMPLE == 0
        self.sampled = sampled
        self.slot = np.cumsum(sampled) - 1
        self.sample = order[sampled]

    def ranges(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of phrases (rows padded at the end), by backward search."""
        low = np.zeros(len(phrases), dtype=np.int64)
        high = np.full(len(phrases), self.size, dtype=np.int64)
        live = np.arange(len(phrases))
        for step in range(phrases.shape[1]):
            live = live[(low[live] < high[live])]
            turn = live[lengths[live] > step]
            if not len(turn):
                break
            symbol = phrases[turn, lengths[turn] - 1 - step].astype(np.int64) + 1
            base = self.before[symbol]
            low[turn] = base + self.wavelet.rank(symbol, low[turn])
            high[turn] = base + self.wavelet.rank(symbol, high[turn])
        return low, high

    def locate(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(phrase number, text position) of every suffix in the ranges."""
        width = np.maximum(high - low, 0)
        phrase = np.repeat(np.arange(len(low)), width)
        start = np.repeat(np.cumsum(width) - width, width)
        row = np.arange(len(phrase)) - start + low[phrase]
        steps = np.zeros(len(row), dtype=np.int64)
        position = np.empty(len(row), dtype=np.int64)
        open_rows = np.arange(len(row))
        while len(open_rows):
            here = row[open_rows]
            found = self.sampled[here]
            done = open_rows[found]
            position[done] = self.sample[self.slot[row[done]]] + steps[done]
            open_rows = open_rows[~found]
            symbol, seen = self.wavelet.access_rank(row[open_rows])
            row[open_rows] = self.before[symbol] + seen
            steps[open_rows] += 1
        return phrase, position
