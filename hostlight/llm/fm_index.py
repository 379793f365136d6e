"""An FM-index over integer symbols: suffix order, wavelet matrix with ranks, backward search, sampled positions."""

from __future__ import annotations

import numpy as np

#: Every so many symbols, and after each separator, a suffix's position is kept.
SAMPLED = 8


class Bits:
    """A bit vector with ranks: one count for 64 bits."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate([bits, np.zeros(64 - n % 64, bool)]), bitorder="little").view(np.uint64)
        self.words = packed
        counts = np.bitwise_count(packed)
        self.before = np.concatenate([[0], np.cumsum(counts[:-1], dtype=np.int64)])

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64)) & np.uint64(1) == 1

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before place i."""
        below = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[i >> 6] + np.bitwise_count(self.words[i >> 6] & below)


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Places in the order of their suffixes. Symbol 0 separates: no comparison goes past it, ties are in the order of places.

    As many symbols as fit into 62 bits are compared at first; then the ranks of what follows, twice as far each time,
    for groups that are still open.
    """
    n, step = len(symbols), max(1, 62 // bits)
    key, alive, full = np.zeros(n, np.int64), np.ones(n, bool), np.ones(n, bool)
    for k in range(min(step, n)):  # the end separates
        ahead = np.zeros(n, np.int64)
        ahead[: n - k] = symbols[k:]
        alive &= ahead > 0  # past a separator there is nothing
        key = (key << bits) | np.where(alive, ahead, 0)
        full &= alive
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    new = np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]])
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    ended = ~full[order]  # these differ from all others or are in the order of places
    rank = np.empty(n, np.int64)
    rank[order] = np.where(ended, np.arange(n), group)
    single = new & np.concatenate([new[1:], [True]])
    slots = np.flatnonzero(~ended & ~single)
    while len(slots):
        at = order[slots]
        pair = (rank[at] << 32) | rank[at + step]
        by = np.argsort(pair, kind="stable")
        order[slots] = at = at[by]
        pair = pair[by]
        new = np.concatenate([[True], pair[1:] != pair[:-1]])
        first = np.maximum.accumulate(np.where(new, slots, 0))
        rank[at] = first
        single = new & np.concatenate([new[1:], [True]])
        slots, step = slots[~single], 2 * step
    return order


class FmIndex:
    """Searches phrases of symbols 1 and more in a text of them, in which 0 separates. The text ends with 0."""

    def __init__(self, symbols: np.ndarray, largest: int):
        n = len(symbols)
        self.bits = max(1, int(largest).bit_length())
        order = suffix_order(symbols, self.bits)
        last = symbols[order - 1]  # the symbol before each suffix; the text's first has its end
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=largest + 1))])
        kept = (order % SAMPLED == 0) | (last == 0)
        self.kept, self.places = Bits(kept), order[kept]
        self.levels: list[tuple[Bits, int]] = []
        for b in range(self.bits - 1, -1, -1):
            ones = (last >> b) & 1 == 1
            self.levels.append((Bits(ones), n - int(ones.sum())))
            last = np.concatenate([last[~ones], last[ones]])
        self.base = self._down(np.arange(largest + 1), np.zeros(largest + 1, np.int64))

    def _down(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        """A row's place on the lowest level of the matrix, on the way of its symbol."""
        for level, (ones, zeros) in enumerate(self.levels):
            r = ones.rank(row)
            row = np.where((symbol >> (self.bits - 1 - level)) & 1 == 1, zeros + r, row - r)
        return row

    def _step(self, symbol: np.ndarray, row: np.ndarray) -> np.ndarray:
        return self.first[symbol] + self._down(symbol, row) - self.base[symbol]

    def ranges(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last row (exclusive) of suffixes that begin with each phrase. Phrases end at the right, -1 is before them."""
        low, high = np.zeros(len(phrases), np.int64), np.zeros(len(phrases), np.int64)
        last = phrases[:, -1]
        low[:], high[:] = self.first[last], self.first[last + 1]
        for k in range(phrases.shape[1] - 2, -1, -1):
            open_ = np.flatnonzero((low < high) & (phrases[:, k] >= 0))
            if not len(open_):
                break
            c = phrases[open_, k]
            low[open_], high[open_] = self._step(c, low[open_]), self._step(c, high[open_])
        return low, high

    def locate(self, row: np.ndarray) -> np.ndarray:
        """Places of rows: steps back to a kept place."""
        place, steps = np.empty(len(row), np.int64), 0
        todo = np.arange(len(row))
        while len(todo):
            done = self.kept.get(row)
            place[todo[done]] = self.places[self.kept.rank(row[done])] + steps
            todo, row = todo[~done], row[~done]
            low, symbol = row, np.zeros(len(row), np.int64)
            for ones, zeros in self.levels:
                bit, r = ones.get(low), ones.rank(low)
                symbol = symbol << 1 | bit
                low = np.where(bit, zeros + r, low - r)
            row = self.first[symbol] + low - self.base[symbol]
            steps += 1
        return place
