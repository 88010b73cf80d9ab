"""FM-index over integer tokens in numpy: suffix order, wavelet matrix, backward search, locate.

Token 0 ends a run. Every 0 counts as a symbol of its own, smaller than all others and
ordered by its place, so suffixes are compared inside a run only and all differ.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 16


def suffix_order(tokens: np.ndarray) -> np.ndarray:
    """Positions of ``tokens`` in the order of their suffixes; the last token must be 0.

    Prefix doubling that sorts again only what is still tied.
    """
    n = len(tokens)
    order = np.argsort(tokens, kind="stable")
    held = tokens[order]
    fresh = np.ones(n, bool)
    fresh[1:] = held[1:] != held[:-1]
    fresh[held == 0] = True
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    tied = np.zeros(n, bool)
    tied[:-1] = ~fresh[1:]
    tied |= ~fresh
    active, width = order[tied], 1
    while len(active):
        own, then = rank[active], rank[active + width]
        by = np.argsort(own * n + then, kind="stable")
        active, own, then = active[by], own[by], then[by]
        new_own = np.ones(len(active), bool)
        new_own[1:] = own[1:] != own[:-1]
        fresh = new_own.copy()
        fresh[1:] |= then[1:] != then[:-1]
        place = np.arange(len(active))
        group = np.maximum.accumulate(np.where(new_own, place, 0))
        rank[active] = own + np.maximum.accumulate(np.where(fresh, place, 0)) - group
        alone = fresh.copy()
        alone[:-1] &= fresh[1:]
        active, width = active[~alone], width * 2
    out = np.empty(n, np.int64)
    out[rank] = np.arange(n)
    return out


class Bits:
    """A bit vector with the number of ones before any place."""

    def __init__(self, bits: np.ndarray):
        self.n = len(bits)
        padded = np.zeros((self.n // 64 + 1) * 64, np.uint8)
        padded[: self.n] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        block, rest = at >> 6, (at & 63).astype(np.uint64)
        mask = (np.uint64(1) << rest) - np.uint64(1)
        return self.before[block] + np.bitwise_count(self.words[block] & mask)

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class FMIndex:
    """Search phrases in ``tokens`` (0 ends a run) and find where they stand."""

    def __init__(self, tokens: np.ndarray, symbols: int, sample: int = SAMPLE):
        self.n = len(tokens)
        order = suffix_order(tokens)
        last = tokens[order - 1]
        self.depth = max(1, int(symbols).bit_length())
        self.less = np.concatenate([[0], np.cumsum(np.bincount(tokens, minlength=symbols + 1))])
        self.levels, self.zeros, column = [], [], last
        for level in range(self.depth - 1, -1, -1):
            bit = (column >> level) & 1
            self.levels.append(Bits(bit))
            self.zeros.append(int(self.n - bit.sum()))
            column = np.concatenate([column[bit == 0], column[bit == 1]])
        # Sampled: every so many places, and each start of a run, so that no walk crosses one.
        self.sampled = Bits(marks := (order % sample == 0) | (last == 0))
        self.places = order[marks]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands among the first ``at`` last-column entries, by pairs."""
        begin, end = np.zeros_like(at), at
        for i, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            one = ((symbol >> (self.depth - 1 - i)) & 1).astype(bool)
            b, e = bits.ones(begin), bits.ones(end)
            begin, end = np.where(one, zeros + b, begin - b), np.where(one, zeros + e, end - e)
        return end - begin

    def back(self, rows: np.ndarray) -> np.ndarray:
        """The rows of the suffixes one token longer: reads the last column and ranks at once."""
        at, begin, symbol = rows, np.zeros_like(rows), np.zeros_like(rows)
        for bits, zeros in zip(self.levels, self.zeros):
            one = bits.get(at).astype(bool)
            a, b = bits.ones(at), bits.ones(begin)
            at, begin = np.where(one, zeros + a, at - a), np.where(one, zeros + b, begin - b)
            symbol = symbol * 2 + one
        return self.less[symbol] + at - begin

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row intervals of ``phrases`` (rows padded at the end), all searched together."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for step in range(phrases.shape[1] if len(phrases) else 0):
            live = np.flatnonzero((lengths > step) & (low < high))
            if not len(live):
                break
            symbol = phrases[live, lengths[live] - 1 - step]
            both = self.rank(np.concatenate([symbol, symbol]), np.concatenate([low[live], high[live]]))
            low[live] = self.less[symbol] + both[: len(live)]
            high[live] = self.less[symbol] + both[len(live) :]
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where in ``tokens`` the suffixes of ``rows`` start."""
        out, at, steps = np.empty(len(rows), np.int64), rows.copy(), np.zeros(len(rows), np.int64)
        open_ = np.arange(len(rows))
        while len(open_):
            hit = self.sampled.get(at[open_]).astype(bool)
            done = open_[hit]
            out[done] = self.places[self.sampled.ones(at[done])] + steps[done]
            open_ = open_[~hit]
            at[open_] = self.back(at[open_])
            steps[open_] += 1
        return out
