"""An FM-index over integer symbols, in numpy: suffix array, wavelet-matrix ranks and sampled suffix positions."""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling.

    Symbol 0 ends a run: each 0 counts as a different symbol, smaller than all others and ordered by place, so no
    comparison goes beyond the run in which it began.
    """
    n = len(text)
    ends = text == 0
    rank = text.astype(np.int64) + int(ends.sum())
    rank[ends] = np.arange(int(ends.sum()))
    order = np.argsort(rank, kind="stable")
    step = 1
    while True:
        sorted_rank = rank[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.concatenate(([0], sorted_rank[1:] != sorted_rank[:-1])))
        if n == 0 or new[order[-1]] == n - 1:
            return order
        second = np.zeros(n, np.int64)
        second[:-step] = new[step:] + 1
        rank = new * (n + 1) + second
        # only those that are still alike need sorting anew
        same = np.zeros(n, bool)
        ranks = new[order]
        same[1:] = ranks[1:] == ranks[:-1]
        same[:-1] |= same[1:].copy()
        places = np.flatnonzero(same)
        members = order[places]
        order[places] = members[np.argsort(rank[members], kind="stable")]
        step *= 2


class Bits:
    """A bit vector with rank in constant time: the ones before a place."""

    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.packbits(np.concatenate((bits.astype(np.uint8), np.zeros(-n % 64 + 64, np.uint8))), bitorder="little")
        self.words = packed.view("<u8")
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)))

    def rank(self, at: np.ndarray) -> np.ndarray:
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, at: np.ndarray) -> np.ndarray:
        return (self.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)


class Wavelet:
    """Ranks and symbols of a sequence, one bit vector for each bit of a symbol."""

    def __init__(self, symbols: np.ndarray, most: int):
        self.levels: list[tuple[int, Bits, int]] = []
        seq = symbols
        for shift in range(max(1, int(most).bit_length()) - 1, -1, -1):
            bits = (seq >> shift) & 1
            ones = bits.astype(bool)
            self.levels.append((shift, Bits(bits), len(seq) - int(ones.sum())))
            seq = np.concatenate((seq[~ones], seq[ones]))

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        first, at = np.zeros_like(at), at.copy()
        for shift, bits, zeros in self.levels:
            one = ((symbol >> shift) & 1).astype(bool)
            a, b = bits.rank(first), bits.rank(at)
            first, at = np.where(one, zeros + a, first - a), np.where(one, zeros + b, at - b)
        return at - first

    def symbol_and_rank(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbol at each place, and how often it stands before."""
        symbol, first, at = np.zeros_like(at), np.zeros_like(at), at.copy()
        for shift, bits, zeros in self.levels:
            one = bits.get(at).astype(bool)
            symbol |= one.astype(symbol.dtype) << shift
            a, b = bits.rank(first), bits.rank(at)
            first, at = np.where(one, zeros + a, first - a), np.where(one, zeros + b, at - b)
        return symbol, at - first


class FMIndex:
    """Counts and locates phrases in runs of symbols (1 and more) that 0 ends; no phrase holds 0."""

    def __init__(self, text: np.ndarray, most: int, sample: int = 8):
        order = suffix_array(text)
        before = text[order - 1]  # of the first suffix, the last symbol, which is 0
        self.wavelet = Wavelet(before.astype(np.int64), most)
        self.begin = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=most + 1))))
        kept = (order % sample == 0) | (before == 0)  # a walk never leaves its run
        self.marks, self.positions, self.n = Bits(kept), order[kept], len(text)

    def search(self, phrases: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The range of suffixes that begin with each phrase (rows padded on the right), all phrases at once."""
        low, high = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        for back in range(phrases.shape[1]):
            live = np.flatnonzero((back < lengths) & (low < high))
            c = phrases[live, lengths[live] - 1 - back]
            low[live], high[live] = self.begin[c] + self.wavelet.rank(c, low[live]), self.begin[c] + self.wavelet.rank(c, high[live])
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text positions of suffixes, by walking back to a sampled one."""
        out, at, steps, todo = np.empty(len(rows), np.int64), rows.astype(np.int64), 0, np.arange(len(rows))
        while len(todo):
            known = self.marks.get(at).astype(bool)
            out[todo[known]] = self.positions[self.marks.rank(at[known])] + steps
            todo, at = todo[~known], at[~known]
            symbol, rank = self.wavelet.symbol_and_rank(at)
            at, steps = self.begin[symbol] + rank, steps + 1
        return out
