"""A compressed FM-index: a wavelet matrix of packed bits over the BWT."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with a running count for each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.zeros(len(counts) + 1, np.int64)
        np.cumsum(counts, out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class Wavelet:
    """Counts of a symbol before a position, one bit of the symbol at a time."""

    def __init__(self, symbols: np.ndarray, alphabet: int):
        self.levels = max(1, int(alphabet - 1).bit_length())
        self.bits, self.zeros = [], []
        here = symbols
        for level in range(self.levels):
            bit = (here >> (self.levels - 1 - level)) & 1
            self.bits.append(Bits(bit.astype(np.uint8)))
            self.zeros.append(int((bit == 0).sum()))
            here = np.concatenate([here[bit == 0], here[bit == 1]])
        every = np.arange(alphabet)
        self.origin = self._down(every, np.zeros(alphabet, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level in range(self.levels):
            ones = self.bits[level].rank(at)
            bit = (symbols >> (self.levels - 1 - level)) & 1
            at = np.where(bit == 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self._down(symbols, at) - self.origin[symbols]


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """All suffixes in order, by doubling the compared length. Ends of sequences
    are distinct symbols, so it stops at the longest sequence."""
    size = len(symbols)
    rank, step = symbols.astype(np.int64), 1
    while True:
        key = rank * (int(rank.max()) + 2)
        key[: size - step] += rank[step:] + 1
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        fresh = np.r_[False, sorted_[1:] != sorted_[:-1]].cumsum()
        rank = np.empty(size, np.int64)
        rank[order] = fresh
        if fresh[-1] == size - 1 or step >= size:
            return order
        step *= 2


class FMIndex:
    """Over sequences of symbols 0..alphabet-1, each with a weight."""

    def __init__(self, sequences: list[np.ndarray], weights: np.ndarray, alphabet: int):
        count = len(sequences)
        lengths = np.array([len(s) for s in sequences], np.int64)
        ends = np.cumsum(lengths + 1) - 1
        owner = np.repeat(np.arange(count), lengths + 1)
        text = np.empty(int(ends[-1]) + 1, np.int64)
        is_end = np.zeros(len(text), bool)
        is_end[ends] = True
        text[~is_end] = np.concatenate(sequences) + count
        text[ends] = np.arange(count)
        order = suffix_order(text)
        last = text[order - 1]
        # Ends are never searched for: one symbol stands for all of them.
        bwt = np.where(last < count, 0, last - count + 1)
        self.size = len(text)
        self.tree = Wavelet(bwt, alphabet + 1)
        self.smaller = np.zeros(alphabet + 2, np.int64)
        np.cumsum(np.bincount(bwt, minlength=alphabet + 1), out=self.smaller[1:])
        self.weight = np.zeros(self.size + 1, np.int64)
        np.cumsum(weights[owner[order]], out=self.weight[1:])

    def matches(self, symbols: np.ndarray, ends: np.ndarray, length: int, weight: int) -> np.ndarray:
        """The matching statistic of each place in ``symbols``: how many symbols
        that end there occur with ``weight`` or more, up to ``length``. Each
        search goes backwards and ends when its interval becomes too light."""
        matched = np.zeros(len(ends), np.int64)
        low = np.zeros(len(ends), np.int64)
        high = np.full(len(ends), self.size)
        live = np.arange(len(ends))
        for k in range(length):
            symbol = symbols[ends[live] - k] + 1
            both = self.tree.rank(np.r_[symbol, symbol], np.r_[low, high])
            base = self.smaller[symbol]
            low, high = base + both[: len(live)], base + both[len(live) :]
            heavy = self.weight[high] - self.weight[low] >= weight
            low, high, live = low[heavy], high[heavy], live[heavy]
            matched[live] = k + 1
            if not len(live):
                break
        return matched
