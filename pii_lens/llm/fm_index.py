"""A compressed FM-index over words: a wavelet tree of the Burrows-Wheeler transform, searched backwards in batches."""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector in 64-bit words with the count of ones before each word."""

    def __init__(self, bits: np.ndarray):
        n = len(bits) // 64 + 1
        padded = np.zeros(n * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)[:-1]])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & low)


class WaveletTree:
    """Levels of a balanced wavelet tree, each level stored as one bit vector with its zeros first."""

    def __init__(self, values: np.ndarray):
        self.depth = max(1, int(values.max(initial=0)).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        for k in range(self.depth - 1, -1, -1):
            bit = (values >> k & 1).astype(np.uint8)
            self.levels.append((Bits(bit), int(len(bit) - bit.sum())))
            values = np.concatenate([values[bit == 0], values[bit == 1]])

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its position, less how often before 0."""
        low = np.zeros(len(at), np.int64)
        for k, (bits, zeros) in zip(range(self.depth - 1, -1, -1), self.levels):
            one = (symbols >> k & 1).astype(bool)
            a, b = bits.rank(low), bits.rank(at)
            low, at = np.where(one, zeros + a, low - a), np.where(one, zeros + b, at - b)
        return at - low


def suffix_order(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols at least, by prefix doubling."""
    rank, size = np.unique(text, return_inverse=True)[1].astype(np.int64), 1
    order = np.argsort(rank, kind="stable")
    while size < depth:
        after = np.full(len(text), -1, np.int64)
        after[:-size] = rank[size:]
        key = rank * (len(text) + 1) + after + 1
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
        rank = np.empty_like(new)
        rank[order] = new
        size *= 2
        if new[-1] == len(text) - 1:
            break
    return order


class FMIndex:
    """Of pieces of word numbers from 1 on; 0 ends a piece. Each piece counts as often as its weight says."""

    def __init__(self, pieces: list[np.ndarray], weights: list[int], depth: int):
        text = np.concatenate([x for p in pieces for x in (p, [0])]).astype(np.int64)
        weight = np.repeat(np.asarray(weights, np.int64), [len(p) + 1 for p in pieces])
        order = suffix_order(text, depth + 1)
        self.tree = WaveletTree(text[order - 1])
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text))])
        self.weight = np.concatenate([[0], np.cumsum(weight[order])])
        self.size, self.depth = len(text), depth

    def matching(self, text: np.ndarray, ends: np.ndarray, least: int = 2) -> np.ndarray:
        """Matching statistics: the length, ``depth`` at most, of the longest stretch before each end that stands ``least`` times in the index."""
        low, high = np.zeros(len(ends), np.int64), np.full(len(ends), self.size)
        length, live = np.zeros(len(ends), np.int64), np.arange(len(ends))
        for step in range(1, self.depth + 1):
            at = ends[live] - step
            inside = at >= 0
            live, at = live[inside], at[inside]
            symbol = text[at]
            a = self.first[symbol] + self.tree.rank(symbol, low[live])
            b = self.first[symbol] + self.tree.rank(symbol, high[live])
            ok = (self.weight[b] - self.weight[a] >= least) & (symbol > 0)
            live = live[ok]
            if not len(live):
                break
            low[live], high[live], length[live] = a[ok], b[ok], step
        return length
