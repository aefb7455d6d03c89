"""A compressed full-text index over whole symbols: backward search in a wavelet tree, vectorised over many patterns.

The tree is shaped by the symbols' Shannon codes, so it takes about their entropy and at most a bit more for each, and a
common symbol is found in few steps. Suffixes are sorted by their first `depth` symbols, which is all
that backward search for patterns of up to `depth` symbols needs; neither suffix array nor text is kept.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


class Bits:
    """A packed bit vector with the number of ones before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros((bits.size // 64 + 1) * 64, np.uint8)
        padded[: bits.size] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.int32)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """The number of ones before each position."""
        word = at >> 6
        return self.before[word] + np.bitwise_count(self.words[word] & ((_ONE << (at & 63).astype(np.uint64)) - _ONE)).astype(np.int64)


class WaveletTree:
    """Occurrences of a symbol before a position, for arrays of both."""

    def __init__(self, seq: np.ndarray, sigma: int):
        many = np.bincount(seq, minlength=sigma)
        length = np.ones(sigma, np.int64)
        some = many > 0
        length[some] = np.maximum(1, np.ceil(np.log2(seq.size / many[some]) - 1e-9).astype(np.int64))
        code, order, at = np.zeros(sigma, np.int64), np.flatnonzero(some)[np.argsort(length[some], kind="stable")], 0
        value, last = 0, 0
        for size in np.unique(length[order]).tolist():  # canonical codes: in the order of length and symbol
            stop = int(np.searchsorted(length[order], size, side="right"))
            value <<= size - last
            code[order[at:stop]] = value + np.arange(stop - at)
            value, last, at = value + stop - at, size, stop
        self.code, self.length, self.there = code, length, some
        self.levels: list[tuple[Bits, np.ndarray, np.ndarray]] = []
        level = 0
        while seq.size:
            prefix = code[seq] >> (length[seq] - level)
            bits = (code[seq] >> (length[seq] - 1 - level)) & 1
            first = np.flatnonzero(np.concatenate([[True], prefix[1:] != prefix[:-1]]))
            packed = Bits(bits)
            start = np.zeros(1 << level, np.int32)
            start[prefix[first]] = first
            self.levels.append((packed, start, packed.rank(start.astype(np.int64)).astype(np.int32)))
            seq = np.concatenate([seq[bits == 0], seq[bits == 1]])
            level += 1
            seq = seq[length[seq] > level]

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        out, lane = np.empty(at.size, np.int64), np.arange(at.size)
        code, length, count = self.code[symbol], self.length[symbol], np.where(self.there[symbol], at, 0)
        for level, (packed, start, base) in enumerate(self.levels):
            node = code >> (length - level)
            ones = packed.rank(start[node] + count) - base[node]
            count = np.where((code >> (length - 1 - level)) & 1, ones, count - ones)
            done = length == level + 1
            if done.any():
                out[lane[done]] = count[done]
                more = ~done
                lane, code, length, count = lane[more], code[more], length[more], count[more]
                if not lane.size:
                    break
        return out


class FmIndex:
    """An index over segments of symbols from 1 to sigma - 1; each segment has an owner.

    Of every stretch of `width` symbols it knows the least owner among the segments that hold it.
    """

    def __init__(self, text: np.ndarray, sigma: int, owners: np.ndarray, width: int):
        """`text` has a 0 behind each segment, `owners` is as long as it."""
        n = text.size
        rank, h, at_width = text.astype(np.int64), 1, None
        while h <= width:
            if 2 * h > width:
                at_width = np.concatenate([rank, np.zeros(width - h, np.int64)])
                at_width = (at_width[:n] << 32) | at_width[width - h : width - h + n]
            key = rank << 32
            key[: n - h] |= rank[h:]
            order = np.argsort(key)
            new = np.concatenate([[0], np.cumsum(key[order][1:] != key[order][:-1])])
            rank = np.empty(n, np.int64)
            rank[order] = new
            h *= 2
        suffixes = np.argsort(rank, kind="stable")
        of = at_width[suffixes]
        edge = np.concatenate([[True], of[1:] != of[:-1]])
        self.width, self.edges, self.bounds = width, Bits(edge[1:]), np.append(np.flatnonzero(edge), n)
        self.least = np.minimum.reduceat(owners[suffixes], self.bounds[:-1])
        self.tree = WaveletTree(text[suffixes - 1], sigma)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=sigma))])
        self.size = n

    def step(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From the suffixes that begin with a pattern to those that begin with the symbol and the pattern."""
        found = self.tree.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.smaller[symbol], 2)
        return found[: symbol.size], found[symbol.size :]

    def least_owners(self, text: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        """For each start in segments text[begin : begin + size], all of them indexed, the least owner of the stretch of `width` symbols there.

        The segments are streamed from their ends; a match that grows beyond the width is cut back to it, which
        the edges between stretches give, so each symbol costs one step.
        """
        out = np.full(text.size, np.iinfo(np.int64).max)
        order = np.argsort(-size, kind="stable")
        begin, size = begin[order], size[order]
        low, high = np.zeros(size.size, np.int64), np.full(size.size, self.size)
        for back in range(1, int(size.max(initial=0)) + 1):
            many = int(np.searchsorted(-size, -back, side="right"))
            at = begin[:many] + size[:many] - back
            low, high = self.step(text[at], low[:many], high[:many])
            if back >= self.width:
                which = self.edges.rank(low)
                low, high = self.bounds[which], self.bounds[which + 1]
                out[at] = self.least[which]
        return out
