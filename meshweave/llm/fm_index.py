"""A compressed FM-index over sequences of word numbers, in numpy.

The Burrows-Wheeler transform is held as a wavelet matrix: one bit vector for each
bit of the alphabet, packed in 64-bit words with counts before each. Searches run
for many sequences at once, one backward step of all of them at a time.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes, ordered by at least their first ``depth`` numbers."""
    n = len(text)
    rank = text.astype(np.int64)
    order, width = np.argsort(rank, kind="stable"), 1
    while width < depth:
        pair = rank * (int(rank.max()) + 2)
        pair[: n - width] += rank[width:] + 1
        order = np.argsort(pair, kind="stable")
        sorted_ = pair[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(sorted_[1:] != sorted_[:-1])])
        if rank[order[-1]] == n - 1:
            break
        width *= 2
    return order


class BitVector:
    """Bits packed in words, and how many are set before each word."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(-(-(len(bits) + 1) // 64) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.uint32))]).astype(np.uint32)

    def rank(self, i: np.ndarray) -> np.ndarray:
        """How many of the first ``i`` bits are set."""
        word = i >> 6
        low = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word].astype(np.int64) + np.bitwise_count(self.words[word] & low)


class WaveletMatrix:
    """Ranks of any number within a sequence."""

    def __init__(self, values: np.ndarray, size: int):
        self.depth = max(1, int(size - 1).bit_length())
        self.levels, self.zeros = [], []
        for level in range(self.depth - 1, -1, -1):
            bits = (values >> level & 1).astype(np.uint8)
            self.levels.append(BitVector(bits))
            self.zeros.append(len(bits) - int(bits.sum()))
            values = np.concatenate([values[bits == 0], values[bits == 1]])

    def place(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where position ``i`` falls after all levels, following the bits of ``c``."""
        for k, (bits, zeros) in enumerate(zip(self.levels, self.zeros)):
            ones = bits.rank(i)
            i = np.where(c >> (self.depth - 1 - k) & 1, zeros + ones, i - ones)
        return i


class FmIndex:
    """An index of sequences, each with an owner; tells the least owner of a match."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, depth: int):
        """``flat``: numbers from 1 on, all sequences in a row; 0 separates them in the index."""
        n = len(flat) + len(sizes)
        ends = np.cumsum(sizes + 1)
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends - 1] = False
        text[inside] = flat
        order = suffix_array(text, depth)
        alphabet = int(text.max()) + 1
        self.matrix = WaveletMatrix(text[order - 1], alphabet)
        counts = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=alphabet))])[:-1]
        first = self.matrix.place(np.arange(alphabet), np.zeros(alphabet, np.int64))
        self.shift = counts - first
        self.n = n
        least = np.repeat(owner, sizes + 1)[order].astype(np.int32)
        self.table = [least]  # least owner of 2 ** k suffixes in order
        while 1 << len(self.table) <= n:
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def step(self, c: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffixes that start with ``c`` and go on as those in [low, high)."""
        both = self.matrix.place(np.concatenate([c, c]), np.concatenate([low, high]))
        shift = self.shift[c]
        return both[: len(c)] + shift, both[len(c) :] + shift

    def least_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least owner among the suffixes of non-empty ranges."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(low), np.int32)
        for level in np.unique(k):
            at = np.nonzero(k == level)[0]
            table = self.table[level]
            out[at] = np.minimum(table[low[at]], table[high[at] - (1 << int(level))])
        return out

    def repeats(self, flat: np.ndarray, sizes: np.ndarray, owner: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Maximal runs of at least ``least`` numbers of each given sequence that an indexed one of a lesser owner holds.

        ``flat``: the given sequences in a row; 0 stands for what the index does not know.
        Matching statistics by backward search: from an end to the left as far as a lesser
        owner still matches; a next run must reach further left, which bounds its end.
        Gives sequence, start and end of each run.
        """
        m = len(sizes)
        base = np.cumsum(sizes) - sizes
        end = sizes.astype(np.int64)  # the end searched from, exclusive
        at = end.copy()  # what is matched: [at, end)
        low, high = np.zeros(m, np.int64), np.full(m, self.n, np.int64)
        live = np.nonzero(end >= least)[0]
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        while len(live):
            c = flat[base[live] + np.maximum(at[live] - 1, 0)]
            new_low, new_high = self.step(c, low[live], high[live])
            good = (at[live] > 0) & (c > 0) & (new_high > new_low)
            some = np.nonzero(good)[0]
            good[some] = self.least_owner(new_low[some], new_high[some]) < owner[live[some]]
            on = live[good]
            low[on], high[on] = new_low[good], new_high[good]
            at[on] -= 1
            stop = live[~good]
            if len(stop):
                long = stop[end[stop] - at[stop] >= least]
                if len(long):
                    found.append((long, at[long].copy(), end[long].copy()))
                # a run of `least` that starts left of `at` ends before at - 1 + least
                end[stop] = np.minimum(at[stop] - 1 + least, end[stop] - 1)
                dead = (at[stop] <= 0) | (end[stop] < least)
                at[stop] = end[stop]
                low[stop], high[stop] = 0, self.n
                end[stop[dead]] = -1
                live = live[end[live] >= least]
        if not found:
            none = np.zeros(0, np.int64)
            return none, none, none
        return tuple(np.concatenate(x) for x in zip(*found))
