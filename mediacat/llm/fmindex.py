"""A compressed full-text index over word sequences: wavelet matrix, backward search.

Used inside tasks on one shard at a time. The sequences are indexed for patterns of bounded
length, so suffixes are sorted by a bounded prefix only.
"""

from __future__ import annotations

import numpy as np


class Bits:
    """A bit vector packed into 64-bit words, with counts of ones before each word."""

    def __init__(self, flags: np.ndarray):
        padded = np.zeros((len(flags) // 64 + 1) * 64, np.uint8)
        padded[: len(flags)] = flags
        self.words = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.zeros(len(self.words) + 1, np.int64)
        np.cumsum(np.bitwise_count(self.words), out=self.before[1:])

    def ones(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        word, bit = at >> 6, (at & 63).astype(np.uint64)
        below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
        return self.before[word] + np.bitwise_count(below)


class WaveletMatrix:
    """Ranks of symbols in a sequence, a bit vector per bit of the symbols."""

    def __init__(self, symbols: np.ndarray, count: int):
        self.depth = max(1, int(count - 1).bit_length())
        self.levels: list[tuple[Bits, int]] = []
        rest = symbols
        for level in range(self.depth):
            bit = (rest >> (self.depth - 1 - level)) & 1 == 1
            self.levels.append((Bits(bit), int(len(rest) - bit.sum())))
            rest = np.concatenate([rest[~bit], rest[bit]])
        # where each symbol's run begins on the last level
        self.base = self._down(np.arange(count), np.zeros(count, np.int64))

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for level, (bits, zeros) in enumerate(self.levels):
            one = (symbols >> (self.depth - 1 - level)) & 1 == 1
            ones = bits.ones(at)
            at = np.where(one, zeros + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._down(symbols, at) - self.base[symbols]


class FMIndex:
    """Sequences of word numbers (1 and up), each followed by the separator 0."""

    def __init__(self, text: np.ndarray, count: int, length: int):
        """``text``: all sequences with separators; patterns have up to ``length`` words."""
        n = len(text)
        rank, span = text.astype(np.int64), 1
        while span <= length:  # ranks of prefixes of doubling length, beyond length + 1
            ahead = np.zeros(n, np.int64)
            ahead[: n - span] = rank[span:] + 1
            rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)[1]
            span *= 2
        self.order = np.argsort(rank, kind="stable")
        self.before = np.zeros(count + 1, np.int64)
        np.cumsum(np.bincount(text, minlength=count), out=self.before[1:])
        self.tree = WaveletMatrix(text[self.order - 1], count)
        # blocks of suffixes that agree in their first ``length`` words
        head, at = np.ones(n, bool), self.order
        same = np.ones(n - 1, bool)
        for i in range(length):
            a, b = at[1:] + i, at[:-1] + i
            inside = (a < n) & (b < n)
            same &= inside & (text[np.minimum(a, n - 1)] == text[np.minimum(b, n - 1)])
        head[1:] = ~same
        self.heads = np.flatnonzero(head)
        self.block = np.cumsum(head) - 1
        self.length = length

    def step(self, low: np.ndarray, high: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges of the patterns with one more word in front."""
        return self.before[word] + self.tree.rank(word, low), self.before[word] + self.tree.rank(word, high)

    def windows(self, starts: np.ndarray, lengths: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(sequence, offset, block) of every window of ``length`` words of the sequences.

        The sequences stream through the index from their ends, all abreast. The range of the
        last words grows to a window's length; from then on it is cut back to the window by
        the block it lies in, so each word costs one step. A range that is empty would end the
        match; here every sequence is in the index, so each window has a block.
        """
        low = np.zeros(len(starts), np.int64)
        high = np.full(len(starts), len(text), np.int64)
        out = []
        for back in range(int(lengths.max(initial=0))):
            live = np.flatnonzero(lengths > back)
            at = starts[live] + lengths[live] - 1 - back
            a, b = self.step(low[live], high[live], text[at])
            if back >= self.length - 1:
                block = self.block[np.minimum(a, len(self.block) - 1)]
                found = b > a
                a = self.heads[block]
                ends = np.r_[self.heads[1:], len(self.block)]
                b = ends[block]
                out.append((live[found], (at - starts[live])[found], block[found]))
            low[live], high[live] = a, b
        if not out:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*out))

    def least(self, values: np.ndarray) -> np.ndarray:
        """The least value of each block, from one value per text position."""
        return np.minimum.reduceat(values[self.order], self.heads)
