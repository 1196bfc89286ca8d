"""Words of whole texts as numpy arrays, many texts at a time, inside Arrow tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Texts are taken together up to this many bytes; a longer text is a group of its own.
GROUP_BYTES = 1 << 19

_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
U64 = np.uint64
_STEP = U64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit (the SplitMix64 finaliser)."""
    x = x + _STEP
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(256, dtype=U64))


def _powers(n: int) -> np.ndarray:
    p = np.full(n, U64(0xD6E8FEB86659FD93))
    p[0] = 1
    return np.multiply.accumulate(p)


class Words:
    """The words of consecutive texts: byte ranges, hashes, and where each text's words lie."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets  # bytes of all texts; text i is offsets[i]:offsets[i+1]
        n = len(data)
        word = ~_BLANK[data]
        edge = np.zeros(n + 1, bool)  # a text begins here
        edge[offsets] = True
        first, last = word.copy(), word.copy()
        first[1:] &= ~word[:-1] | edge[1:n]
        last[:-1] &= ~word[1:] | edge[1:n]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.bounds = np.searchsorted(self.starts, offsets)  # text i has words bounds[i]:bounds[i+1]
        self.word = word

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.bounds)

    def text_of(self) -> np.ndarray:
        """The text number of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.n_words)

    def hashes(self, lower: bool = False) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.starts):
            return np.zeros(0, U64)
        data = _LOWER[self.data] if lower else self.data
        lengths = self.ends - self.starts
        at = np.flatnonzero(self.word)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        value = _BYTE[data[at]] * _powers(int(lengths.max()))[place]
        return mix64(np.add.reduceat(value, np.cumsum(lengths) - lengths) + lengths.astype(U64))


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words."""
    n = len(words) - size + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for i in range(size):
        out = out * U64(0xC2B2AE3D27D4EB4F) + words[i : i + n]
        out ^= out >> U64(29)
    return mix64(out)


def grouped(column: pa.Array, group_bytes: int = GROUP_BYTES) -> Iterator[tuple[int, int, Words]]:
    """(first, end, words) of consecutive rows of a text column; null texts are empty."""
    if pa.types.is_large_string(column.type):
        size, big = np.int64, column
    else:
        size, big = np.int32, column.cast(pa.string())
    if big.null_count:
        big = big.fill_null("")
    n = len(big)
    if not n:
        return
    _, raw, data = big.buffers()
    offsets = np.frombuffer(raw, size)[big.offset : big.offset + n + 1].astype(np.int64)
    body = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + group_bytes, "right")) - 1)
        end = min(end, n)
        yield at, end, Words(body[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
        at = end
