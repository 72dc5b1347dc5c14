"""A compressed FM-index over word symbols: a wavelet matrix on the Burrows-Wheeler transform, searched in numpy batches.

What stays after the index is built: the transform's bit vectors, two bit vectors that mark where suffixes begin to differ in
their first 12 and 13 words, symbol counts, and for each distinct window of 13 words the smallest document that holds it. The
suffix array and the text go. A window's class is known only by the interval that a backward search finds for it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np


def _pairs(a: np.ndarray, step: int) -> np.ndarray:
    """Combined keys of ranks a[i] and a[i + step]."""
    later = np.zeros(len(a), np.uint64)
    later[: len(a) - step] = a[step:]
    return (a.astype(np.uint64) << np.uint64(32)) | later


def _dense(keys: np.ndarray) -> np.ndarray:
    return np.unique(keys, return_inverse=True)[1].astype(np.uint32)


class BitVector:
    """Bits with one running count a 64-bit word: rank and select of ones."""

    def __init__(self, bits: np.ndarray) -> None:
        self.words = np.packbits(np.pad(bits, (0, -len(bits) % 64 + 64)), bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.uint32)
        self.counts = np.cumsum(ones, dtype=np.uint32) - ones

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before `at`."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.counts[word] + np.bitwise_count(self.words[word] & below).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """Where the one with k ones before it is."""
        word = np.searchsorted(self.counts, k.astype(np.uint32), side="right") - 1
        rest, left, at = self.words[word], k - self.counts[word], word.astype(np.int64) << 6
        for width in (32, 16, 8, 4, 2, 1):
            low = rest & np.uint64((1 << width) - 1)
            n = np.bitwise_count(low).astype(np.int64)
            over = n <= left
            rest = np.where(over, rest >> np.uint64(width), low)
            left, at = left - np.where(over, n, 0), at + np.where(over, width, 0)
        return at

    @property
    def nbytes(self) -> int:
        return self.words.nbytes + self.counts.nbytes


class WaveletMatrix:
    """rank over a sequence of small integers, a bit vector a level."""

    def __init__(self, values: np.ndarray, n_symbols: int) -> None:
        self.n_levels = max(1, int(n_symbols - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []  # with its number of zeros
        for level in reversed(range(self.n_levels)):
            bit = ((values >> level) & 1).astype(bool)
            self.levels.append((BitVector(bit), len(bit) - int(bit.sum())))
            values = np.concatenate([values[~bit], values[bit]])
        self.first = self.descend(np.arange(n_symbols), np.zeros(n_symbols, np.int64)).astype(np.uint32)

    def descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where position `at` lies after all levels, followed along symbol."""
        for (bits, zeros), level in zip(self.levels, reversed(range(self.n_levels)), strict=True):
            ones = bits.rank(at)
            at = np.where((symbol >> level) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often symbol occurs before `at`."""
        return self.descend(symbol, at) - self.first[symbol]

    @property
    def nbytes(self) -> int:
        return sum(bits.nbytes for bits, _ in self.levels) + self.first.nbytes


class FMIndex:
    """Sequences of word symbols (integers), each with a value, indexed for windows of 13 words.

    Suffixes are sorted by as many words as a window has. Widening an interval to its first 12 words, after which one backward
    step moves a window by a word, takes rank and select on the bits where 12 words begin to differ: these stand for the
    longest-common-prefix array. So matching statistics above the threshold cost one step a window.
    """

    DEPTH = 13
    NONE = np.iinfo(np.int64).max

    def __init__(self, sequences: np.ndarray, lengths: np.ndarray, value: np.ndarray) -> None:
        """sequences: symbols of all sequences, one after another. value: of each; a window's is the smallest of those that hold it."""
        self.alphabet, dense = np.unique(sequences, return_inverse=True)
        self.size = len(sequences) + len(lengths)
        starts = np.cumsum(lengths + 1) - (lengths + 1)
        text = np.zeros(self.size, np.uint32)  # 0 separates sequences
        inside = np.ones(self.size, bool)
        inside[starts + lengths] = False
        text[inside] = dense + 1
        r8 = _dense(_pairs(_dense(_pairs(_dense(_pairs(text, 1)), 2)), 4))
        key12, key13 = _pairs(r8, 4), _pairs(r8, 5)
        order = np.argsort(key13, kind="stable")
        self.near, self.same = (BitVector(np.append(self._new(key[order]), True)) for key in (key12, key13))
        owner = np.repeat(value, np.diff(np.append(starts, self.size)))
        self.value = np.minimum.reduceat(owner[order], np.flatnonzero(self._new(key13[order])))
        n_symbols = len(self.alphabet) + 1
        self.below = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols))])
        self.wavelet = WaveletMatrix(text[order - 1], n_symbols)

    @staticmethod
    def _new(keys: np.ndarray) -> np.ndarray:
        new = np.ones(len(keys), bool)
        new[1:] = keys[1:] != keys[:-1]
        return new

    @property
    def nbytes(self) -> int:
        """Of the index; the values of windows come on top."""
        return self.wavelet.nbytes + self.near.nbytes + self.same.nbytes + self.alphabet.nbytes + self.below.nbytes

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search: the intervals of symbol followed by what [lo, hi) stands for; empty for symbol 0, which no text holds."""
        base = self.below[symbol]
        lo, hi = base + self.wavelet.rank(symbol, lo), base + self.wavelet.rank(symbol, hi)
        return lo, np.where(symbol > 0, hi, lo)

    def find(self, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals of the windows that begin at `at`, by a whole backward search each."""
        last = symbols[at + self.DEPTH - 1]
        lo, hi = self.below[last], np.where(last > 0, self.below[last + 1], self.below[last])
        for k in reversed(range(self.DEPTH - 1)):
            lo, hi = self.step(symbols[at + k], lo, hi)
        return lo, hi

    def widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of the first 12 words of the window whose interval begins at lo."""
        k = self.near.rank(lo + 1) - 1
        return self.near.select(k), self.near.select(k + 1)

    def matches(self, sequences: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Streams sequences (any, each of 13 symbols at least) backwards through the index, all in step: for every window of 13 of theirs, in order, the smallest value of those that hold it; NONE where no indexed sequence does."""
        at = np.minimum(np.searchsorted(self.alphabet, sequences), len(self.alphabet) - 1)
        symbols = np.where(self.alphabet[at] == sequences, at + 1, 0)
        windows = lengths - self.DEPTH + 1
        order = np.argsort(-windows, kind="stable")
        n, start, first = windows[order], (np.cumsum(lengths) - lengths)[order], (np.cumsum(windows) - windows)[order]
        out = np.full(int(windows.sum()), self.NONE)
        lo = hi = np.zeros(len(n), np.int64)
        for j in range(int(n[0]) if len(n) else 0):
            m = int(np.searchsorted(-n, -j, side="left"))  # those with more than j windows
            at, lo, hi = start[:m] + n[:m] - 1 - j, lo[:m].copy(), hi[:m].copy()
            on = np.flatnonzero(hi > lo)
            anew = np.flatnonzero(hi <= lo)  # the first window, or after one that doesn't occur
            if len(on):
                lo[on], hi[on] = self.step(symbols[at[on]], *self.widened(lo[on]))
            if len(anew):
                lo[anew], hi[anew] = self.find(symbols, at[anew])
            hit = np.flatnonzero(hi > lo)
            out[(first[:m] + n[:m] - 1 - j)[hit]] = self.value[self.same.rank(lo[hit] + 1) - 1]
        return out


def streamed(index: FMIndex, symbols: np.ndarray, lengths: np.ndarray, chunk: int = 1 << 18) -> Iterator[np.ndarray]:
    """index.matches() of sequences, about `chunk` symbols at a time, so that memory follows the index."""
    ends, first = np.cumsum(lengths), 0
    while first < len(lengths):
        begin = ends[first] - lengths[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + chunk, side="right")))
        yield index.matches(symbols[begin : ends[last - 1]], lengths[first:last])
        first = last
