"""Vectorised hashing of words and word windows, for tasks that hold chunks of texts as Arrow data."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

CHUNK = 1 << 21  # bytes of text that a task hashes at once, or one text
P, Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xF1DE83E19937733D)  # odd, inverse to each other modulo 2**64
_SPACE = np.isin(np.arange(256), [9, 10, 11, 12, 13, 32])


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices starts[k], starts[k] + 1, ... for each k, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _byte_table(lower: bool) -> np.ndarray:
    byte = np.arange(256, dtype=np.uint64)
    if lower:
        byte[65:91] += np.uint64(32)
    return mixed((byte + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


_TABLES = {lower: _byte_table(lower) for lower in (False, True)}


@dataclass
class Words:
    """The white-space separated words of a chunk of texts: hash, text number, and byte range in data."""

    n_texts: int
    hash: np.ndarray
    text: np.ndarray
    start: np.ndarray
    end: np.ndarray
    data: np.ndarray

    def windows(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, first word) of all k consecutive words of one text."""
        n = len(self.hash) - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.text[:n] == self.text[k - 1 :])
        return self.sequence(at, k), at

    def sequence(self, at: np.ndarray, k: int) -> np.ndarray:
        """Hashes of the k words from each of at."""
        out = np.full(len(at), k, np.uint64)
        for q in range(k):
            out = out * P + self.hash[at + q]
        return mixed(out)


def words_of(column: pa.Array, lower: bool) -> Iterator[tuple[int, Words]]:
    """Chunks of a string column: (number of the first row, words). Null is as empty."""
    column = column.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + CHUNK, side="right")) - 1)
        yield first, _words(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first], lower)
        first = last


def _words(data: np.ndarray, bounds: np.ndarray, lower: bool) -> Words:
    full = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)  # where a text begins
    edge[bounds] = True
    before = np.concatenate([[False], full[:-1]]) if len(data) else full
    after = np.concatenate([full[1:], [False]]) if len(data) else full
    start = np.flatnonzero(full & (~before | edge[:-1]))
    end = np.flatnonzero(full & (~after | edge[1:])) + 1
    h = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_TABLES[lower][data] * powers(P, len(data)), dtype=np.uint64)])
    value = mixed((h[end] - h[start]) * powers(Q, len(data))[start] if len(data) else np.zeros(0, np.uint64))
    return Words(len(bounds) - 1, value, np.searchsorted(bounds, start, side="right") - 1, start, end, data)
