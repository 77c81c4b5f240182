"""Words of Arrow text columns as numpy arrays: places, 64-bit hashes and hashes of word windows.

Words are runs of bytes other than space and tab to carriage return. Texts are worked on whole, in slices of whole documents, so
memory follows the slice (or the longest single text), not the partition. Hashes are polynomial, modulo 2**64, over random
values per byte, then mixed; they depend on nothing but the bytes, so every task and run agrees.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 2 << 20
_SEED = np.random.default_rng(20240607)
_BYTE = _SEED.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    """base**k and base**-k modulo 2**64 for k < n."""
    have = _tables.get(base)
    if have is None or len(have[0]) < n:
        size = max(n, 1 << 16)
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            steps = np.full(size, b, np.uint64)
            steps[0] = 1
            both.append(np.cumprod(steps, dtype=np.uint64))
        have = _tables[base] = (both[0], both[1])
    return have[0][:n], have[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of consecutive documents: byte places in ``data``, hashes, and the first word of each document (with an end)."""

    rows: slice
    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def place(self, doc: np.ndarray) -> np.ndarray:
        """Index of each word within its document."""
        return np.arange(len(doc)) - self.first[:-1][doc]


def text_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    if data is None or not len(texts):
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(offsets, np.int64)[texts.offset:texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]], offsets - offsets[0]


def text_slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[slice, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets) of runs of whole documents with up to ``limit`` bytes, or of one longer document."""
    data, offsets = text_buffers(texts)
    row, n = 0, len(offsets) - 1
    while row < n:
        upto = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        upto = min(upto, n)
        yield slice(row, upto), data[offsets[row]:offsets[upto]], offsets[row:upto + 1] - offsets[row]
        row = upto


def byte_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hashes of the byte runs from start to end."""
    up, down = powers(len(data), _BASES[0])
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_FOLDED if fold else _BYTE)[data] * up, out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def find_words(rows: slice, data: np.ndarray, offsets: np.ndarray, fold: bool = False) -> Words:
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(rows, data, offsets, none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64))
    space = _SPACE[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[offsets < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[offsets > 0] - 1] = True
    start = np.flatnonzero(before & ~space)
    end = np.flatnonzero(after & ~space) + 1
    return Words(rows, data, offsets, start, end, byte_hashes(data, start, end, fold), np.searchsorted(start, offsets))


def slices(texts: pa.Array, fold: bool = False, limit: int = SLICE_BYTES) -> Iterator[Words]:
    """Words of all texts; ``fold`` hashes A-Z as a-z."""
    for rows, data, offsets in text_slices(texts, limit):
        yield find_words(rows, data, offsets, fold)


class Spans:
    """Hashes of spans of words in constant time each."""

    def __init__(self, hashes: np.ndarray, which: int = 1):
        up, self.down = powers(len(hashes) + 1, _BASES[which])
        self.sums = np.zeros(len(hashes) + 1, np.uint64)
        np.cumsum(hashes * up[:-1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def ragged(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (count[0] of them), start[1], ..."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    jump = np.repeat(start - np.concatenate(([0], np.cumsum(count)[:-1])), count)
    return jump + np.arange(total)
