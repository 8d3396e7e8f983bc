"""Words of whole texts, found and hashed a batch at a time.

The helpers read the contiguous buffer of an Arrow string column, so a batch costs a few
numpy passes over its bytes and no Python loop over documents. UTF-8 bytes above 0x7F
are never separators, so byte classes and code-point classes cut the same words.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into hashes at a time, within a worker's memory.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _separators(*ranges: tuple[int, int]) -> np.ndarray:
    word = np.ones(256, bool)
    for low, high in ranges:
        word[low : high + 1] = False
    return word


#: Which bytes belong to a word: all but ASCII white space; ASCII alphanumerics and all non-ASCII.
PLAIN = _separators((0x20, 0x20), (0x09, 0x0D))
ALNUM = _separators((0x00, 0x2F), (0x3A, 0x40), (0x5B, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit values."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


with np.errstate(over="ignore"):
    _BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256)
_LOWER[0x41:0x5B] += 0x20
_powers: dict[int, np.ndarray] = {}


def _power_table(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2 ** 64 for i < n, kept for the next call."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.ones(max(n, BLOCK + 1), np.uint64)
        have[1:] = np.uint64(base)
        have = np.multiply.accumulate(have)
        if n <= 4 * BLOCK:
            _powers[base] = have
    return have


@dataclass
class Words:
    """Words of some documents: byte spans in ``data``, hashes, and where each document's words begin."""

    data: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray  # document d has words first[d]:first[d + 1]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def docs(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts())


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a string column and len + 1 offsets; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    bytes_ = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return bytes_[at[0] : at[-1]], at - at[0]


def slices(offsets: np.ndarray, most: int = 4 * BLOCK) -> Iterator[tuple[int, int]]:
    """Runs of documents of about ``most`` bytes; a longer document is a run of its own."""
    low, n = 0, len(offsets) - 1
    while low < n:
        high = int(np.searchsorted(offsets, offsets[low] + most, "right")) - 1
        high = min(max(high, low + 1), n)
        yield low, high
        low = high


def spans(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Byte starts and ends of the maximal runs of word bytes; none crosses an offset."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = kind[data]
    begins = inside[:-1].copy()
    begins[1:] &= ~inside[:-2]
    cuts = np.unique(offsets[offsets < len(data)])
    begins[cuts] = inside[cuts]
    ends = inside[:-1] & ~inside[1:]
    last = cuts[cuts > 0] - 1
    ends[last] = inside[last]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool) -> np.ndarray:
    """A 64-bit hash of the bytes of each span (ascending, disjoint), by differences of a rolling sum."""
    values = _BYTE_VALUES[_LOWER] if lower else _BYTE_VALUES
    inverse = pow(_BASE, -1, 1 << 64)
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + BLOCK, "right")), i + 1)
        base, size = starts[i], int(ends[j - 1] - starts[i])
        total = np.zeros(size + 1, np.uint64)
        np.cumsum(values[data[base : base + size]] * _power_table(_BASE, size)[:size], out=total[1:])
        s, e = starts[i:j] - base, ends[i:j] - base
        back = _power_table(inverse, size + 1)
        out[i:j] = mix((total[e] - total[s]) * back[s] + (e - s).astype(np.uint64))
        i = j
    return out


def words_of(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray = PLAIN, lower: bool = False) -> Words:
    starts, ends = spans(data, offsets, kind)
    first = np.searchsorted(starts, offsets, "left")
    return Words(data, starts, ends, hash_spans(data, starts, ends, lower), first)


def batches_of_words(column: pa.Array, kind: np.ndarray = PLAIN, lower: bool = False) -> Iterator[tuple[int, int, Words]]:
    """(low, high, Words) over runs of the column's documents."""
    data, offsets = text_buffer(column)
    for low, high in slices(offsets):
        at = offsets[low : high + 1]
        yield low, high, words_of(data[at[0] : at[-1]], at - at[0], kind, lower)


def grams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words (over the whole array: the caller drops those across documents)."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    size = len(hashes) - n + 1
    total = np.zeros(size, np.uint64)
    factor = 1
    for k in range(n):
        factor = factor * _BASE & _MASK
        total += hashes[k : k + size] * np.uint64(factor)
    return mix(total + np.uint64(n))


def run_hashes(hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each run of words begins:ends, of any lengths and overlaps, by differences of a rolling sum."""
    total = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power_table(_BASE, len(hashes))[: len(hashes)], out=total[1:])
    back = _power_table(pow(_BASE, -1, 1 << 64), len(hashes) + 1)
    return mix((total[ends] - total[begins]) * back[begins] + (ends - begins).astype(np.uint64))


def shingle_sets(words: Words, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each document, concatenated, and their len + 1 bounds.

    A document of fewer words, but not none, has its whole sequence as its one shingle.
    """
    count, first = words.counts(), words.first
    all_grams = grams(words.hashes, n)
    sets, bounds = [], np.zeros(len(count) + 1, np.int64)
    for d, c in enumerate(count):
        if c >= n:
            one = np.unique(all_grams[first[d] : first[d] + c - n + 1])
        elif c:
            one = grams(words.hashes[first[d] : first[d] + c], int(c))
        else:
            one = np.zeros(0, np.uint64)
        sets.append(one)
        bounds[d + 1] = bounds[d] + len(one)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), bounds
