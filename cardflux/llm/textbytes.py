"""Words, lines and rolling hashes of many texts at once, on their UTF-8 bytes with numpy.

Spark hands Arrow batches to tasks; the functions here see one bounded slice of a batch. A hash of a byte
range is taken from running sums of ``table[byte] * BASE**-i``, so it depends on the bytes alone and any
number of ranges costs two look-ups each. All hashes are 64 bits wide.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15
SLICE_BYTES = 1_000_000
SPACES = np.zeros(256, bool)
SPACES[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of unsigned 64-bit numbers (a bijection)."""
    x = np.asarray(x, np.uint64)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random numbers of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE) + np.uint64(seed))


BYTE_VALUES = stream(17, 256)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Powers of longer texts are not kept for the next task.
KEPT_POWERS = 1 << 21
_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``BASE**i`` and ``BASE**-i`` modulo 2**64, for i below ``n`` at least."""
    size = max((k for k in _powers), default=0)
    if size < n:
        size = 1 << max(16, int(n - 1).bit_length())
        inverse = pow(BASE, -1, 1 << 64)
        both = []
        for factor in (BASE, inverse):
            run = np.full(size, factor, np.uint64)
            run[0] = 1
            both.append(np.cumprod(run, dtype=np.uint64))
        _powers.clear()
        _powers[size] = (both[0], both[1])
    return _powers[size]


def give_back() -> None:
    """Hand freed memory back to the system, as workers live on for later tasks."""
    if max(_powers, default=0) > KEPT_POWERS:
        _powers.clear()
    pa.default_memory_pool().release_unused()
    if _trim is not None:
        _trim(0)


def text_slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of each batch in slices of about ``limit`` bytes: the rows, all bytes, and where each text starts.

    A NULL text counts as empty. A longer text is a slice of its own, whole.
    """
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))])
        row = 0
        while row < len(texts):
            end = int(np.searchsorted(sizes, sizes[row] + limit, "right")) - 1
            end = min(max(end, row + 1), len(texts))
            # Only a slice at a time is converted, so that a batch is not held twice.
            part = pc.fill_null(texts.slice(row, end - row).cast(pa.large_string()), "")
            bounds = np.frombuffer(part.buffers()[1], np.int64)[part.offset : part.offset + len(part) + 1]
            data = np.frombuffer(part.buffers()[2], np.uint8) if part.buffers()[2] is not None else np.zeros(0, np.uint8)
            yield batch.slice(row, end - row), data[bounds[0] : bounds[-1]], bounds - bounds[0]
            row = end
    give_back()


class Ranges:
    """Hashes of byte ranges of one slice."""

    def __init__(self, data: np.ndarray):
        self.up, down = powers(len(data) + 1)
        with np.errstate(over="ignore"):
            self.sums = np.zeros(len(data) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[data] * down[: len(data)], out=self.sums[1:])

    def hash(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            raw = (self.sums[ends] - self.sums[starts]) * self.up[starts]
            return mix(raw + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def split_ranges(breaks: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal ranges without a break byte that do not cross a text's bound."""
    inside = ~breaks
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[bounds] = True
    begins = inside & first[:n]
    begins[1:] |= inside[1:] & breaks[:-1]
    finishes = inside & first[1:]
    finishes[:-1] |= inside[:-1] & breaks[1:]
    return np.flatnonzero(begins), np.flatnonzero(finishes) + 1


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a slice: byte ranges, text numbers, hashes."""

    def __init__(self, data: np.ndarray, bounds: np.ndarray, lower: bool = False):
        self.data = LOWER[data] if lower else data
        self.bounds = bounds
        self.starts, self.ends = split_ranges(SPACES[self.data], bounds)
        self.first = np.searchsorted(self.starts, bounds)
        self.counts = np.diff(self.first)
        self.text = np.repeat(np.arange(len(bounds) - 1), self.counts)
        self.ranges = Ranges(self.data)
        self.hashes = self.ranges.hash(self.starts, self.ends)


def grams(hashes: np.ndarray, size: int, seed: int = 5) -> np.ndarray:
    """Hash of each run of ``size`` neighbouring hashes (runs that cross texts included)."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(stream(seed, size) | np.uint64(1)):
            total += hashes[j : j + n] * factor
    return mix(total)


def shingles(words: Words, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all word shingles in order, and where each text's begin.

    A text of fewer than ``size`` words, but at least one, has one shingle: its whole word sequence.
    """
    counts = np.where(words.counts >= size, words.counts - size + 1, np.minimum(words.counts, 1))
    begin = np.concatenate([[0], np.cumsum(counts)])
    out = np.zeros(begin[-1], np.uint64)
    inner = np.repeat(words.first[:-1] - begin[:-1], counts) + np.arange(begin[-1])
    long_enough = np.repeat(words.counts >= size, counts)
    out[long_enough] = grams(words.hashes, size)[inner[long_enough]]
    for text in np.flatnonzero((words.counts > 0) & (words.counts < size)):
        own = words.hashes[words.first[text] : words.first[text + 1]]
        with np.errstate(over="ignore"):
            out[begin[text]] = mix((own * (stream(5, size)[: len(own)] | np.uint64(1))).sum(dtype=np.uint64) + np.uint64(len(own)))
    return out, begin
