"""Packing along a space-filling curve: documents with alike words become neighbours in training sequences.

Each text is hashed into a vector of signed word counts, projected to four dimensions, and given the
position of that point on a Hilbert curve. Documents are range-sorted along the curve; each partition is a
stretch of it and is cut into full sequences from end to end. What is left over at its end is cut into
sequences whose lengths are powers of two, which need no padding.

Defined cases: a NULL text is an empty one (only its end id); rows with the same text are neighbours; rows
with the same or a NULL ``doc_id`` are packed like any other; other columns are left out; an empty table
gives no rows.
"""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.encoding import encoder, vocabulary
from cardflux.llm.store import require, stored
from cardflux.llm.textbytes import Words, stream, text_slices

HASHED = 256
DIMENSIONS = 4
BITS = 12
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, hilbert_key long"


def hilbert_keys(points: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of integer points (one row each) below ``2**bits``."""
    x = points.T.astype(np.int64).copy()
    n = len(x)
    top = 1 << (bits - 1)
    q = top
    while q > 1:
        for i in range(n):
            high = (x[i] & q) > 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & (q - 1))
            x[0] ^= np.where(high, q - 1, swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    q = top
    while q > 1:
        flip ^= np.where((x[n - 1] & q) > 0, q - 1, 0)
        q >>= 1
    x ^= flip
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | ((x[i] >> bit) & 1)
    return key


def projection() -> np.ndarray:
    """A fixed random map from the hashed space to the curve's dimensions."""
    uniform = (stream(91, HASHED * DIMENSIONS) >> np.uint64(11)).astype(np.float64) / 2.0**53
    return (uniform * 2 - 1).reshape(HASHED, DIMENSIONS) * np.sqrt(3)


def curve_positions(data: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    words = Words(data, bounds, lower=True)
    n = len(bounds) - 1
    buckets = (words.hashes % np.uint64(HASHED)).astype(np.int64) + words.text * HASHED
    signs = np.where(words.hashes >> np.uint64(63), 1.0, -1.0)
    vectors = np.bincount(buckets, signs, n * HASHED).reshape(n, HASHED)
    norms = np.sqrt((vectors**2).sum(axis=1, keepdims=True))
    placed = (vectors / np.maximum(norms, 1)) @ projection()
    cells = ((np.tanh(placed) + 1) / 2 * ((1 << BITS) - 1)).round().astype(np.int64)
    return hilbert_keys(cells, BITS)


def with_curve_position(docs: DataFrame) -> DataFrame:
    """``doc_id, text`` and the text's ``hilbert_key``."""

    @F.arrow_udf("long")
    def position(texts: pa.Array) -> pa.Array:
        batch = pa.RecordBatch.from_arrays([texts], names=["text"])
        keys = [curve_positions(data, bounds) for _, data, bounds in text_slices(iter([batch]))]
        return pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))

    return require(docs, ["doc_id", "text"]).withColumn("hilbert_key", position("text"))


class Cutter:
    """Cuts the ids of documents in a row into sequences of given sizes."""

    def __init__(self, part: int):
        self.open: deque = deque()
        self.held = 0
        self.next_sequence = part << 32
        self.pieces: list[tuple] = []

    def add(self, doc_id: int | None, key: int, ids: np.ndarray) -> None:
        self.open.append((doc_id, key, ids, 0))
        self.held += len(ids)

    def cut(self, size: int) -> None:
        offset = 0
        while offset < size:
            doc_id, key, ids, start = self.open.popleft()
            length = min(len(ids) - start, size - offset)
            crc = zlib.crc32(ids[start : start + length].astype("<u4").tobytes())
            self.pieces.append((doc_id, start, length, crc, len(ids), self.next_sequence, offset, key))
            offset += length
            if start + length < len(ids):
                self.open.appendleft((doc_id, key, ids, start + length))
        self.held -= size
        self.next_sequence += 1

    def take(self) -> pa.RecordBatch:
        names = [field.split()[0] for field in PIECES.split(", ")]
        columns = list(zip(*self.pieces)) or [()] * len(names)
        self.pieces = []
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=names)


def pack(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, max_tokens: int = 1024, byte_level: bool = True) -> DataFrame:
    """One row per piece of a document: where it starts in the document and where it lies in its sequence.

    Sequence numbers are unique, not gapless: a partition numbers its own.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary(tokenizer), byte_level)
        cutter = Cutter(TaskContext.get().partitionId())
        for rows, data, bounds in text_slices(batches):
            texts = own.encode_texts(rows.column("text"), data, bounds)
            for doc_id, key, ids in zip(rows.column("doc_id").to_pylist(), rows.column("hilbert_key").to_pylist(), texts):
                cutter.add(doc_id, key, np.append(ids, ids.dtype.type(end_id)))
            while cutter.held >= max_tokens:
                cutter.cut(max_tokens)
            yield cutter.take()
        for bit in range(cutter.held.bit_length() - 1, -1, -1):
            if cutter.held >> bit & 1:
                cutter.cut(1 << bit)
        yield cutter.take()

    order = ["hilbert_key", F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    # Stored, as the range bounds take a pass over the keys before the sort.
    along = stored(with_curve_position(docs), "curve-positions").repartitionByRange(*order).sortWithinPartitions(*order, "text")
    return along.mapInArrow(cut, PIECES)
