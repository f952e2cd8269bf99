"""Near-duplicate documents by SimHash fingerprints at a Hamming distance of at most ``DISTANCE``.

A fingerprint is cut into segments of two bits; the number of set bits of each segment is one coordinate of the
fingerprint's embedding. A differing bit moves one coordinate by one at most, so the Manhattan distance of two
embeddings is never above the Hamming distance of the fingerprints. The coordinates are dealt into grids, two for a
distance of three, so that the embeddings of two linked fingerprints differ by one at most in some grid. So the range join
is exact: in each grid a fingerprint has a home cell and probes the cells just above it; of two at Manhattan distance
one, one is above the other, and a pair meets in the home cell of one of the two.
Cells where nobody is at home, or with a single member, are dropped before they are gathered.

Documents with equal fingerprints are one node. A cell with many members is cut into blocks of about ``BLOCK``,
and every two blocks of a cell are one row, placed by cell and block. There the exact distances are taken from the bits,
and a block returns a star for each connected group it finds: fewer edges than it has members, not all pairs.

Defined cases: a text without words (or NULL) has the fingerprint zero and links like any other; fewer words than a
shingle has are one shingle; a row with a NULL ``doc_id`` has a fingerprint and takes the component of the others with it,
but gives none its id (NULL if nothing else is there); repeated rows each get a row; texts of any length are read whole;
other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.components import components
from cardflux.llm.store import discard, require, stored
from cardflux.llm.textbytes import LOWER, SPACES, split_ranges, text_slices

SHINGLE = 3
SEED = 42
DISTANCE = 3
BLOCK = 1_024
#: Shingles whose bits are counted at a time, so that one long text needs no memory for all of its bits at once.
SPAN = 100_000


def _joined(data: np.ndarray, bounds: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray]:
    """All words of a slice joined by single spaces, where each starts and ends there, and each text's number of words."""
    data = LOWER[data]
    starts, ends = split_ranges(SPACES[data], bounds)
    lengths = ends - starts
    places = np.cumsum(lengths + 1) - lengths - 1
    joined = np.full(int((lengths + 1).sum()), 0x20, np.uint8)
    target = np.arange(int(lengths.sum())) + np.repeat(places - (np.cumsum(lengths) - lengths), lengths)
    joined[target] = data[np.arange(len(target)) + np.repeat(starts - (np.cumsum(lengths) - lengths), lengths)]
    return joined.tobytes(), places, places + lengths, np.diff(np.searchsorted(starts, bounds))


def fingerprints(data: np.ndarray, bounds: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """One unsigned fingerprint per text of a slice."""
    joined, begins, ends, words = _joined(data, bounds)
    digest = xxhash.xxh64_intdigest
    n_shingles = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    out = np.zeros(len(words), np.uint64)
    first_word = np.cumsum(words) - words
    last = np.minimum(size, words) - 1  # of a text's first shingle
    # Runs of texts with at most SPAN shingles; a longer text is a run of its own and is counted span by span.
    totals = np.concatenate([[0], np.cumsum(n_shingles)])
    text = 0
    while text < len(words):
        end = max(text + 1, int(np.searchsorted(totals, totals[text] + SPAN, "right")) - 1)
        counts = np.zeros((end - text, 64), np.int64)
        for low in range(int(totals[text]), int(totals[end]), SPAN):
            high = min(low + SPAN, int(totals[end]))
            owner = np.searchsorted(totals, np.arange(low, high), "right") - 1
            opening = first_word[owner] + np.arange(low, high) - totals[owner]
            left, right = begins[opening].tolist(), ends[opening + last[owner]].tolist()
            hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(left, right)), np.uint64, high - low)
            bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            heads = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
            counts[owner[heads] - text] += np.add.reduceat(bits, heads, axis=0, dtype=np.int64)
        ones = 2 * counts > n_shingles[text:end, None]
        out[text:end] = np.packbits(ones, axis=1, bitorder="little").view("<u8")[:, 0]
        text = end
    return out


def fingerprinted(docs: DataFrame, size: int = SHINGLE) -> DataFrame:
    """``doc_id, fp`` of every row; the fingerprint's 64 bits as a signed number."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches):
            prints = fingerprints(data, bounds, size).view(np.int64)
            yield pa.RecordBatch.from_arrays([part.column("doc_id").cast(pa.int64()), pa.array(prints)], names=["doc_id", "fp"])

    return require(docs, ["doc_id", "text"]).mapInArrow(sign, "doc_id long, fp long")


def embedding(prints: np.ndarray) -> np.ndarray:
    """Set bits (0 to 2) of each of the 32 two-bit segments."""
    bits = np.unpackbits(prints.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits[:, 0::2] + bits[:, 1::2]


def cells(nodes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``cell, fp, home``: the cell of every fingerprint in each grid, and those just above it."""
    grids = np.array_split(np.arange(32), distance // 2 + 1)
    probing = distance // len(grids) == 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column("fp").to_numpy()
            sums = embedding(prints.view(np.uint64))
            columns: list[list[np.ndarray]] = [[], [], []]
            for number, grid in enumerate(grids):
                # A cell is the grid's coordinates as digits of a number; a probe adds one to a coordinate that has room.
                scale = 3 ** np.arange(len(grid), dtype=np.uint64) * np.uint64(len(grids))
                home = (sums[:, grid].astype(np.uint64) * scale).sum(axis=1, dtype=np.uint64) + np.uint64(number)
                row, raised = np.nonzero(sums[:, grid] < 2) if probing else (np.zeros(0, np.int64),) * 2
                columns[0] += [home, home[row] + scale[raised]]
                columns[1] += [prints, prints[row]]
                columns[2] += [np.ones(len(prints), bool), np.zeros(len(row), bool)]
            arrays = [np.concatenate(columns[0]).view(np.int64), np.concatenate(columns[1]), np.concatenate(columns[2])]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], names=["cell", "fp", "home"])

    return nodes.select("fp").mapInArrow(deal, "cell long, fp long, home boolean")


def _stars(x: np.ndarray, y: np.ndarray | None, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges ``a, b`` that connect what is linked within one block (``y`` None) or between two."""
    if y is None:
        near = np.bitwise_count(x[:, None] ^ x) <= distance
        members = x
    else:
        near = np.zeros((len(x) + len(y),) * 2, bool)
        near[: len(x), len(x) :] = np.bitwise_count(x[:, None] ^ y) <= distance
        near |= near.T
        members = np.concatenate([x, y])
    label = np.full(len(members), -1)
    for seed in np.flatnonzero(near.sum(axis=1) > (y is None)):
        if label[seed] < 0:
            front = np.array([seed])
            label[seed] = seed
            while len(front):
                front = np.flatnonzero(near[front].any(axis=0) & (label < 0))
                label[front] = seed
    rays = np.flatnonzero((label >= 0) & (label != np.arange(len(members))))
    return members[label[rays]], members[rays]


def _links(met: DataFrame, distance: int) -> DataFrame:
    """``a, b`` from rows with the fingerprints ``x`` and, for two blocks, ``y``."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 4_096):
                part = batch.slice(start, 4_096)
                found = []
                for i in range(part.num_rows):
                    x, y = (part.column(name)[i].values for name in ("x", "y"))
                    found.append(_stars(x.to_numpy().view(np.uint64), None if y is None else y.to_numpy().view(np.uint64), distance))
                pairs = [np.concatenate([pair[side] for pair in found]).view(np.int64) for side in (0, 1)]
                yield pa.RecordBatch.from_arrays([pa.array(side) for side in pairs], names=["a", "b"])

    return met.mapInArrow(compare, "a long, b long")


def linked(nodes: DataFrame, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``a, b``: fingerprints that connect all those within the distance (``nodes`` has distinct ``fp``)."""
    dealt = stored(cells(nodes, distance), "cells")
    met = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("home").alias("home")).where("n > 1 and home").select("cell", "n")
    members = dealt.join(met, "cell").withColumn("chunks", F.ceil(F.col("n") / block))
    blocks = members.groupBy("cell", "chunks", F.pmod(F.xxhash64("fp"), "chunks").alias("chunk")).agg(F.collect_list("fp").alias("fps"))
    blocks = stored(blocks, "cell-blocks")
    discard(dealt)
    alone = blocks.where(F.size("fps") > 1).select(F.col("fps").alias("x"), F.lit(None).cast("array<long>").alias("y"))
    many = blocks.where("chunks > 1")
    # Every block goes to the later blocks of its cell; rows are placed by cell and block, so a hot cell is many tasks.
    later = F.explode(F.sequence(F.col("chunk") + 1, F.col("chunks") - 1))
    left = many.where("chunk + 1 < chunks").select("cell", F.col("fps").alias("x"), later.alias("chunk"))
    pairs = left.join(many.select("cell", "chunk", F.col("fps").alias("y")), ["cell", "chunk"]).select("x", "y")
    return _links(alone.unionByName(pairs), distance)


def near_duplicates(docs: DataFrame, size: int = SHINGLE, distance: int = DISTANCE, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row."""
    signed = stored(fingerprinted(docs, size), "fingerprints")
    nodes = stored(signed.groupBy("fp").agg(F.min("doc_id").alias("doc_id")), "fingerprint-nodes")
    links = stored(linked(nodes, distance, block).distinct(), "fingerprint-links")
    roots = stored(components(links), "fingerprint-roots")
    rooted = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = rooted.join(least, "root").select("fp", "component_id")
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return signed.join(labels, "fp").select("doc_id", shown, "component_id")
