"""Hashed n-gram multinomials of trusted and of all text: counts over every document, in one pass."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.labelled import marked
from cardflux.llm.store import collected
from cardflux.llm.textbytes import Words, grams, text_slices

BUCKETS = 1 << 16
#: Pseudo-counts of each bucket in both models, at the size of the trusted text.
SMOOTHING = 5.0


def hashed_grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text number of every word and every pair of neighbouring words of a text."""
    pairs = grams(words.hashes, 2, seed=7)
    inner = words.text[1:] == words.text[:-1]
    buckets = np.concatenate([words.hashes, pairs[inner[: len(pairs)]]]) % np.uint64(BUCKETS)
    return buckets.astype(np.int64), np.concatenate([words.text, words.text[:-1][inner]])


def log_ratios(docs: DataFrame, trusted_ids: DataFrame | np.ndarray) -> np.ndarray:
    """``log p_trusted - log p_all`` per bucket; the counts of all text cover every document, those of trusted text all of it.

    ``trusted_ids`` has a row per id. Each task sends one row per bucket that it met.
    """
    if isinstance(trusted_ids, np.ndarray):
        trusted_ids = docs.sparkSession.createDataFrame([(int(i),) for i in np.unique(trusted_ids)], "doc_id long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        everything, trusted = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for rows, data, bounds in text_slices(batches):
            buckets, owners = hashed_grams(Words(data, bounds))
            everything += np.bincount(buckets, minlength=BUCKETS)
            known = rows.column("trusted").to_numpy(zero_copy_only=False)
            trusted += np.bincount(buckets[known[owners]], minlength=BUCKETS)
        met = np.flatnonzero(everything)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(everything[met]), pa.array(trusted[met])], names=["bucket", "everything", "trusted"])

    counted = marked(docs, trusted_ids, "trusted").mapInArrow(count, "bucket int, everything long, trusted long")
    table = np.array(collected(counted.groupBy("bucket").agg(F.sum("everything"), F.sum("trusted"))), np.float64).reshape(-1, 3)
    everything, trusted = np.zeros(BUCKETS), np.zeros(BUCKETS)
    everything[table[:, 0].astype(int)], trusted[table[:, 0].astype(int)] = table[:, 1], table[:, 2]
    if not trusted.sum():
        return np.zeros(BUCKETS)
    expected = everything * (trusted.sum() / everything.sum())
    return np.log((trusted + SMOOTHING) / (expected + SMOOTHING))


def mean_ratio(words: Words, ratios: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text, the mean log ratio of its grams and their number (0 for a text without words)."""
    buckets, owners = hashed_grams(words)
    n = len(words.counts)
    counts = np.bincount(owners, minlength=n)
    return np.bincount(owners, ratios[buckets], n) / np.maximum(counts, 1), counts
