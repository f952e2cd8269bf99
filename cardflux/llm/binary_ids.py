"""Token ids of documents as ORC files: integer run-length encoding, row indexes, Bloom filters on ids.

The documents are range-sorted by id, so each file holds a range of ids in ascending order and its stripe
statistics prune look-ups by id; Bloom filters prune the row groups of the files that are left. Spark
splits files by stripe, so readers run in parallel within a file.

Defined cases: a NULL text is an empty one (only its end id is written); rows with a NULL id come first;
rows with the same id are all written, ordered by the hash of their text and then the text itself; other
columns are not stored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflux.llm.encoding import encoder, vocabulary
from cardflux.llm.store import CLEANUP, require
from cardflux.llm.textbytes import text_slices

STORED = "part int, part_start long, doc_id long, n_tokens int, ids array<int>"
ROW_INDEX_STRIDE = 1_000
STRIPE_BYTES = 16 << 20


def write_token_ids(docs: DataFrame, folder: str, tokenizer: str, end_id: int, byte_level: bool = False) -> None:
    """Encode every whole text and write its ids with ``end_id`` behind them, in ascending ``doc_id`` order."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary(tokenizer), byte_level)
        part, position = TaskContext.get().partitionId(), 0
        for rows, data, bounds in text_slices(batches):
            texts = own.encode_texts(rows.column("text"), data, bounds)
            sizes = np.array([len(ids) + 1 for ids in texts], np.int32)
            flat = np.concatenate([part_ids for ids in texts for part_ids in (ids, [end_id])]).astype(np.int32)
            ends = np.cumsum(sizes, dtype=np.int64)
            starts = position + ends - sizes
            position += int(ends[-1])
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), part, np.int32)),
                    pa.array(starts),
                    rows.column("doc_id").cast(pa.int64()),
                    pa.array(sizes),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat)),
                ],
                names=["part", "part_start", "doc_id", "n_tokens", "ids"],
            )

    order = [F.asc_nulls_first("doc_id"), F.xxhash64("text")]
    sorted_docs = require(docs, ["doc_id", "text"]).repartitionByRange(*order).sortWithinPartitions(*order, "text")
    writer = sorted_docs.mapInArrow(encode, STORED).write.format("orc").option("compression", "zstd")
    writer = writer.option("orc.bloom.filter.columns", "doc_id").option("orc.bloom.filter.fpp", "0.01")
    writer = writer.option("orc.row.index.stride", ROW_INDEX_STRIDE).option("orc.stripe.size", STRIPE_BYTES)
    spark = docs.sparkSession
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.save(folder)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of every document; ``start`` counts the ids of all documents before it.

    One row per file, its number of ids, goes through the driver.
    """
    files = spark.read.schema(STORED).orc(folder)
    totals = files.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total")).collect()
    before, offsets = 0, []
    for part, total in sorted(totals):
        offsets.append((part, before))
        before += total
    known = F.broadcast(spark.createDataFrame(offsets, "part int, before long"))
    joined = files.join(known, "part")
    return joined.select("doc_id", (F.col("before") + F.col("part_start")).alias("start"), F.col("n_tokens").cast("long").alias("n_tokens"), "ids")


def lookup(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """The ids of a few documents; files, stripes and row groups without them are not read."""
    return read_token_ids(spark, folder).where(F.col("doc_id").isin(doc_ids))


def checksums(stored: DataFrame) -> DataFrame:
    """``ids_crc32``: unsigned CRC-32 of a document's ids as little-endian unsigned 32-bit numbers."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            bounds = lists.offsets.to_numpy()
            raw = memoryview(lists.values.to_numpy(zero_copy_only=False).astype("<u4")).cast("B")
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
            columns = [batch.column(name) for name in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return stored.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
