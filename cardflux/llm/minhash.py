"""Near-duplicate documents by one-permutation hashing with optimal densification.

A document's set holds the 64-bit hashes of its distinct word shingles. One permutation deals the set into
bins, the least value of each bin is kept, and an empty bin copies the bin that a fixed sequence of hashes
finds first. Five bins make a band; documents that share a band meet in a bucket.

Buckets emit stars, not pairs: an edge joins each member with the bucket's centre, the member that meets the
most others in all its buckets, so that the copies of one text have one centre nearly everywhere. Edges are
confirmed on the full sets. Buckets that still hold several components then go through blocks of at most
about ``BLOCK`` members: a block of members outside the centre's component meets the blocks of the bucket, and only
pairs that can be linked become edges. That is an upper bound without loss: with token counts in
``BINS`` bins, two sets share at most the sum of the lesser counts. So no pair of one bucket is lost because it is not
linked with a centre, and few pairs are emitted. Documents with equal sets are one node from the start, so copies cost one row each.

With 40 bands of 5 bins, two documents of similarity 0.75 share no bucket with probability 2e-5.

Defined cases: a text without words (or NULL) has an empty set and links with nothing; a row with a NULL
``doc_id`` gives none to its component but takes the component of its set, and is kept only if nothing else has
that component; rows that share a ``doc_id`` are rows of one document and keep what their own texts say;
other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.components import components
from cardflux.llm.store import discard, require, stored
from cardflux.llm.textbytes import Words, mix, shingles, stream, text_slices

SHINGLE = 5
BANDS = 40
ROWS = 5
THRESHOLD = 75
BINS = 256
BLOCK = 256



def densified(sets: list[np.ndarray], bins: int) -> np.ndarray:
    """One row of ``bins`` values per set; every set holds one hash at least."""
    sizes = np.array([len(s) for s in sets])
    flat = mix(np.concatenate(sets) ^ np.uint64(0x5BD1E995))
    owner = np.repeat(np.arange(len(sets)), sizes)
    bin_of = ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    slot = owner * bins + bin_of
    order = np.lexsort((flat, slot))
    slot, flat = slot[order], flat[order]
    heads = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    values = np.zeros(len(sets) * bins, np.uint64)
    filled = np.zeros(len(sets) * bins, bool)
    values[slot[heads]], filled[slot[heads]] = flat[heads], True
    todo = np.flatnonzero(~filled)
    attempt = 0
    while len(todo):
        attempt += 1
        with np.errstate(over="ignore"):
            tries = mix((todo % bins).astype(np.uint64) * np.uint64(0x100000001B3) + np.uint64(attempt << 20))
        found = todo // bins * bins + (tries % np.uint64(bins)).astype(np.int64)
        done = filled[found]
        values[todo[done]] = values[found[done]]
        todo = todo[~done]
    return values.reshape(len(sets), bins)


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    parts = signature.reshape(len(signature), bands, rows)
    keys = np.zeros(parts.shape[:2], np.uint64)
    with np.errstate(over="ignore"):
        for j, factor in enumerate(stream(23, rows) | np.uint64(1)):
            keys += mix(parts[:, :, j]) * factor
        return mix(keys + np.arange(bands, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).astype(np.int64)


def document_sets(data: np.ndarray, bounds: np.ndarray, size: int) -> list[np.ndarray]:
    hashes, begin = shingles(Words(data, bounds, lower=True), size)
    return [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(begin) - 1)]


def signatures(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id, digest, n_shingles, node, check, bands``: node and check are two digests of the set, NULL if it is empty.

    ``digest`` is one of the text as it stands and tells rows of one ``doc_id`` apart.
    """

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches):
            sets = document_sets(data, bounds, size)
            full = [i for i, s in enumerate(sets) if len(s)]
            node, check = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            keys: list[np.ndarray | None] = [None] * len(sets)
            if full:
                with np.errstate(over="ignore"):
                    for i in full:
                        node[i] = mix(sets[i].sum(dtype=np.uint64)).astype(np.int64)
                        check[i] = mix(mix(sets[i]).sum(dtype=np.uint64) + np.uint64(len(sets[i]))).astype(np.int64)
                for i, row in zip(full, band_keys(densified([sets[i] for i in full], bands * rows), bands, rows)):
                    keys[i] = row
            empty = np.array([not len(s) for s in sets])
            lengths = [0 if k is None else bands for k in keys]
            flat = np.concatenate([k for k in keys if k is not None]) if full else np.zeros(0, np.int64)
            columns = [
                part.column("doc_id").cast(pa.int64()),
                part.column("digest"),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array(node, mask=empty),
                pa.array(check, mask=empty),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)), pa.array(flat)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "n_shingles", "node", "check", "bands"])

    texts = require(docs, ["doc_id", "text"]).withColumn("digest", F.xxhash64("text"))
    return texts.mapInArrow(sign, "doc_id long, digest long, n_shingles long, node long, check long, bands array<long>")


def _node_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """``node, members, bins`` of the wanted nodes (columns ``doc_id, node``), from their documents' whole texts.

    Texts are told apart by their digest, as a ``doc_id`` may repeat.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, bounds in text_slices(batches):
            sets = document_sets(data, bounds, size)
            with np.errstate(over="ignore"):
                nodes = [int(mix(s.sum(dtype=np.uint64)).astype(np.int64)) if len(s) else None for s in sets]
            keep = [i for i, (node, want) in enumerate(zip(nodes, part.column("node").to_pylist())) if node == want]
            bins = [np.bincount((sets[i] % np.uint64(BINS)).astype(np.int64), minlength=BINS).astype("<u2").tobytes() for i in keep]
            columns = [pa.array([nodes[i] for i in keep], pa.int64()), pa.array([sets[i].tobytes() for i in keep], pa.binary()), pa.array(bins, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "members", "bins"])

    # The wanted nodes grow with the documents, so they are never broadcast: the texts are shuffled once.
    texts = require(docs, ["doc_id", "text"]).join(wanted.hint("merge"), "doc_id")
    return texts.select("node", "text").mapInArrow(build, "node long, members binary, bins binary")


def _confirmed(edges: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """``a, b`` of the edges whose full sets are alike enough."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            linked = []
            for left, right in zip(batch.column("left"), batch.column("right")):
                x, y = np.frombuffer(left.as_buffer(), np.uint64), np.frombuffer(right.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                linked.append(100 * shared >= threshold * (len(x) + len(y) - shared))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    left = sets.select(F.col("node").alias("a"), F.col("members").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("members").alias("right"))
    return edges.join(right, "b").join(left, "a").mapInArrow(compare, "a long, b long")


def _possible(open_members: DataFrame, threshold: int) -> DataFrame:
    """``a, b``: pairs of one bucket and different roots that may be alike enough, block against block."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for i in range(batch.num_rows):
                sides = []
                for name in ("x", "y"):
                    rows = batch.column(name)[i].values
                    bins = np.frombuffer(b"".join(rows.field("bins").to_pylist()), "<u2").reshape(len(rows), BINS).astype(np.int32)
                    sides.append((*[rows.field(f).to_numpy() for f in ("node", "n", "root")], bins))
                (x, x_n, x_root, x_bins), (y, y_n, y_root, y_bins) = sides
                least, most = np.minimum(x_n[:, None], y_n), np.maximum(x_n[:, None], y_n)
                left, right = np.nonzero((x_root[:, None] != y_root) & (100 * least >= threshold * most))
                for start in range(0, len(left), 20_000):
                    p, q = left[start : start + 20_000], right[start : start + 20_000]
                    shared = np.minimum(x_bins[p], y_bins[q]).sum(axis=1)
                    likely = (100 + threshold) * shared >= threshold * (x_n[p] + y_n[q])
                    found.append(np.stack([x[p[likely]], y[q[likely]]]))
            pairs = np.unique(np.sort(np.concatenate(found, axis=1), axis=0), axis=1) if found else np.zeros((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    chunk = F.pmod(F.xxhash64("node"), F.ceil(F.col("n_members") / BLOCK))
    blocks = open_members.withColumn("chunk", chunk).groupBy("bucket", "central", "chunk").agg(F.collect_list(F.struct("node", "n", "root", "bins")).alias("block"))
    x = blocks.where("not central").select("bucket", F.col("chunk").alias("x_chunk"), F.col("block").alias("x"))
    y = blocks.select("bucket", "central", F.col("chunk").alias("y_chunk"), F.col("block").alias("y"))
    met = x.join(y, "bucket").where("central or y_chunk >= x_chunk").select("x", "y")
    return met.mapInArrow(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """``doc_id, n_shingles, component_id, kept`` for every row of ``docs``."""
    return _labelled(*_rooted(docs, size, bands, rows, threshold))


def representatives(docs: DataFrame, size: int = SHINGLE, bands: int = BANDS, rows: int = ROWS, threshold: int = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each group: the one of least ``doc_id`` (NULL last) and then least digest of its text.

    Rows without words are in no group and stay. Of rows alike in ``doc_id`` and text the one with the least
    digest of all columns stays.
    """
    signed, nodes, roots = _rooted(docs, size, bands, rows, threshold)
    rooted = nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    grouped = stored(signed.where("node is not null").select("doc_id", "digest", "node").join(rooted, "node"), "grouped-rows")
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "digest")
    least = grouped.groupBy("root").agg(F.min(place).alias("least")).select("least.doc_id", "least.digest")
    repeated = grouped.groupBy("doc_id", "digest").agg(F.count(F.lit(1)).alias("times"))
    kept = least.join(repeated, least["doc_id"].eqNullSafe(repeated["doc_id"]) & (least["digest"] == repeated["digest"])).select(
        least["doc_id"].alias("kept_id"), least["digest"].alias("kept_digest"), "times"
    )
    wordless = signed.where("node is null").select(F.col("doc_id").alias("kept_id"), F.col("digest").alias("kept_digest"), F.lit(1).cast("long").alias("times")).distinct()
    kept = stored(kept.unionByName(wordless), "kept-rows")
    one = kept.where("times = 1")
    once = docs.join(one, docs["doc_id"].cast("long").eqNullSafe(one["kept_id"]) & (F.xxhash64(docs["text"]) == one["kept_digest"]), "left_semi")
    # Rows that stand there more than once meet in an aggregate, which sends one of them per task.
    row = F.struct(*[docs[name] for name in docs.columns])
    many = kept.where("times > 1")
    match = docs["doc_id"].cast("long").eqNullSafe(many["kept_id"]) & (F.xxhash64(docs["text"]) == many["kept_digest"])
    several = docs.join(many, match).groupBy(many["kept_id"], many["kept_digest"]).agg(F.min_by(row, F.xxhash64(*[docs[name] for name in docs.columns])).alias("row"))
    return once.unionByName(several.select("row.*"))


def _rooted(docs: DataFrame, size: int, bands: int, rows: int, threshold: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signatures, the nodes (sets) and the least node that each linked one reaches."""
    signed = stored(signatures(docs, size, bands, rows), "signatures")
    nodes = stored(signed.where("node is not null").groupBy("node", "n_shingles").agg(F.min("doc_id").alias("doc_id")), "nodes")
    # One row with signatures per node; only rows of the same document and set repeat here.
    one_each = signed.select("doc_id", "node", "bands").join(nodes.select("doc_id", "node", "n_shingles"), ["doc_id", "node"])
    buckets = one_each.select(F.explode("bands").alias("bucket"), "node", F.col("n_shingles").cast("int").alias("n"))
    met = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_members"), F.min("node").alias("x"), F.max("node").alias("y"))
    met = met.where("x <> y").drop("x", "y")
    members = stored(buckets.join(met, "bucket"), "buckets")
    weights = members.groupBy("node").agg(F.sum("n_members").alias("weight"))
    weighed = stored(members.join(weights, "node"), "weighed-buckets")
    discard(members)
    centres = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "node", "n")).alias("hub")).select("bucket", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    rayed = stored(weighed.drop("weight").join(centres, "bucket"), "stars")
    discard(weighed)

    near_in_size = 100 * F.least("n", "hub_n") >= threshold * F.greatest("n", "hub_n")
    first = rayed.where("node <> hub").where(near_in_size).select(F.col("hub").alias("a"), F.col("node").alias("b"))
    first = stored(first.distinct(), "star-edges")
    # Full sets are fetched for nodes with an edge, and for members of buckets in which others than the centre can meet.
    compared = first.select(F.col("a").alias("node")).union(first.select("b")).union(rayed.where("n_members > 2").select("node")).distinct()
    wanted = stored(compared.join(nodes.where("doc_id is not null").select("node", "doc_id"), "node"), "candidates")
    sets = stored(_node_sets(docs, wanted, size), "sets")
    links = stored(_confirmed(first, sets, threshold), "links")
    roots = stored(components(links), "roots")
    # Two members of a bucket have met if one is its centre; others, in a bucket of three or more, have not yet.
    rooted = rayed.where("n_members > 2").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    split = rooted.groupBy("bucket").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("bucket")
    hub_roots = roots.select(F.col("node").alias("hub"), F.col("root").alias("hub_root"))
    opened = rooted.join(split, "bucket", "left_semi").where("node <> hub").join(hub_roots, "hub", "left")
    opened = stored(opened.select("bucket", "node", "n", "root", "n_members", (F.col("root") == F.coalesce("hub_root", "hub")).alias("central")), "open-members")
    discard(rayed)
    edges = stored(_possible(opened.join(sets.select("node", "bins"), "node"), threshold), "possible-links")
    found = stored(_confirmed(edges, sets, threshold), "more-links")
    discard(sets, opened, edges, first, wanted)
    if not found.isEmpty():
        roots = stored(components(links.unionByName(found)), "roots")
    return signed, nodes, roots


def _labelled(signed: DataFrame, nodes: DataFrame, roots: DataFrame) -> DataFrame:
    """Component ids back on every row of the documents."""
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    labels = rooted.join(least, "root").select("node", "component_id")
    rows = signed.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    kept = F.coalesce(F.col("doc_id") == component, component.isNull())
    return rows.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"))
