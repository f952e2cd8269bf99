"""Connected components of an edge table, by alternating large-star and small-star steps on edges that tasks shrink first."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from cardflux.llm.store import discard, stored

#: Edges that a task holds before it shrinks them.
HELD = 1_000_000


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same connections with fewer edges: each node and the least one it reaches, where they differ."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = places[: len(a)], places[len(a) :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, a, least)
        np.minimum.at(label, b, least)
        # A label's own label may have fallen, too; nodes only ever point to lesser ones.
        np.minimum.at(label, before, label)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(len(nodes)))
    return nodes[moved], nodes[label[moved]]


def _shrunk(edges: DataFrame) -> DataFrame:
    """Each task's edges as stars, which connect what they connected; no task holds more than ``HELD`` edges and a batch."""

    def shrink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emitted() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in held], names=["a", "b"])

        held, waiting = (np.zeros(0, np.int64),) * 2, []
        for batch in batches:
            waiting.append([batch.column(name).to_numpy() for name in ("a", "b")])
            if sum(len(a) for a, _ in waiting) + len(held[0]) >= HELD:
                held, waiting = _stars(*[np.concatenate([held[i], *[x[i] for x in waiting]]) for i in (0, 1)]), []
                if len(held[0]) > HELD // 2:
                    yield emitted()
                    held = (np.zeros(0, np.int64),) * 2
        held = _stars(*[np.concatenate([held[i], *[x[i] for x in waiting]]) for i in (0, 1)])
        yield emitted()

    return edges.select("a", "b").mapInArrow(shrink, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """``node, root`` for every node of ``links`` (columns ``a, b``); the root is the least node it reaches.

    Each step joins the least neighbour, an aggregate that combines before the shuffle, to the edges; no neighbourhood is
    collected. Where a step's edges are written, each task first reduces its own to stars. Steps end when every node has
    one root and no root has another; the table that shows this is the result.
    """
    edges = stored(_shrunk(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "links")
    while True:
        # Large star: the greater end of each edge moves to the least neighbour of the lesser end.
        least = edges.groupBy(F.col("a").alias("b")).agg(F.min("b").alias("least"))
        large = stored(_shrunk(edges.join(least, "b", "left").select("a", F.coalesce("least", "b").alias("b"))), "large-star")
        # Small star: the lesser neighbours of a node move to the least of them.
        least = large.groupBy("a").agg(F.min("b").alias("least"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("a", F.col("least").alias("b")), F.struct(F.col("b").alias("a"), F.col("least").alias("b")))).alias("edge"))
        before, edges = edges, stored(_shrunk(small.select("edge.*").where("a <> b")), "small-star")
        discard(before, large)
        seen = Observation()
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("up")), F.struct(F.col("b").alias("node"), F.lit(None).cast("long").alias("up")))).alias("end"))
        nodes = ends.select("end.*").groupBy("node").agg(F.min("up").alias("least"), F.max("up").alias("most"), F.count_if(F.col("up").isNull()).alias("below"))
        unsettled = F.count_if(F.col("least").isNotNull() & ((F.col("below") > 0) | (F.col("least") != F.col("most"))))
        nodes = stored(nodes.observe(seen, unsettled.alias("unsettled")).select("node", F.coalesce("least", "node").alias("root")), "roots")
        if not seen.get["unsettled"]:
            discard(edges)
            return nodes
        discard(nodes)
