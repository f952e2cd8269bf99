"""Approximate nearest neighbours by largest inner product, with balanced posting lists.

One more coordinate turns the largest inner product into the least distance. Lists are the leaves of a tree
of median cuts over a bounded sample (``MAX_SAMPLE``), so they hold about equally many vectors; their centroids, at
most ``MAX_LISTS``, are searched by a beam on an in-memory neighbour graph. Every vector is indexed: in its nearest
list and, if it lies near the boundary to another one, there, too, in ``MOST_REPLICAS`` lists at most. The boundary is the plane half-way
between two centroids; a vector is near it if its distance from the plane is below ``MARGIN`` times that of the centroids.
A query reads the lists within some ratio of its distance from the nearest, and ``LEAST_PROBES`` at least; where the beam ends before that
distance is reached, all centroids are looked at. The ratio is the one that finds ``RECALL`` of the true neighbours, within the sample, of
``PROBED`` of its vectors. A query whose lists give it fewer than ``k`` neighbours reads all lists.

Vectors are stored once per list that holds them, dealt by list; a list with a large share of the sample is dealt out to several tasks.
Queries are stored once each, with the lists they read as bits. They meet the lists in passes of about ``QUERIES`` queries, which every
task holds: it scores a list's vectors for the queries that read it, and keeps the ``k`` best of each query over all its lists, so that
a query has at most ``k`` rows per task however many lists it reads. Only what a bound on rounding leaves among the best is
scored in double precision in a fixed order, so equal vectors have equal scores.

Defined cases: vectors that are NULL, zero, or hold NULL or non-finite components take no part, nor do rows
with a NULL ``vec_id`` or vectors that are not of the table's most common length; of rows that share a ``vec_id`` the best
score counts once; ties go to the smaller ``vec_id``; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflux.llm.store import stored
from cardflux.llm.textbytes import mix

MAX_SAMPLE = 20_000
MAX_LISTS = 4_096
LIST_SIZE = 256
MARGIN = 0.06
MOST_REPLICAS = 4
RECALL = 0.97
PROBED = 256
LEAST_PROBES = 16
#: Rows of a list beyond which it is dealt out to several tasks.
DEALT = 65_536
#: About how many queries a pass sends to all tasks, and scores that a task computes at a time, along both sides.
QUERIES = 16_384
TILE = 1_024
DEGREE = 24
BEAM = 96
#: Neighbours that a task holds for all its queries before it sends some on.
HELD = 1_000_000


def usable(vectors: DataFrame, id_column: str, vector_column: str) -> DataFrame:
    """``vec_id, v`` (doubles) of the rows that take part."""
    rows = vectors.select(vectors[id_column].cast("long").alias("vec_id"), vectors[vector_column].cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where("vec_id is not null and v is not null").where(finite & F.exists("v", lambda x: x != 0))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).limit(1).collect()
    return rows.where(F.size("v") == (common[0]["n"] if common else 0))


def balanced_centroids(sample: np.ndarray, lists: int) -> np.ndarray:
    """Means of the leaves of a tree of median cuts along the widest spread, refined without moving the leaves' sizes far."""
    leaves = [np.arange(len(sample))]
    while len(leaves) < lists:
        leaves.sort(key=len)
        widest = leaves.pop()
        rows = sample[widest]
        centred = rows - rows.mean(axis=0)
        direction = centred[np.argmax((centred**2).sum(axis=1))]
        for _ in range(5):
            moved = centred.T @ (centred @ direction)
            norm = np.linalg.norm(moved)
            if norm == 0:
                break
            direction = moved / norm
        order = np.argsort(centred @ direction, kind="stable")
        half = len(order) // 2
        if half == 0:
            leaves.append(widest)
            break
        leaves += [widest[order[:half]], widest[order[half:]]]
    centroids = np.stack([sample[leaf].mean(axis=0) for leaf in leaves])
    for _ in range(3):
        near = nearest(sample, centroids)
        sizes = np.bincount(near, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, near, sample)
        centroids = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], centroids)
    return np.unique(centroids, axis=0)


def squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(axis=1)[:, None] + (y**2).sum(axis=1) - 2 * x @ y.T, 0)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.concatenate([squares(x[i : i + 512], centroids).argmin(axis=1) for i in range(0, len(x), 512)])


@dataclass
class Graph:
    """Centroids, each with its nearest ones and a few far ones as neighbours."""

    centroids: np.ndarray
    neighbours: np.ndarray
    #: Shares of the sample that are nearest to each centroid.
    shares: np.ndarray | None = None

    @classmethod
    def over(cls, centroids: np.ndarray) -> Graph:
        n = len(centroids)
        degree = min(DEGREE, n)
        near = np.concatenate([np.argsort(squares(centroids[i : i + 512], centroids), axis=1, kind="stable")[:, :degree].copy() for i in range(0, n, 512)])
        far = np.random.default_rng(4).integers(0, n, (n, 4))
        ring = (np.arange(n) + 1) % n  # so that every centroid can be reached
        return cls(centroids, np.concatenate([near, far, ring[:, None]], axis=1))

    def search(self, points: np.ndarray, beam: int = BEAM) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and distances of the nearest centroids found for each point, nearest first; a beam search per point, all points in step."""
        n, count = len(self.centroids), len(points)
        beam = min(beam, n)
        rows = np.arange(count)[:, None]
        norms = (self.centroids**2).sum(axis=1)
        own = (points**2).sum(axis=1)[:, None]
        seen = np.zeros((count, n), bool)
        entries = np.linspace(0, n - 1, min(n, beam)).astype(np.int64)
        pool = np.broadcast_to(entries, (count, len(entries))).copy()
        distance = own + norms[pool] - 2 * points @ self.centroids[entries].T
        seen[:, entries] = True
        spread = np.zeros(pool.shape, bool)
        while True:
            open_distance = np.where(spread, np.inf, distance)
            best = open_distance.argmin(axis=1)
            going = np.flatnonzero(np.isfinite(open_distance[np.arange(count), best]))
            if not len(going):
                break
            spread[going, best[going]] = True
            new = self.neighbours[pool[going, best[going]]]
            fresh = ~seen[going[:, None], new]
            seen[going[:, None], new] = True
            there = own[going] + norms[new] - 2 * np.einsum("ijk,ik->ij", self.centroids[new], points[going])
            # The same neighbour twice in one row counts once.
            order = np.argsort(new, axis=1, kind="stable")
            twice = np.zeros(new.shape, bool)
            repeats = np.diff(np.take_along_axis(new, order, 1), axis=1) == 0
            np.put_along_axis(twice, order[:, 1:], repeats, 1)
            there = np.where(fresh & ~twice, there, np.inf)
            all_distance = np.concatenate([distance[going], there], axis=1)
            all_pool = np.concatenate([pool[going], new], axis=1)
            all_spread = np.concatenate([spread[going], ~np.isfinite(there)], axis=1)
            top = np.argpartition(all_distance, beam - 1, axis=1)[:, :beam]
            width = pool.shape[1]
            distance[going], pool[going], spread[going] = (np.take_along_axis(a, top, 1)[:, :width] for a in (all_distance, all_pool, all_spread))
        order = np.argsort(distance, axis=1, kind="stable")
        return pool[rows, order], np.sqrt(np.maximum(distance[rows, order], 0))

    def lists_to_hold(self, points: np.ndarray, margin: float) -> list[np.ndarray]:
        """For each vector its nearest list, and more of them near a boundary."""
        if len(points) > 1024:
            return [lists for i in range(0, len(points), 1024) for lists in self.lists_to_hold(points[i : i + 1024], margin)]
        found, distance = self.search(points, 32)
        apart = ((self.centroids[found] - self.centroids[found[:, :1]]) ** 2).sum(axis=2)
        # The squared distances differ by twice the product of the distance from the plane and the distance of the centroids.
        near = distance**2 - distance[:, :1] ** 2 <= 2 * margin * apart
        near[:, 0] = True
        near &= np.cumsum(near, axis=1) <= MOST_REPLICAS
        return [lists[keep].astype(np.int32) for lists, keep in zip(found, near)]

    def ratio(self, sample: np.ndarray, greatest: float, margin: float, k: int, recall: float) -> float:
        """The distance ratio within which the share ``recall`` of sample vectors' neighbours are held by a list."""
        probes = sample[:PROBED]
        scores = probes @ sample.T
        scores[np.arange(len(probes)), np.arange(len(probes))] = -np.inf
        k = min(k, len(sample) - 1)
        if k < 1:
            return 1.0
        near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
        ids, at = np.unique(near, return_inverse=True)
        holding = self.lists_to_hold(lifted(sample[ids], greatest), margin)
        distance = np.sqrt(squares(np.concatenate([probes, np.zeros((len(probes), 1))], axis=1), self.centroids))
        distance /= np.maximum(distance.min(axis=1, keepdims=True), 1e-300)
        needed = [distance[row, holding[i]].min() for row, places in enumerate(at.reshape(near.shape)) for i in places]
        return float(np.quantile(needed, recall, method="higher"))

    def lists_to_read(self, points: np.ndarray, prune: float, least: int) -> list[np.ndarray]:
        found, distance = self.search(points)
        out = []
        for point, lists, d in zip(points, found, distance):
            if len(lists) < len(self.centroids) and d[-1] <= prune * d[0]:
                all_distances = np.sqrt(squares(point[None], self.centroids)[0])
                lists = np.argsort(all_distances, kind="stable")
                d = all_distances[lists]
            wanted = d <= prune * d[0]
            wanted[:least] = True
            out.append(lists[wanted].astype(np.int32))
        return out


def matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def fit(rows: DataFrame, list_size: int = LIST_SIZE, margin: float = MARGIN, k: int = 20, recall: float = RECALL) -> tuple[Graph, float, float] | None:
    """The graph over the lists' centroids, the greatest norm and the ratio to read by, or None without vectors."""
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    count, greatest = rows.agg(F.count(F.lit(1)), F.max(norm)).first()
    if not count:
        return None
    hashed = rows.select("vec_id", "v", F.xxhash64("vec_id", "v").alias("hash"))
    # The least hashes are looked for among some more than are wanted, as a task sorts what all others send it.
    few = hashed.where(F.col("hash") < int(2 * MAX_SAMPLE / count * 2**64) - 2**63) if count > 4 * MAX_SAMPLE else hashed
    few = few if few is hashed or few.count() >= MAX_SAMPLE else hashed
    drawn = few.orderBy("hash", "vec_id").limit(MAX_SAMPLE).select("v").toArrow().column("v").combine_chunks()
    sample = matrix(drawn)
    lists = int(min(MAX_LISTS, max(1, -(-count // list_size)), len(sample)))
    raised = lifted(sample, greatest)
    graph = Graph.over(balanced_centroids(raised, lists))
    graph.shares = np.bincount(nearest(raised, graph.centroids), minlength=len(graph.centroids)) / len(sample)
    return graph, greatest, graph.ratio(sample, greatest, margin, k, recall)


def lifted(vectors: np.ndarray, greatest: float) -> np.ndarray:
    """With the coordinate that gives all vectors the greatest norm."""
    rest = np.sqrt(np.maximum(greatest**2 - (vectors**2).sum(axis=1), 0))
    return np.concatenate([vectors, rest[:, None]], axis=1)


def _held(rows: DataFrame, lists_of: Callable[[np.ndarray], list[np.ndarray]], parts: np.ndarray) -> DataFrame:
    """``list, vec_id, v``: one row per list that holds a vector, dealt by list and by ``parts`` of a list."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                vectors = matrix(part.column("v"))
                lists = lists_of(vectors)
                take = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
                number = np.concatenate(lists)
                hashes = mix(part.column("vec_id").to_numpy().view(np.uint64) ^ mix(vectors[:, 0].view(np.uint64)))[take]
                columns = [pa.array(number), pa.array((hashes % parts[number].astype(np.uint64)).astype(np.int32)), *(part.column(name).take(pa.array(take)) for name in ("vec_id", "v"))]
                yield pa.RecordBatch.from_arrays(columns, names=["list", "part", "vec_id", "v"])

    spread = rows.mapInArrow(place, "list int, part int, vec_id long, v array<double>")
    return spread.repartition("list", "part").sortWithinPartitions("list").drop("part")


def _asked(rows: DataFrame, lists_of: Callable[[np.ndarray], list[np.ndarray]], count: int) -> DataFrame:
    """``vec_id, v, lists``: queries with the lists they read, a bit for each of ``count`` lists."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                bits = np.zeros((part.num_rows, count), bool)
                for row, lists in zip(bits, lists_of(matrix(part.column("v")))):
                    row[lists] = True
                packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), part.column("v"), packed], names=["vec_id", "v", "lists"])

    return rows.mapInArrow(read, "vec_id long, v array<double>, lists binary")


class Best:
    """The ``k`` best of each of some queries, as lists of vectors come."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, reads: np.ndarray, k: int):
        self.ids, self.of = np.unique(ids, return_inverse=True)
        self.vectors, self.reads, self.k = vectors, reads, k
        self.lengths = np.abs(vectors).sum(axis=1)
        #: What is below cannot be among the ``k`` best of a query.
        self.least = np.full(len(self.ids), -np.inf)
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.waiting: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, number: int, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Vectors of a list."""
        asking = np.flatnonzero(self.reads[:, number >> 3] >> (7 - (number & 7)) & 1)
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], vectors[order]
        for some in (slice(i, i + TILE) for i in range(0, len(ids), TILE)):
            for rows in (asking[i : i + TILE] for i in range(0, len(asking), TILE)):
                self._score(rows, ids[some], vectors[some])

    def _score(self, rows: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        of = self.of[rows]
        rough = self.vectors[rows] @ vectors.T
        rough[self.ids[of][:, None] == ids[None, :]] = -np.inf
        slack = 1e-9 * (self.lengths[rows] * np.abs(vectors).max(initial=0) + 1e-300)
        cut = self.least[of] - slack
        near = rough >= cut[:, None]
        if np.count_nonzero(near) > 2 * self.k * len(rows):
            # An id may stand in several rows; its best one counts, before anything is cut.
            heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
            best = rough if len(heads) == len(ids) else np.maximum.reduceat(rough, heads, axis=1)
            if best.shape[1] > self.k:
                cut = np.maximum(cut, np.partition(best, -self.k, axis=1)[:, -self.k] - slack)
                near = rough >= cut[:, None]
        near &= rough > -np.inf
        at, there = np.nonzero(near)
        if len(at):
            self.waiting.append((of[at], ids[there], (vectors[there] * self.vectors[rows[at]]).sum(axis=1)))
            self.held += len(at)
            if self.held >= HELD:
                self.gather()

    def gather(self) -> None:
        self.kept, self.waiting, self.held = foremost([self.kept, *self.waiting], self.k), [], 0
        query, _, score = self.kept
        last = np.flatnonzero(np.bincount(query, minlength=len(self.ids)) == self.k)
        self.least[last] = np.maximum(self.least[last], score[np.searchsorted(query, last, "right") - 1])

    def sent(self) -> pa.RecordBatch:
        self.gather()
        query, vector, score = self.kept
        self.kept = tuple(column[:0] for column in self.kept)
        return pa.RecordBatch.from_arrays([pa.array(column) for column in (self.ids[query], vector, score)], names=["query_id", "vec_id", "score"])


def foremost(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]], k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best of each query among what several blocks gave, an id once, ties to the smaller id."""
    query, vector, score = (np.concatenate([f[i] for f in found]) for i in range(3))
    order = np.lexsort((-score, vector, query))
    query, vector, score = query[order], vector[order], score[order]
    once = np.ones(len(query), bool)
    once[1:] = (query[1:] != query[:-1]) | (vector[1:] != vector[:-1])
    query, vector, score = query[once], vector[once], score[once]
    order = np.lexsort((vector, -score, query))
    query, vector, score = query[order], vector[order], score[order]
    near = np.arange(len(query)) - np.searchsorted(query, query) < k
    return query[near], vector[near], score[near]


def _sent(asked: DataFrame) -> Broadcast:
    """Ids, vectors and lists of the queries of a pass, for all tasks. ``asked`` has a row per query, or one per query and ``list``."""
    table = asked.toArrow().combine_chunks()
    columns = {name: column.chunk(0) if column.num_chunks else pa.array([], column.type) for name, column in zip(table.column_names, table.columns)}
    ids, vectors = columns["vec_id"].to_numpy(), matrix(columns["v"])
    if "list" in columns:
        numbers = columns["list"].to_numpy()
        bits = np.zeros((len(ids), int(numbers.max(initial=0)) + 1), bool)
        bits[np.arange(len(ids)), numbers] = True
        reads = np.packbits(bits, axis=1)
    else:
        reads = np.frombuffer(b"".join(columns["lists"].to_pylist()), np.uint8).reshape(len(ids), -1 if len(ids) else 0)
    return asked.sparkSession.sparkContext.broadcast((ids, vectors, reads))


def _scored(sent: Broadcast, held: DataFrame, k: int) -> DataFrame:
    """``query_id, vec_id, score``: the ``k`` nearest of each query among the vectors that one task scores."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(*sent.value, k)
        for batch in batches:
            if not batch.num_rows or not len(best.ids):
                continue
            numbers, ids, vectors = batch.column("list").to_numpy(), batch.column("vec_id").to_numpy(), matrix(batch.column("v"))
            order = np.argsort(numbers, kind="stable")
            for rows in np.split(order, np.flatnonzero(np.diff(numbers[order])) + 1):
                # Lists that no query of the pass reads may have numbers beyond the bits.
                if numbers[rows[0]] >> 3 < best.reads.shape[1]:
                    best.add(int(numbers[rows[0]]), ids[rows], vectors[rows])
                if len(best.kept[0]) > HELD // 2:
                    yield best.sent()
        yield best.sent()

    return held.mapInArrow(score, "query_id long, vec_id long, score double")


def _found(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    return _scored(_sent(asked), held, k)


def _best_of(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def _ranked(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """The ``k`` nearest that the lists of each query hold; ``asked`` has the queries of one pass."""
    return _best_of(_found(asked, held, k), k)


def _in_passes(asked: DataFrame, held: DataFrame, k: int) -> DataFrame:
    """:func:`_ranked` for any number of queries; ``asked`` is stored. What a pass sends to the tasks ends with it."""
    passes = max(1, -(-asked.count() // QUERIES))
    out = []
    for number in range(passes):
        sent = _sent(asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == number))
        out.append(stored(_best_of(_scored(sent, held, k), k), "neighbours"))
        sent.destroy()
    return functools.reduce(DataFrame.unionByName, out)


def search(
    vectors: DataFrame,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
    every: int = 20,
    k: int = 20,
    list_size: int = LIST_SIZE,
    margin: float = MARGIN,
    recall: float = RECALL,
    least_probes: int = LEAST_PROBES,
) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found of each vector whose id is divisible by ``every``."""
    spark = vectors.sparkSession
    rows = stored(usable(vectors, id_column, vector_column), "vectors")
    fitted = fit(rows, list_size, margin, k, recall)
    if fitted is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    graph, greatest, prune = fitted

    def read_by(points: np.ndarray) -> list[np.ndarray]:
        return graph.lists_to_read(np.concatenate([points, np.zeros((len(points), 1))], axis=1), prune, least_probes)

    def everywhere(points: np.ndarray) -> list[np.ndarray]:
        return [np.arange(len(graph.centroids), dtype=np.int32)] * len(points)

    lists = len(graph.centroids)
    parts = np.maximum(np.ceil(2 * graph.shares * rows.count() / DEALT), 1).astype(np.int64)
    queries = rows.where(F.pmod("vec_id", F.lit(every)) == 0)
    held = stored(_held(rows, lambda points: graph.lists_to_hold(lifted(points, greatest), margin), parts), "posting-lists")
    ranked = _in_passes(stored(_asked(queries, read_by, lists), "list-queries"), held, k)
    full = ranked.where(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = stored(queries.join(full, "vec_id", "left_anti"), "short-queries")
    if short.isEmpty():
        return ranked
    again = _in_passes(stored(_asked(short, everywhere, lists), "list-queries"), held, k)
    return ranked.join(full.withColumnRenamed("vec_id", "query_id"), "query_id", "left_semi").unionByName(again).select("query_id", "rank", "vec_id", "score")
