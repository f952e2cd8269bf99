"""Hard negatives for anchors: rows of another label that score nearly as high as a positive, but not higher.

Vectors become integers (``floor(256 x)``), so every score is exact. A fixed rotation (random signs, then a Hadamard
transform) spreads a vector over its coordinates. Its code is the sign of each coordinate, stored with the
alignment of code and vector; what the code leaves over is rotated and coded again, ``STAGES`` times, and the length left over after each
stage is stored, too. For an anchor, quantised to ``PLANES`` bit planes, bit counts of code and planes give each code's inner
product. With the alignments they estimate the score, and Cauchy-Schwarz on the two parts that the code does not see
(what is left of the row, and the anchor orthogonal to the code) bounds the error, with the quantisation's own bound added. These
intervals hold always, so they decide who can still be among the first of a band; stage by stage fewer rows
are left, and those that survive the last one are scored in integers.

Anchors meet all rows in blocks: rows are dealt by hash into groups of ``GROUP`` at most, on average, and each anchor goes to every
group. A task holds one group at a time and lets the anchors stream past it. A first pass finds the
positives, a second one the negatives in the positives' bands; per anchor and group only the first few leave the task.

Defined cases: rows with a NULL id or label, a NULL vector, or NULL or non-finite components take no part, nor do rows whose
squared length in integers reaches 2**62; vectors of different length have no score; rows alike in id, label and vector are
one row, others that share an id are rows of their own, ordered by a digest after their id; a positive with a negative score
has no negatives, as its band is empty; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflux.llm.store import require, stored
from cardflux.llm.textbytes import stream

STAGES = 5
PLANES = 8
GROUP = 65_536
#: Groups of fewer rows than this are not made for the sake of parallel tasks.
SMALL_GROUP = 2_048
TASKS = 64
#: Anchors that are rotated at a time.
ANCHORS = 256
POSITIVES = 5
NEGATIVES = 5
SCALE = 256
LEAST_SHARE = 80


def usable(vectors: DataFrame) -> DataFrame:
    """``vec_id, label, ints, row``: distinct rows that take part, with their changed label, and a digest as identity."""
    rows = require(vectors, ["vec_id", "label", "embedding"])
    rows = rows.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where("vec_id is not null and label is not null and v is not null").where(finite)
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + F.pow(F.lit(float(SCALE)) * x, 2) + F.abs(F.lit(2.0 * SCALE) * x) + 1)
    ints = F.transform("v", lambda x: F.floor(F.lit(float(SCALE)) * x).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    # Rows out of range are dropped before their components are cast.
    small = rows.withColumn("v", F.when(square < 2.0**62, F.col("v"))).where("v is not null")
    return small.select("vec_id", label.alias("label"), ints.alias("ints")).distinct().withColumn("row", F.xxhash64("vec_id", "label", "ints"))


def width(dimensions: int) -> int:
    return max(64, 1 << max(0, dimensions - 1).bit_length())


@lru_cache(maxsize=64)
def signs(stage: int, size: int) -> np.ndarray:
    return np.where(stream(41 + stage, size) >> np.uint64(63), 1.0, -1.0)


def rotated(x: np.ndarray, stage: int) -> np.ndarray:
    """Rows after the signs of a stage and a Hadamard transform, by additions alone, with lengths as before."""
    n, size = x.shape
    x = x * signs(stage, size)
    step = 1
    while step < size:
        x = x.reshape(n, -1, 2, step)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], axis=2).reshape(n, size)
        step *= 2
    return x / np.sqrt(size)


def widened(ints: np.ndarray) -> np.ndarray:
    """Rows with zeros up to the width, as doubles."""
    out = np.zeros((len(ints), width(ints.shape[1])))
    out[:, : ints.shape[1]] = ints
    return out


def codes(ints: np.ndarray, stages: int = STAGES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words (row, stage, word), alignments and lengths left over (row, stage)."""
    left = widened(ints)
    n, size = left.shape
    words, align, rest = np.zeros((n, stages, size // 64), np.uint64), np.zeros((n, stages)), np.zeros((n, stages))
    for stage in range(stages):
        left = rotated(left, stage)
        up = left >= 0
        words[:, stage] = np.packbits(up, axis=1, bitorder="little").view("<u8")
        align[:, stage] = np.abs(left).mean(axis=1)
        left = left - align[:, stage, None] * np.where(up, 1.0, -1.0)
        rest[:, stage] = np.sqrt((left**2).sum(axis=1))
    return words, align, rest


class Query:
    """An anchor's vector, rotated and quantised for one stage: bit planes, and what quantisation leaves out."""

    def __init__(self, z: np.ndarray):
        self.size, self.length, self.low = len(z), float(z @ z), float(z.min())
        self.step = float(z.max() - self.low) / ((1 << PLANES) - 1) or 1.0
        steps = np.rint((z - self.low) / self.step).astype(np.int64)
        self.total = int(steps.sum())
        self.off = float(np.abs(z - (self.low + self.step * steps)).sum())
        self.planes = np.packbits(steps >> np.arange(PLANES)[:, None] & 1, axis=1, bitorder="little").view("<u8")

    def dot(self, words: np.ndarray, ones: np.ndarray) -> np.ndarray:
        """Inner products with codes (word, row) as signs, right to ``off``, from bit counts."""
        counted = np.zeros(words.shape[1], np.int32)
        for plane in self.planes[::-1]:
            counted += counted
            for word, bits in zip(words, plane):
                counted += np.bitwise_count(word & bits)
        return self.low * (2.0 * ones - self.size) + self.step * (2.0 * counted - self.total)


def _matrix(column: pa.Array, rows: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(rows, len(flat) // rows if rows else 0)


def encoded(rows: DataFrame, stages: int = STAGES) -> DataFrame:
    """The rows with ``size`` (of the vector), ``codes``, ``align`` and ``rest``."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("size").to_numpy()
            for size in np.unique(sizes):
                part = batch.filter(pa.array(sizes == size))
                n = part.num_rows
                made = [x.reshape(n, -1) for x in codes(_matrix(part.column("ints"), n), stages)]
                lists = [
                    pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * x.shape[1]), pa.array(x.ravel().view(kind)))
                    for x, kind in zip(made, (np.int64, np.float64, np.float64))
                ]
                columns = [part.column(name) for name in ("vec_id", "label", "ints", "row", "size")]
                yield pa.RecordBatch.from_arrays([*columns, *lists], names=["vec_id", "label", "ints", "row", "size", "codes", "align", "rest"])

    kinds = "vec_id long, label long, ints array<int>, row long, size int, codes array<long>, align array<double>, rest array<double>"
    return rows.withColumn("size", F.size("ints")).select("vec_id", "label", "ints", "row", "size").mapInArrow(encode, kinds)


class Group:
    """One group's rows, as arrays."""

    def __init__(self, parts: list[pa.RecordBatch], stages: int):
        table = pa.Table.from_batches(parts).combine_chunks()
        n = table.num_rows
        self.ids, self.labels, self.rows = (table.column(name).to_numpy() for name in ("vec_id", "label", "row"))
        self.ints = _matrix(table.column("ints").chunk(0), n).astype(np.int64)
        self.floats = self.ints.astype(np.float64)
        self.longest = float(np.sqrt((self.floats**2).sum(axis=1).max(initial=0)))
        words = _matrix(table.column("codes").chunk(0), n).view(np.uint64).reshape(n, stages, -1)
        self.add_codes(words, *(_matrix(table.column(name).chunk(0), n) for name in ("align", "rest")))
        self._of: dict[tuple[int, bool], np.ndarray] = {}

    def add_codes(self, words: np.ndarray, align: np.ndarray, rest: np.ndarray) -> None:
        """Codes by stage and word, alignments and lengths left over by stage."""
        self.codes = np.ascontiguousarray(words.transpose(1, 2, 0))
        self.align, self.rest = align.T.copy(), rest.T.copy()
        self.ones = np.bitwise_count(self.codes).sum(axis=1, dtype=np.int32)

    def scores(self, places: np.ndarray, query: np.ndarray) -> np.ndarray:
        """Integer inner products; in doubles, with whose speed, as long as no sum on the way can leave their exact range."""
        if self.longest * float(np.sqrt(float((query.astype(np.float64) ** 2).sum()))) < 2.0**52:
            return (self.floats[places] @ query.astype(np.float64)).astype(np.int64)
        return self.ints[places] @ query

    def of_label(self, label: int, same: bool) -> np.ndarray:
        """Positions of the rows with this label, or of all others."""
        if (label, same) not in self._of:
            if len(self._of) > 64:
                self._of.clear()
            self._of[label, same] = np.flatnonzero((self.labels == label) == same)
        return self._of[label, same]

    def survivors(self, turned: list[np.ndarray], places: np.ndarray, bands: list[tuple[float, float]], count: int) -> np.ndarray:
        """Those of ``places`` that can be among the first ``count`` with a score in some band (both ends included).

        ``turned`` is the anchor's vector, rotated for each stage.
        """
        estimate, unsure = np.zeros(len(places)), np.zeros(len(places))
        for stage, z in enumerate(turned):
            if len(places) <= count:
                break
            asked = Query(z)
            # Nothing is gathered while nothing was left out.
            here = slice(None) if len(places) == len(self.ids) else places
            align = self.align[stage][here]
            dot = asked.dot(self.codes[stage][:, here], self.ones[stage][here])
            estimate += align * dot
            unsure += align * asked.off
            seen = np.maximum(np.abs(dot) - asked.off, 0) ** 2 / asked.size
            error = unsure + self.rest[stage][here] * np.sqrt(np.maximum(asked.length - seen, 0))
            # Rounding of doubles is far below this.
            error += 1e-9 * (np.abs(estimate) + error) + 1e-3
            least, most = estimate - error, estimate + error
            keep = np.zeros(len(places), bool)
            for bottom, top in bands:
                possible = (most >= bottom) & (least <= top)
                sure = least[(least >= bottom) & (most <= top)]
                if len(sure) > count:
                    possible &= most >= np.partition(sure, len(sure) - count)[len(sure) - count]
                keep |= possible
            places, estimate, unsure = places[keep], estimate[keep], unsure[keep]
        return places

    def first(self, scores: np.ndarray, places: np.ndarray, count: int) -> np.ndarray:
        """Positions in ``places`` of the ``count`` first by score, id and digest."""
        if len(scores) > 4 * count:
            best = np.flatnonzero(scores >= np.partition(scores, len(scores) - count)[len(scores) - count])
        else:
            best = np.arange(len(scores))
        order = np.lexsort((self.rows[places[best]], self.ids[places[best]], -scores[best]))
        return best[order[:count]]


def turned(ints: np.ndarray, stages: int) -> np.ndarray:
    """The rows' vectors rotated for each stage (row, stage, coordinate)."""
    z, out = widened(ints), []
    for stage in range(stages):
        z = rotated(z, stage)
        out.append(z)
    return np.stack(out, axis=1)


def _met(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows of each group, followed by all anchors; both sides of vectors of one length."""
    dealt = rows.withColumns({"g": F.pmod("row", F.lit(groups)).cast("int"), "is_anchor": F.lit(False), "wanted": F.lit(None).cast("array<struct<score:long,vec_id:long,row:long>>")})
    sent = anchors.withColumns({"g": F.explode(F.sequence(F.lit(0), F.lit(groups - 1))), "is_anchor": F.lit(True)})
    for name, kind in (("codes", "array<long>"), ("align", "array<double>"), ("rest", "array<double>")):
        sent = sent.withColumn(name, F.lit(None).cast(kind))
    return dealt.unionByName(sent).repartition(groups, "size", "g").sortWithinPartitions("size", "g", "is_anchor")


def _stream(batches: Iterator[pa.RecordBatch], answer: Callable, names: list[str], stages: int) -> Iterator[pa.RecordBatch]:
    """Hold a group's rows and answer its anchors, batch by batch."""
    key, held, group = None, [], None
    for batch in batches:
        marks = np.stack([batch.column(name).cast(pa.int32()).to_numpy() for name in ("size", "g", "is_anchor")])
        heads = np.flatnonzero(np.concatenate([[True], (marks[:, 1:] != marks[:, :-1]).any(axis=0)])) if batch.num_rows else []
        for head, end in zip(heads, [*heads[1:], batch.num_rows]):
            size, g, is_anchor = marks[:, head]
            if (size, g) != key:
                key, held, group = (size, g), [], None
            part = batch.slice(head, end - head)
            if not is_anchor:
                held.append(part)
            elif held or group:
                if group is None:
                    group, held = Group(held, stages), []
                found = []
                for start in range(0, part.num_rows, ANCHORS):
                    some = part.slice(start, ANCHORS)
                    queries = _matrix(some.column("ints"), some.num_rows).astype(np.int64)
                    anchors = some.select(["vec_id", "label", "row", "wanted"]).to_pylist()
                    found += [line for asked in zip(anchors, queries, turned(queries, stages)) for line in answer(group, *asked)]
                yield pa.RecordBatch.from_arrays([pa.array(column, pa.int64()) for column in (zip(*found) if found else [[]] * len(names))], names=names)


def _schema(names: list[str]) -> str:
    return ", ".join(f"{name} long" for name in names)


def positives(rows: DataFrame, anchors: DataFrame, groups: int, count: int = POSITIVES, stages: int = STAGES) -> DataFrame:
    """``anchor_row, wanted``: the first rows of each anchor's label, others than itself, as (score, vec_id, row)."""
    names = ["anchor_row", "vec_id", "row", "score"]

    def answer(group: Group, anchor: dict, query: np.ndarray, turned: np.ndarray) -> Iterator[tuple]:
        places = group.of_label(anchor["label"], True)
        places = places[group.rows[places] != anchor["row"]]
        places = group.survivors(turned, places, [(-np.inf, np.inf)], count)
        scores = group.scores(places, query)
        for at in group.first(scores, places, count):
            yield anchor["row"], int(group.ids[places[at]]), int(group.rows[places[at]]), int(scores[at])

    found = _met(rows, anchors.withColumn("wanted", F.lit(None).cast("array<struct<score:long,vec_id:long,row:long>>")), groups)
    found = found.mapInArrow(lambda batches: _stream(batches, answer, names, stages), _schema(names))
    rank = F.row_number().over(Window.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id", "row"))
    first = found.withColumn("rank", rank).where(F.col("rank") <= count)
    return first.groupBy("anchor_row").agg(F.collect_list(F.struct("score", "vec_id", "row")).alias("wanted"))


def negatives(rows: DataFrame, anchors: DataFrame, groups: int, count: int = NEGATIVES, least_share: int = LEAST_SHARE, stages: int = STAGES) -> DataFrame:
    """The first rows of other labels in the band of each anchor's positives."""
    names = ["anchor_id", "anchor_row", "positive_id", "positive_row", "positive_score", "negative_id", "negative_row", "negative_score"]

    def answer(group: Group, anchor: dict, query: np.ndarray, turned: np.ndarray) -> Iterator[tuple]:
        wanted = [(p["score"], p["vec_id"], p["row"]) for p in anchor["wanted"] if p["score"] >= 0]
        bands = {score: (-(-least_share * score // 100), score) for score, _, _ in wanted}
        if not bands:
            return
        places = group.survivors(turned, group.of_label(anchor["label"], False), list(bands.values()), count)
        scores = group.scores(places, query)
        for score, positive_id, positive_row in wanted:
            inside = np.flatnonzero((scores >= bands[score][0]) & (scores <= score))
            for at in inside[group.first(scores[inside], places[inside], count)]:
                place = places[at]
                yield anchor["vec_id"], anchor["row"], positive_id, positive_row, score, int(group.ids[place]), int(group.rows[place]), int(scores[at])

    found = _met(rows, anchors, groups).mapInArrow(lambda batches: _stream(batches, answer, names, stages), _schema(names))
    rank = F.row_number().over(Window.partitionBy("anchor_row", "positive_row").orderBy(F.desc("negative_score"), "negative_id", "negative_row"))
    return found.withColumn("rank", rank).where(F.col("rank") <= count)


def hard_negatives(vectors: DataFrame, stages: int = STAGES, group: int = GROUP, small_group: int = SMALL_GROUP) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``; anchors are rows with an id divisible by 100."""
    rows = stored(encoded(usable(vectors), stages), "one-bit-codes")
    n = rows.count()
    groups = max(1, -(-n // group), min(TASKS, -(-n // small_group)))
    anchors = rows.where("vec_id % 100 = 0").select("vec_id", "label", "ints", "row", "size")
    wanted = stored(positives(rows, anchors, groups, stages=stages), "positives")
    asked = anchors.join(wanted.withColumnRenamed("anchor_row", "row"), "row").select("vec_id", "label", "ints", "row", "size", "wanted")
    mined = negatives(rows, asked, groups, stages=stages)
    return mined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), "negative_id", "positive_score", "negative_score")


SQL = """
    WITH v AS (
        SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
               [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS e
        FROM embeddings
        WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    scored AS (
        SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same, CAST(list_inner_product(a.e, r.e) AS BIGINT) AS score
        FROM v a JOIN v r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id AND len(a.e) = len(r.e)),
    positive AS (
        SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scored WHERE same
        QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
    SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER best AS INTEGER) AS rank, n.vec_id AS negative_id, p.positive_score, n.score AS negative_score
    FROM positive p JOIN scored n ON n.anchor_id = p.anchor_id AND NOT n.same AND 80 * p.positive_score <= 100 * n.score AND n.score <= p.positive_score
    WINDOW best AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY n.score DESC, n.vec_id)
    QUALIFY row_number() OVER best <= 5"""
