"""Toxicity by cumulative-link ordinal regression on sparse text features.

Features are the rates of hashed word cores (runs of letters and digits, lower-cased) and of their first
four to seven bytes, as stems carry the meaning of inflected words, each scaled by how well it tells toxic
from clean documents among the labelled ones. One weight per feature is shared by all
thresholds: ``P(grade > k) = sigmoid(w.x - theta_k)`` with ascending ``theta``; the expected severity is the
sum of these probabilities.

Labels tell toxic from clean only. Grades are 0 for clean documents, and 1 to 3 for thirds of the toxic
ones by the rate of features that are typical of them. The model is fitted on all labelled documents; a fifth of the clean
ones is held out to place the rejection cut, so that clean documents stay. Every whole text is scored.

Features of the labelled documents are stored once, in few bytes. Each step of the fit is a pass over them: one task per core returns
a vector of the model's size, added up by a few tasks, and the driver holds the model alone.

Defined cases: a NULL text or one without word cores has ``x = 0``; rows are scored one by one, so repeated rows get the
same score; without labels of both kinds nothing is rejected and severities are 0; other columns are untouched.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflux.llm.labelled import judged, quantile, value_at
from cardflux.llm.store import collected, discard, require, stored
from cardflux.llm.textbytes import LOWER, Ranges, split_ranges, text_slices

BUCKETS = 1 << 18
PREFIXES = (4, 5, 6, 7)
GRADES = 4
#: Rates are small numbers; this brings them to about one.
SCALE = 50.0
#: Features seen in fewer labelled documents carry no weight.
LEAST_DOCUMENTS = 5
#: Share of held-out clean documents that may lie above the rejection cut.
CLEAN_LOSS = 0.001
#: Steps of the fit, and how many earlier ones each remembers.
STEPS = 40
MEMORY = 10
#: Tasks that add up the vectors of all others, and features that a task unpacks at once.
ADDERS = 4
UNPACKED = 400_000
CORE = np.zeros(256, bool)
CORE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def features(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and text number of every feature occurrence, and the number of word cores per text."""
    lower = LOWER[data]
    starts, ends = split_ranges(~CORE[lower], bounds)
    ranges = Ranges(lower)
    text = np.searchsorted(bounds, starts, "right") - 1
    buckets, owners = [ranges.hash(starts, ends)], [text]
    for size in PREFIXES:
        longer = ends - starts > size
        buckets.append(ranges.hash(starts[longer], starts[longer] + size) ^ np.uint64(size))
        owners.append(text[longer])
    counts = np.bincount(text, minlength=len(bounds) - 1)
    return (np.concatenate(buckets) % np.uint64(BUCKETS)).astype(np.int64), np.concatenate(owners), counts


@dataclass
class Model:
    weights: np.ndarray
    thetas: np.ndarray
    cut: float

    def expected_severity(self, linear: np.ndarray) -> np.ndarray:
        return sigmoid(linear[:, None] - self.thetas).sum(axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def narrow(values: np.ndarray) -> bytes:
    """Non-negative numbers in one, two or four bytes each, as the greatest of them needs."""
    greatest = values.max(initial=0)
    return values.astype("<u1" if greatest < 1 << 8 else "<u2" if greatest < 1 << 16 else "<u4").tobytes()


def widened(packed: pa.Scalar, n: int) -> np.ndarray:
    """The ``n`` numbers that :func:`narrow` packed."""
    data = packed.as_buffer()
    return np.frombuffer(data, f"<u{data.size // n}" if n else "<u1")


def _stored_features(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``toxic, held_out, n, n_features, gaps, times`` of every labelled document: distances between its ascending buckets, and their occurrences."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_slices(batches):
            buckets, owners, counts = features(data, bounds)
            pairs, times = np.unique(owners * BUCKETS + buckets, return_counts=True)
            first = np.searchsorted(pairs, np.arange(len(counts) + 1) * BUCKETS)
            gaps = [narrow(np.diff(pairs[a:b] % BUCKETS, prepend=0)) for a, b in zip(first[:-1], first[1:])]
            packed = [narrow(times[a:b]) for a, b in zip(first[:-1], first[1:])]
            numbers = [pa.array(counts.astype(np.int64)), pa.array(np.diff(first).astype(np.int64))]
            kinds = [rows.column("toxic"), rows.column("held_out")]
            yield pa.RecordBatch.from_arrays([*kinds, *numbers, pa.array(gaps, pa.binary()), pa.array(packed, pa.binary())], names=["toxic", "held_out", "n", "n_features", "gaps", "times"])

    known = judged(labels).select(F.col("doc_id").alias("_labelled_id"), (F.col("toxic") > 0).alias("toxic")).hint("merge")
    labelled = require(docs, ["doc_id", "text"]).join(known, F.col("doc_id") == F.col("_labelled_id"))
    held_out = (F.pmod("doc_id", F.lit(5)) == 0) & ~F.col("toxic")
    return labelled.select("text", "toxic", held_out.alias("held_out")).mapInArrow(extract, "toxic boolean, held_out boolean, n long, n_features long, gaps binary, times binary")


@dataclass
class Unpacked:
    """Some documents: per document its kind, per feature its document, bucket and rate."""

    toxic: np.ndarray
    held_out: np.ndarray
    row: np.ndarray
    bucket: np.ndarray
    rate: np.ndarray


def _unpack(batches: Iterator[pa.RecordBatch], limit: int = 0) -> Iterator[Unpacked]:
    """Documents of about ``limit`` features together, by default ``UNPACKED``; one with more comes by itself."""
    for batch in batches:
        n_features = batch.column(batch.schema.get_field_index("n_features")).to_numpy()
        sums = np.concatenate([[0], np.cumsum(n_features)])
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sums, sums[start] + (limit or UNPACKED), "right")) - 1)
            part, sizes = batch.slice(start, end - start), n_features[start:end]
            start = end
            column = {name: part.column(i) for i, name in enumerate(batch.schema.names)}
            gaps, times = [[widened(v, n) for v, n in zip(column[name], sizes)] for name in ("gaps", "times")]
            row = np.repeat(np.arange(len(sizes)), sizes)
            total = np.concatenate([[0], np.cumsum(np.concatenate(gaps).astype(np.int64))])
            bucket = total[1:] - total[np.cumsum(sizes) - sizes][row]
            kinds = [column[name].to_numpy(zero_copy_only=False).astype(bool) for name in ("toxic", "held_out")]
            n = np.maximum(1, column["n"].to_numpy())
            yield Unpacked(*kinds, row, bucket, np.concatenate(times) / n[row])


def _in_few_tasks(rows: DataFrame) -> DataFrame:
    """A task per core: each sends a vector of the model's size, however few documents it has."""
    return rows.coalesce(rows.sparkSession.sparkContext.defaultParallelism)


def _added(rows: DataFrame, measure: Callable[..., np.ndarray], width: int, *given) -> np.ndarray:
    """The sum of a vector over all documents. Vectors are added in the order of their bytes, so that a repeated task adds alike.

    ``given`` goes to ``measure`` as a broadcast that ends with the pass: Spark keeps on every disk what a function carries by itself.
    """
    shared = rows.sparkSession.sparkContext.broadcast(given)

    def measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(width)
        for part in _unpack(batches):
            total += measure(part, *shared.value)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = sorted(v.as_py() for batch in batches for v in batch.column(0))
        total = sum((np.frombuffer(v) for v in vectors), np.zeros(width))
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["vector"])

    sums = _in_few_tasks(rows).mapInArrow(measured, "vector binary").repartition(ADDERS).mapInArrow(add, "vector binary")
    try:
        return sum((np.frombuffer(v) for v in sorted(bytes(row[0]) for row in collected(sums))), np.zeros(width))
    finally:
        shared.destroy()


def _measured(rows: DataFrame, condition: str, measure: Callable[[Unpacked], np.ndarray]) -> DataFrame:
    """``value``, a number per document that meets ``condition``, stored."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _unpack(batches):
            yield pa.RecordBatch.from_arrays([pa.array(measure(part).astype(np.float64))], names=["value"])

    return stored(rows.where(condition).mapInArrow(run, "value double"), "toxicity-values")


def typical_of_toxic(seen_toxic: np.ndarray, seen_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Whether each bucket is much more frequent in toxic documents, by the documents of either kind that hold it."""
    ratio = ((seen_toxic + 0.5) / (toxic + 1)) / ((seen_clean + 0.5) / (clean + 1))
    return (ratio > 8) & (seen_toxic + 0.5 > LEAST_DOCUMENTS)


def density(part: Unpacked, typical: np.ndarray) -> np.ndarray:
    return np.bincount(part.row, np.where(typical[part.bucket], part.rate, 0), len(part.toxic))


def grades_of(part: Unpacked, typical: np.ndarray, cuts: list[float]) -> np.ndarray:
    """0 for clean documents, 1 to 3 for toxic ones by their rate of typical features."""
    return np.where(part.toxic, 1 + np.searchsorted(cuts, density(part, typical), "right"), 0)


def separation(seen_toxic: np.ndarray, seen_clean: np.ndarray, toxic: int, clean: int) -> np.ndarray:
    """Squared log odds of each bucket between the two kinds of documents, so that features that tell them apart are large."""
    return (np.log((seen_toxic + 1) / (toxic + 2)) - np.log((seen_clean + 1) / (clean + 2))) ** 2 / 4


def thetas_of(free: np.ndarray) -> np.ndarray:
    return free[0] + np.concatenate([[0], np.cumsum(np.exp(np.clip(free[1:], -20, 20)))])


def loss_and_gradient(w: np.ndarray, free: np.ndarray, n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The loss summed over ``n`` documents, then its slopes by weights and by free threshold parameters."""
    thetas = thetas_of(free)
    linear = np.bincount(row, value * w[column], n)
    above = sigmoid(linear[:, None] - thetas)  # P(grade > k)
    padded = np.concatenate([np.ones((n, 1)), above, np.zeros((n, 1))], axis=1)
    at = np.arange(n)
    chance = np.maximum(padded[at, grade] - padded[at, grade + 1], 1e-9)
    slope = np.concatenate([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))], axis=1)
    by_linear = (slope[at, grade] - slope[at, grade + 1]) / chance
    level = np.arange(GRADES - 1)
    by_theta = (np.where(grade[:, None] == level, slope[:, 1:-1], 0) - np.where(grade[:, None] - 1 == level, slope[:, 1:-1], 0)) / chance[:, None]
    tails = np.cumsum(by_theta.sum(axis=0)[::-1])[::-1]
    return np.concatenate([[-np.log(chance).sum()], -np.bincount(column, value * by_linear[row], len(w)), [-tails[0]], -tails[1:] * np.exp(np.clip(free[1:], -20, 20))])


def minimise(evaluate: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, steps: int) -> np.ndarray:
    """L-BFGS: each step takes one evaluation, and more only where the loss did not fall."""
    loss, slope = evaluate(x)
    pairs: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(steps):
        direction, factors = slope.copy(), []
        for s, y in reversed(pairs):
            factors.append((s @ direction) / (s @ y))
            direction -= factors[-1] * y
        if pairs:
            s, y = pairs[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(1.0, np.linalg.norm(direction))
        for (s, y), factor in zip(pairs, reversed(factors)):
            direction += s * (factor - (y @ direction) / (s @ y))
        size = 1.0
        for _ in range(8):
            there = x - size * direction
            next_loss, next_slope = evaluate(there)
            if next_loss <= loss - 1e-4 * size * (slope @ direction):
                break
            size /= 4
        else:
            return x
        s, y = there - x, next_slope - slope
        if s @ y > 1e-12 * (y @ y):
            pairs = [*pairs, (s, y)][-MEMORY:]
        done = loss - next_loss < 1e-4 * abs(loss)
        x, loss, slope = there, next_loss, next_slope
        if done:
            return x
    return x


START = (2.0, 0.0, 0.0)[: GRADES - 1]  # theta_0, then logs of the steps between thetas


def ordinal_regression(n: int, row: np.ndarray, column: np.ndarray, value: np.ndarray, width: int, grade: np.ndarray, steps: int = 250, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds of the cumulative-link model, for documents at hand."""
    squares = np.bincount(column, value**2, width)
    return _fitted(lambda w, free: loss_and_gradient(w, free, n, row, column, value, grade), n, squares, steps, penalty)


def _fitted(summed: Callable[[np.ndarray, np.ndarray], np.ndarray], n: int, squares: np.ndarray, steps: int = STEPS, penalty: float = 1e-4) -> tuple[np.ndarray, np.ndarray]:
    """The fit of one weight per entry of ``squares``, the summed squares of its values, which put all weights on one scale."""
    width = len(squares)
    unit = 1 / np.sqrt(squares / (4 * n) + penalty)

    def evaluate(x: np.ndarray) -> tuple[float, np.ndarray]:
        w = x[:width] * unit
        total = summed(w, x[width:]) / n
        total[1 : width + 1] = (total[1 : width + 1] + penalty * w) * unit
        return total[0] + penalty / 2 * (w @ w), total[1:]

    x = minimise(evaluate, np.concatenate([np.zeros(width), START]), steps)
    return x[:width] * unit, thetas_of(x[width:])


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on all labelled documents; a fifth of the clean ones is held out and places the cut."""
    nothing = Model(np.zeros(BUCKETS, np.float32), np.full(GRADES - 1, 40.0), np.inf)
    rows = stored(_stored_features(docs, labels), "toxicity-features", "zstd")

    def seen(part: Unpacked) -> np.ndarray:
        kinds = [part.toxic, ~part.toxic & ~part.held_out, part.held_out]
        squares = np.bincount(part.bucket, np.where(part.held_out[part.row], 0, part.rate**2), BUCKETS)
        return np.concatenate([*[np.bincount(part.bucket[kind[part.row]], minlength=BUCKETS) for kind in kinds], squares, [kind.sum() for kind in kinds]])

    counted = _added(rows, seen, 4 * BUCKETS + 3)
    in_toxic, in_clean, in_held_out, squares = counted[:-3].reshape(4, BUCKETS)
    toxic, clean, held_out = [int(count) for count in counted[-3:]]
    if not toxic or not clean + held_out:
        return nothing
    often = in_toxic + in_clean + in_held_out >= min(LEAST_DOCUMENTS, max(1, (toxic + clean + held_out) // 40))
    columns = np.flatnonzero(often)
    place = np.full(BUCKETS, -1, np.int32)
    place[columns] = np.arange(len(columns))
    typical = typical_of_toxic(in_toxic, in_clean + in_held_out, toxic, clean + held_out)
    densities = _measured(rows, "toxic", lambda part: density(part, typical))
    thirds = [-(-toxic * part // (GRADES - 1)) for part in range(1, GRADES - 1)]
    cuts = [value_at(densities, "value", rank, toxic) if rank < toxic else np.inf for rank in thirds]
    scale = (separation(in_toxic, in_clean, toxic, clean) * SCALE)[columns]

    def slopes(part: Unpacked, w: np.ndarray, free: np.ndarray, typical: np.ndarray, cuts: list[float], often: np.ndarray, place: np.ndarray, scale: np.ndarray) -> np.ndarray:
        grade = grades_of(part, typical, cuts)
        used = often[part.bucket] & ~part.held_out[part.row]
        renumber = np.cumsum(~part.held_out) - 1
        column = place[part.bucket[used]]
        return loss_and_gradient(w, free, int((~part.held_out).sum()), renumber[part.row[used]], column, part.rate[used] * scale[column], grade[~part.held_out])

    def summed(w: np.ndarray, free: np.ndarray) -> np.ndarray:
        return _added(fitting, slopes, 1 + len(w) + len(free), w, free, typical, cuts, often, place, scale)

    fitting = rows.where("not held_out")
    w, thetas = _fitted(summed, toxic + clean, squares[columns] * scale**2)
    weights = np.zeros(BUCKETS, np.float32)
    weights[columns] = w * scale / SCALE
    model = Model(weights, thetas, 0.5)
    condition, n = ("held_out", held_out) if held_out else ("not toxic", clean)
    severities = _measured(rows, condition, lambda part: model.expected_severity(np.bincount(part.row, part.rate * SCALE * weights[part.bucket], len(part.toxic))))
    # A value is known to within a step of fixed point; the documents at the cut stay.
    model.cut = max(0.5, quantile(severities, "value", 1 - CLEAN_LOSS, n) + 2.0**-24)
    discard(rows, densities, severities)
    return model


def severity(text: Column, model: Model) -> Column:
    """Struct of ``expected_severity`` and ``rejected`` for a text column."""
    shared = (model.weights, model.thetas, model.cut)

    @F.arrow_udf("struct<expected_severity: double, rejected: boolean>")
    def score(texts: pa.Array) -> pa.Array:
        own = Model(*shared)
        parts = [np.zeros(0)]
        for _, data, bounds in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            buckets, owners, counts = features(data, bounds)
            linear = np.bincount(owners, own.weights[buckets].astype(np.float64), len(counts)) * SCALE / np.maximum(counts, 1)
            parts.append(own.expected_severity(linear))
        expected = np.concatenate(parts)
        return pa.StructArray.from_arrays([pa.array(expected), pa.array(expected > own.cut)], names=["expected_severity", "rejected"])

    return score(text)


def graded(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, expected_severity, rejected`` of every document."""
    scored = require(docs, ["doc_id", "text"]).select("doc_id", severity(F.col("text"), model).alias("scored"))
    return scored.select("doc_id", "scored.expected_severity", "scored.rejected")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that are not rejected, with all their columns."""
    return docs.where(~severity(docs["text"], model)["rejected"])
