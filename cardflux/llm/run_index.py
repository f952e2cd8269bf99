"""Exact repeated-substring removal with a run-length index.

Every byte that a 200-byte string covers which also starts anywhere else in the corpus is removed. The work
is dealt out by content. A 200-byte window is represented by the least hash among its 32-byte grams, so equal
windows name the same anchor gram at the same place in them. Neighbouring windows with one anchor form a fragment, 170 windows at
most. Fragments whose anchor occurs once hold nothing repeated. If all fragments of an anchor are equal,
their windows are all repeated. For the rest, the distinct fragments of an anchor are concatenated and indexed:

* the Burrows-Wheeler transform is cut into runs, and only suffix-array samples at run heads are kept, with
  the sample of the preceding run's end;
* within a stretch of the text between two sampled positions, the preceding suffix moves along with the
  position and the match length falls by one per byte, so matching statistics are streamed sample by
  sample, and the windows with a match of 200 bytes or more are ranges at the start of each stretch.

Anchors with more distinct fragments than ``MOST_INDEXED`` are too much for one task; their windows are compared through
a grouped table of window hashes instead, which combines before the shuffle and has no bound on a group.
The index compares bytes; "all equal" and the grouped table rest on two independent 64-bit hashes, and rows are told apart
by a 64-bit hash of id and text.

Defined cases: a NULL text is empty; texts under 200 bytes lose nothing; repeated rows, with the same or
another ``doc_id``, count as other places and lose what they share; a NULL ``doc_id`` is kept as it is; other
columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.store import discard, require, stored
from cardflux.llm.textbytes import Ranges, text_slices

LENGTH = 200
GRAM = 32
#: Distinct fragments of one anchor that one index may hold (about 2 MB of text).
MOST_INDEXED = 8_000
#: Text that one index takes, from as many anchors as fit.
INDEX_BYTES = 400_000
#: Longer texts are cut into overlapping stretches, which only bounds memory.
STRETCH = 1 << 22
PLACES = 24
OCCURRENCE = "uid long, anchor long, fragment long, start long, windows int"


def _stretches(data: np.ndarray, bounds: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """Bytes, bounds and first position; a long text in stretches that share ``length - 1`` bytes."""
    if len(bounds) != 2 or len(data) <= STRETCH:
        yield data, bounds, 0
        return
    for begin in range(0, len(data), STRETCH):
        part = data[begin : begin + STRETCH + length - 1]
        if begin == 0 or len(part) >= length:
            yield part, np.array([0, len(part)]), begin


def fragments(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Text number, first window, number of windows, anchor hash and content hash of each fragment."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(5))
    n = len(data)
    if n < length:
        return nothing
    ends = np.repeat(bounds[1:], np.diff(bounds))
    ranges = Ranges(data)
    at = np.arange(n - gram + 1)
    hashes = ranges.hash(at, at + gram)
    low = np.uint64((1 << PLACES) - 1)
    least = (hashes & ~low) | at.astype(np.uint64)
    least[at + gram > ends[at]] = np.uint64(0xFFFFFFFFFFFFFFFF)
    width, span = 1, length - gram + 1
    while 2 * width <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if span > width:
        least = np.minimum(least[: width - span], least[span - width :])
    valid = np.arange(len(least)) + length <= ends[: len(least)]
    place = (least & low).astype(np.int64)
    place[~valid] = -1
    heads = np.flatnonzero(valid & np.concatenate([[True], place[1:] != place[:-1]]))
    if not len(heads):
        return nothing
    stops = np.flatnonzero(valid & np.concatenate([place[1:] != place[:-1], [True]]))
    windows = stops - heads + 1
    content = ranges.hash(heads, stops + length)
    text = np.searchsorted(bounds, heads, "right") - 1
    return text, heads - bounds[text], windows, hashes[place[heads]].astype(np.int64), content.astype(np.int64)


def _identified(docs: DataFrame) -> DataFrame:
    """Documents with ``uid``, which tells rows apart unless they are alike in id and text."""
    own = require(docs, ["doc_id", "text"])
    return own.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("uid"))


def occurrences(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_slices(batches):
            for part, part_bounds, begin in _stretches(data, bounds, length):
                text, start, windows, anchor, content = fragments(part, part_bounds, length, gram)
                take = pa.array(text)
                columns = [rows.column("uid").take(take), pa.array(anchor), pa.array(content), pa.array(start + begin), pa.array(windows.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(columns, names=["uid", "anchor", "fragment", "start", "windows"])

    return _identified(docs).select("uid", "text").mapInArrow(find, OCCURRENCE)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """By prefix doubling; the last symbol of the text is unique."""
    n = len(symbols)
    bits = int(symbols.max()).bit_length() if n else 1
    width = max(1, 62 // max(1, bits))
    width = 1 << (width.bit_length() - 1)
    padded = np.concatenate([symbols, np.zeros(width, np.int64)])
    key = np.zeros(n, np.int64)
    for j in range(width):
        key = (key << bits) | padded[j : j + n]
    while True:
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        new = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = new
        if n == 0 or new[-1] == n - 1:
            return order
        key = rank * (n + 1)
        key[: n - width] += rank[width:] + 1
        width *= 2


class RunIndex:
    """Samples of a text's suffix array at the run heads of its Burrows-Wheeler transform."""

    def __init__(self, symbols: np.ndarray):
        order = suffix_array(symbols)
        before = symbols[order - 1]  # the transform; position 0 is preceded by the text's unique end
        heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        place = order[heads]
        previous = order[np.maximum(heads - 1, 0)]
        by_place = np.argsort(place)
        self.symbols = symbols
        self.places, self.previous = place[by_place], previous[by_place]
        self.matches = self._match(self.places, self.previous)
        self.matches[self.places == order[0]] = 0

    def _match(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Length of the common start of the suffixes at ``x`` and ``y``, pair by pair."""
        out = np.zeros(len(x), np.int64)
        active = np.flatnonzero(x != y)
        padded = np.concatenate([self.symbols, [-1]])
        n = len(self.symbols)
        while len(active):
            a, b = np.minimum(x[active] + out[active], n), np.minimum(y[active] + out[active], n)
            active = active[(padded[a] == padded[b]) & (a < n) & (b < n)]
            out[active] += 1
        return out

    def repeated(self, length: int) -> np.ndarray:
        """For each position, whether the string of ``length`` symbols there starts anywhere else, too."""
        stretch = np.diff(np.append(self.places, len(self.symbols)))
        reach = np.minimum(np.maximum(self.matches - length + 1, 0), stretch)
        change = np.zeros(len(self.symbols) + 1, np.int64)
        for begin in (self.places, self.previous):
            np.add.at(change, begin, reach > 0)
            np.subtract.at(change, begin + reach, reach > 0)
        return np.cumsum(change)[:-1] > 0


def repeated_windows(texts: list[bytes], length: int) -> list[np.ndarray]:
    """For each text, flags of its windows of ``length`` bytes that occur twice or more in all of them."""
    count = len(texts)
    sizes = np.array([len(t) for t in texts])
    begins = np.cumsum(sizes + 1) - sizes - 1
    symbols = np.empty(int(sizes.sum()) + count, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[begins + sizes] = False
    symbols[inside] = np.frombuffer(b"".join(texts), np.uint8).astype(np.int64) + count + 1
    symbols[begins + sizes] = np.arange(count) + 1  # each text ends in a symbol of its own
    flags = RunIndex(symbols).repeated(length)
    return [flags[b : b + max(0, s - length + 1)] for b, s in zip(begins, sizes)]


def runs_of(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and one past last place of each run of true flags."""
    change = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return np.flatnonzero(change == 1), np.flatnonzero(change == -1)


def _indexed(contents: DataFrame, length: int) -> DataFrame:
    """``anchor, fragment, lows, highs``: repeated windows of the fragments, anchor by anchor."""

    def flush(held: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        found = [runs_of(f) for f in repeated_windows([content for *_, content in held], length)] if held else []
        columns = [
            pa.array([h[0] for h in held], pa.int64()),
            pa.array([h[1] for h in held], pa.int64()),
            pa.array([low for low, _ in found], pa.list_(pa.int64())),
            pa.array([high for _, high in found], pa.list_(pa.int64())),
        ]
        return pa.RecordBatch.from_arrays(columns, names=["anchor", "fragment", "lows", "highs"])

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for anchor, fragment, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fragment", "content"))):
                if anchor != last and size >= INDEX_BYTES:
                    yield flush(held)
                    held, size = [], 0
                held.append((anchor, fragment, content))
                size, last = size + len(content), anchor
        yield flush(held)

    together = contents.repartition("anchor").sortWithinPartitions("anchor", "fragment")
    return together.mapInArrow(index, "anchor long, fragment long, lows array<long>, highs array<long>")


def _grouped(contents: DataFrame, length: int) -> DataFrame:
    """The same for anchors with very many fragments, through a table of window hashes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for anchor, fragment, content in zip(*(batch.column(c).to_pylist() for c in ("anchor", "fragment", "content"))):
                data = np.frombuffer(content, np.uint8)
                at = np.arange(len(data) - length + 1)
                hashes = Ranges(data).hash(at, at + length).astype(np.int64)
                columns = [pa.array(np.full(len(at), anchor)), pa.array(np.full(len(at), fragment)), pa.array(at), pa.array(hashes)]
                yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fragment", "low", "window"])

    windows = stored(contents.mapInArrow(spread, "anchor long, fragment long, low long, window long"), "windows")
    twice = windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("anchor", "window")
    hits = windows.join(twice, ["anchor", "window"])
    lists = hits.groupBy("anchor", "fragment").agg(F.array_sort(F.collect_set("low")).alias("lows"))
    return lists.select("anchor", "fragment", "lows", F.transform("lows", lambda x: x + 1).alias("highs"))


def _contents(docs: DataFrame, wanted: DataFrame, length: int) -> DataFrame:
    """``anchor, fragment, content`` of the wanted fragments (``uid, anchor, fragment, start, windows``)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_slices(batches):
            raw = data.tobytes()
            out: list[tuple[int, int, bytes]] = []
            for begin, places in zip(bounds.tolist(), rows.column("places").to_pylist()):
                for p in places:
                    low = begin + p["start"]
                    out.append((p["anchor"], p["fragment"], raw[low : low + p["windows"] + length - 1]))
            columns = [pa.array([o[i] for o in out], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.binary()))]
            yield pa.RecordBatch.from_arrays(columns, names=["anchor", "fragment", "content"])

    places = wanted.groupBy("uid").agg(F.collect_list(F.struct("anchor", "fragment", "start", "windows")).alias("places"))
    found = _identified(docs).join(places, "uid").select("text", "places")
    return found.mapInArrow(cut, "anchor long, fragment long, content binary")


def repeated_ranges(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """``uid, low, high``: byte ranges of each document's windows that start elsewhere, too.

    ``low`` is the first byte of the range's first window, ``high`` that of its last window plus one.
    """
    occurring = stored(occurrences(docs, length, gram), "fragments")
    anchors = occurring.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"), F.min("fragment").alias("x"), F.max("fragment").alias("y"))
    shared = anchors.where("n > 1").select("anchor", (F.col("x") == F.col("y")).alias("alike"))
    repeated = stored(occurring.join(shared, "anchor"), "shared-fragments")
    discard(occurring)
    alike = repeated.where("alike").select("uid", F.col("start").alias("low"), (F.col("start") + F.col("windows")).alias("high"))
    mixed = repeated.where("not alike")
    first = F.min(F.struct("uid", "start", "windows"))
    distinct = stored(mixed.groupBy("anchor", "fragment").agg(F.count(F.lit(1)).alias("n"), first.alias("one")), "distinct-fragments")
    kinds = distinct.groupBy("anchor").agg((F.count(F.lit(1)) > most_indexed).alias("many"))
    wanted = distinct.join(kinds, "anchor").select("anchor", "fragment", "many", "one.*")
    few = _contents(docs, wanted.where("not many").drop("many"), length)
    results = _indexed(few, length)
    heavy = stored(wanted.where("many").drop("many"), "heavy-fragments")
    if not heavy.isEmpty():
        results = results.unionByName(_grouped(_contents(docs, heavy, length), length))
    judged = stored(distinct.select("anchor", "fragment", (F.col("n") > 1).alias("whole")).join(results, ["anchor", "fragment"], "left"), "judged-fragments")
    placed = mixed.join(judged, ["anchor", "fragment"])
    whole = placed.where("whole").select("uid", F.col("start").alias("low"), (F.col("start") + F.col("windows")).alias("high"))
    part = placed.where("not whole and size(lows) > 0").select("uid", "start", F.explode(F.arrays_zip("lows", "highs")).alias("r"))
    part = part.select("uid", (F.col("start") + F.col("r.lows")).alias("low"), (F.col("start") + F.col("r.highs")).alias("high"))
    return alike.unionByName(whole).unionByName(part)


def without_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most_indexed: int = MOST_INDEXED) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept_text`` of every document.

    ``kept_text`` is the remaining text; where a cut falls into a character, its bytes are replaced.
    """

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, bounds in text_slices(batches):
            change = np.zeros(len(data) + 1, np.int64)
            for column, sign, more in (("lows", 1, 0), ("highs", -1, length - 1)):
                lists = rows.column(column)
                counts = np.array([len(x) if x is not None else 0 for x in lists.to_pylist()], np.int64)
                flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                np.add.at(change, flat + np.repeat(bounds[:-1], counts) + more, sign)
            gone = np.cumsum(change)[:-1] > 0
            kept = [data[a:b][~gone[a:b]].tobytes() for a, b in zip(bounds[:-1], bounds[1:])]
            spans = [len(runs_of(gone[a:b])[0]) for a, b in zip(bounds[:-1], bounds[1:])]
            sizes = np.diff(bounds)
            columns = [
                rows.column("doc_id").cast(pa.int64()),
                pa.array(sizes),
                pa.array(sizes - np.array([len(k) for k in kept], np.int64)),
                pa.array(spans, pa.int64()),
                pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                pa.array([k.decode("utf-8", "replace") for k in kept], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"])

    ranges = stored(repeated_ranges(docs, length, gram, most_indexed), "repeated-ranges")
    lists = ranges.groupBy("uid").agg(F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs"))
    joined = _identified(docs).join(lists, "uid", "left").select("doc_id", "text", "lows", "highs")
    return joined.mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept_text string")
