import math
import random

import numpy as np
import pytest

from cardflux.llm import negatives

COLUMNS = "vec_id long, embedding array<float>, label int, row string, size string, codes int, g string"


def brute(rows):
    """Straight from the definition, over all pairs."""
    kept = set()
    for vec_id, vector, label in rows:
        if None in (vec_id, vector, label) or any(x is None or not math.isfinite(x) for x in vector):
            continue
        floors = tuple(math.floor(256 * float(np.float32(x))) for x in vector)
        kept.add((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, floors))
    out = []
    for anchor in kept:
        if anchor[0] % 100:
            continue
        others = [(-sum(x * y for x, y in zip(r[2], anchor[2])), r[0], r) for r in kept if r != anchor and len(r[2]) == len(anchor[2])]
        for score, positive_id, _ in sorted(o for o in others if o[2][1] == anchor[1])[:5]:
            band = sorted(o for o in others if o[2][1] != anchor[1] and 80 * -score <= 100 * -o[0] <= 100 * -score)
            out += [(anchor[0], positive_id, rank, o[1], -score, -o[0]) for rank, o in enumerate(band[:5], 1)]
    return sorted(out)


def mined(spark, rows, **changes):
    frame = spark.createDataFrame([(i, v, label, "r", "s", 1, "g") for i, v, label in rows], COLUMNS).repartition(3)
    return sorted(tuple(r) for r in negatives.hard_negatives(frame, **changes).collect())


def vectors(seed, n, size, spread=1.0):
    draw = np.random.default_rng(seed)
    middles = draw.normal(size=(6, size))
    points = middles[draw.integers(0, 6, n)] + spread * draw.normal(size=(n, size))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    return [(i, [float(x) for x in np.float32(p)], int(draw.integers(0, 10))) for i, p in enumerate(points)]


@pytest.mark.parametrize(("size", "spread"), [(64, 0.3), (64, 2.0), (7, 1.0), (100, 0.5)])
def test_against_brute_force(shipped, size, spread):
    rows = vectors(size, 900, size, spread)
    got = mined(shipped, rows, group=200, small_group=100)
    assert got == brute(rows) and len(got) > 50


def test_ties_and_copies(shipped):
    """Every third row has the same vector, and each row stands there twice."""
    rows = [(i, rows[0][1] if i % 3 == 0 else v, label) for rows in (vectors(1, 700, 16),) for i, v, label in rows]
    got = mined(shipped, rows * 2, group=100, small_group=50)
    assert got == brute(rows) and got


def test_odd_rows(shipped):
    good = vectors(2, 400, 8)
    odd = [(500, None, 1), (600, [], 2), (601, [], 3), (602, [], 2), (None, good[0][1], 1), (700, good[1][1], None), (800, [None] * 8, 1), (900, [float("nan")] * 8, 1)]
    odd += [(1000, [float("inf")] * 8, 1), (1100, [0.0] * 8, 4), (1101, [0.0] * 8, 4), (1102, [-0.001] * 8, 5), (1200, [1e30] * 8, 1), (1300, [1.0] * 5, 1), (-100, good[5][1], 3)]
    assert mined(shipped, good + odd) == brute(good + [row for row in odd if row[0] != 1200])


def test_large_components_stay_exact(shipped):
    draw = random.Random(6)
    rows = [(i, [float(draw.randrange(-(2**18), 2**18)) for _ in range(9)], draw.randrange(3)) for i in range(300)]
    assert mined(shipped, rows, group=100, small_group=50) == brute(rows)


def test_empty_table(shipped):
    assert mined(shipped, []) == []


def test_intervals_hold_and_leave_few_rows(shipped):
    """No row with a band's score is ever dropped, and most others are."""
    draw = random.Random(5)
    ints = np.array([[draw.randrange(-256, 256) for _ in range(64)] for _ in range(4000)])
    group = object.__new__(negatives.Group)
    group.ids = np.arange(4000)
    group.add_codes(*negatives.codes(ints))
    left = 0
    for query in ints[:20]:
        scores = ints @ query
        low, high = np.sort(scores)[[-60, -10]]
        places = group.survivors(negatives.turned(query[None], negatives.STAGES)[0], np.arange(4000), [(low, high)], 5)
        inside = np.flatnonzero((scores >= low) & (scores <= high))
        assert set(inside[np.argsort(-scores[inside])[:5]]) <= set(places)
        left += len(places)
    assert left < 0.1 * 20 * 4000
