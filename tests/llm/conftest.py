import random

import pytest

from cardflux.llm.shipping import ship

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, uid string, node int, bucket string, hub double, anchor string"


@pytest.fixture(scope="session")
def shipped(spark):
    return ship(spark)


@pytest.fixture
def table_of(shipped):
    """Documents from (doc_id, text) pairs, with further columns whose names the operators use inside."""

    def build(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), "u", 1, None, 0.5, "a") for i, t in pairs]
        return shipped.createDataFrame(rows, COLUMNS).repartition(3)

    return build


def words(seed, n):
    draw = random.Random(seed)
    return [f"w{draw.randrange(4000)}" for _ in range(n)]


@pytest.fixture(scope="session")
def odd_pairs():
    """Near and exact copies, shared passages, repeated rows, NULLs, empty, short and long texts."""
    base, passage = words(1, 120), " ".join(words(2, 70))
    near = base.copy()
    near[60] = "changed"
    return [
        (1, " ".join(base)),
        (2, " ".join(base).upper()),
        (3, " ".join(near)),
        (4, " ".join(words(3, 80)) + " " + passage + " " + " ".join(words(4, 80))),
        (5, " ".join(words(5, 90)) + "\n" + passage),
        (6, None),
        (7, ""),
        (8, " \n\t "),
        (9, "three little words"),
        (9, "three little words"),
        (10, "Three little words"),
        (None, " ".join(words(6, 60))),
        (11, " ".join(words(7, 20_000))),
        (12, "é ☃ 😀 ñandú\n\n  don't <b>x</b>  " * 9),
        (13, "spam " * 400),
        (14, "same line of text here\n" * 40),
    ]
