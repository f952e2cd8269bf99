import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest

from cardflux.llm import conversations

COLUMNS = "conv_id long, turn long, role string, text string, rid string, kind string, chunk int, codes string"
LEGAL = {"su", "ua", "au"}
INNER = {"s", "u", "a"}


def after(state, initial):
    """Role initials that the pattern allows so far, or None."""
    return {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}.get((state, initial))


def brute_repair(rows):
    """Cheapest edits and least letters, by looking at every edit of every row."""

    @lru_cache(None)
    def best(i, state, inserted):
        found = [(0, "")] if i == len(rows) and state in ("", "a") else []
        moves = [] if inserted == 2 else [(5, "I", i, r, inserted + 1) for r in "ua"]
        if i < len(rows):
            initial, forced, cut = rows[i]
            moves.append((2, "D", i + 1, "", 0))
            if not forced:
                moves.append((5 * cut, "K", i + 1, initial, 0))
                moves += [(1 + 5 * cut, "R", i + 1, r, 0) for r in "ua"]
        for cost, letter, j, initial, n in moves:
            reached = state if letter == "D" else after(state, initial)
            if reached is not None:
                rest = best(j, reached, n)
                if rest is not None:
                    found.append((cost + rest[0], letter + rest[1]))
        return min(found, default=None)

    return best(0, "", 0)


def brute(table):
    out = []
    for conv in {row[0] for row in table}:
        rows = []
        for _, turn, role, text in (row for row in table if row[0] == conv):
            hit = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            role, text = " " if role is None else role, " " if text is None else text
            if hit:
                text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
                rows += [(turn, "user" if hit == 4 else role, text)] * (2 if hit == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        seen, coded, faults = set(), [], [0, 0, 0]
        for _, role, text in rows:
            shown = re.sub(r"[\x20\x09-\x0D]", "", text)
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                faults[fault] += 1
            coded.append((role[:1], fault in (0, 1), fault == 2))
        cost, audit = brute_repair(coded)
        lines, state, left = [], "", iter(rows)
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else next(left)
            if letter in "IR":
                role = "user" if after(state, "u") else "assistant"
            if letter != "D":
                lines.append(f"{role}:{text}")
                state = after(state, role[:1])
        turns = {turn for turn, _, _ in rows if turn is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in LEGAL for a, b in zip(rows, rows[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *faults, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def got(spark, table, piece):
    frame = spark.createDataFrame([(*row, "r", "k", 1, "c") for row in table], COLUMNS).repartition(3)
    return sorted((tuple(row) for row in conversations.repaired(frame, piece).collect()), key=repr)


def drawn(seed, convs, most):
    draw = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "", "user", "assistant"]
    texts = ["Fine.", "Fine.", "No end", " \t", "", "Was it? ", "Why!\n", "é ☃ 。", "a.b"]
    return [(c, t, draw.choice(roles), draw.choice(texts) if draw.random() < 0.4 else f"Text {draw.random()}{draw.choice('.!? x')}") for c in range(convs) for t in range(draw.randrange(1, most))]


@pytest.mark.parametrize("piece", [1, 3, 256])
def test_against_brute_force(shipped, piece):
    table = drawn(piece, 60, 14) + [(1000, t, "user" if t % 2 == 0 else "assistant", f"Turn {t}.") for t in range(60)]
    assert got(shipped, table, piece) == brute(table)


def test_odd_rows(shipped):
    table = drawn(9, 20, 6) + [
        (None, 1, "user", "No id."), (None, None, None, None), (None, 1, "assistant", "No id."), (500, None, "user", "Hm."), (500, None, "assistant", "Hm."),
        (501, 4, None, None), (502, None, None, None), (503, 3, "user", "Word. " * 30_000), (503, 9, "assistant", "word " * 30_000),
    ] + [(504, t % 3, "user", "Same.") for t in range(50)] + [(505, 2, "assistant", "Again.")] * 40
    assert got(shipped, table, 4) == brute(table)


def test_a_conversation_that_loses_every_row(shipped):
    turn = next(t for t in range(1000) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    empty = hashlib.sha256(b"").hexdigest()
    assert got(shipped, [(7, turn, "user", "Gone.")], 2) == [(7, 0, 0, 0, 0, 0, 0, "", empty)]


def test_empty_table(shipped):
    assert got(shipped, [], 2) == []


def test_prices_are_the_costs_of_what_remains():
    draw = random.Random(4)
    for _ in range(300):
        codes = "".join(draw.choice("suaxSUAX0123") for _ in range(draw.randrange(1, 12)))
        rows = [("suax"[int(c)] if c.isdigit() else c.lower(), c.isdigit(), c.isupper()) for c in codes]
        cut = sorted(draw.randrange(len(codes) + 1) for _ in range(2))
        parts = [part for part in (codes[: cut[0]], codes[cut[0] : cut[1]], codes[cut[1] :]) if part]
        assert conversations.remaining([conversations.costs(part) for part in parts])[0][0] == brute_repair(rows)[0]
