"""Cheapest repair of conversations, as shortest paths found by auction.

A conversation is a lattice: nodes are (row, state) and the state is what the repaired role initials have reached so far (nothing,
a system row, an open user row, a closed pair). Arcs are edits with integer costs. Nodes have prices, zero or a lower bound at
first, so that no price is above an arc's cost plus the price at its end. A path starts at a node and looks at the cheapest arc of its
last node: a price below that is raised to it and the path contracts by a node, otherwise the path extends along the arc.
It ends when it meets a node whose price is settled, and settles all its nodes. Paths start from the last row's nodes first, so that
all prices converge to the cost of what remains. Arcs whose cost equals the drop in price are tight; every cheapest repair is a walk of tight arcs,
and the walk that takes the ASCII-least letter at each node is the ASCII-least repair.

A conversation of any length is handled in pieces of ``PIECE`` rows at most, in Spark:

1. rows are damaged, ordered by a range sort over (conversation, turn, role, digest of the text) and stored with their number;
   alike rows may lie in any number of partitions;
2. rows with a text seen earlier are those that are not the first of their (conversation, role, text), an aggregate of numbers;
3. for each piece, an auction to each of the four states at its end gives the costs from state to state;
4. a conversation's pieces, one small matrix each, are a lattice of their own, whose prices are what remains after each piece;
5. rows and pieces of a conversation pass a task in order, as a stream: a piece's tight arcs are walked from the state reached so far, and its
   rows go into the running SHA-256. Only one piece is held at a time.

Deletions of faulty rows are forced and need no lattice row: D sorts before I, so in the ASCII-least repair they stand before any
insertion at their place.

Defined cases: a NULL role or text is one space, as is a NULL id or turn in the damage's key; rows with a NULL ``conv_id`` are one
conversation; rows of one turn are ordered by role and then by the digest of their text; repeated rows each count; an empty text is a blank row,
texts of any length are read whole; other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.llm.store import require, stored

PIECE = 256
DELETE, INSERT, KEEP, REROLE, CUT_OFF = 2, 5, 0, 1, 5
NOWHERE = 1 << 60

# States: nothing yet, after a system row, after a user row, after a pair.
START, SYSTEM, USER, PAIRED = range(4)
#: The role that can be given at a state, and the state after it.
GIVEN = ["user", "user", "assistant", "user"]
AFTER = [USER, USER, PAIRED, USER]
#: The state after a kept row, by its role's initial.
KEPT = [{"s": SYSTEM, "u": USER}, {"u": USER}, {"a": PAIRED}, {"u": USER}]
#: What remains after the last row: "" or insertions that close a pair.
CLOSING = ["", "II", "I", ""]
REACHING = {START: {START}, SYSTEM: {START, SYSTEM}, USER: set(range(4)), PAIRED: set(range(4))}

# A row's code is its initial, as a capital for a cut-off row, as a digit for one that has to be deleted.
INITIALS = "suax"
FORCED = "0123"


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text`` after the damage."""
    rows = require(conversations, ["conv_id", "turn", "role", "text"])
    blank = F.lit(" ")
    key = F.concat_ws(":", F.coalesce(F.col("conv_id").cast("string"), blank), F.coalesce(F.col("turn").cast("string"), blank))
    rows = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (F.crc32(key) % 20).alias("hit"))
    text = F.when(F.col("hit") == 1, "").when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("hit") == 4, "user").otherwise(F.col("role"))
    rows = rows.where("hit <> 0").select("conv_id", "turn", role.alias("role"), text.alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("times"))
    return rows.withColumn("times", F.explode(F.sequence(F.lit(1), "times"))).drop("times")


def ordered(rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The rows with their number in order, their piece, and a digest of role and text."""
    # Alike rows may be anywhere among themselves, so the last key only spreads them.
    rows = rows.withColumns({"digest": F.sha2("text", 256), "spread": F.monotonically_increasing_id()})
    keys = [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), "role", "digest", "spread"]
    numbered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("rid", F.monotonically_increasing_id())
    same = F.sha2(F.concat_ws(":", F.length("role"), "role", "digest"), 256)
    return numbered.select("conv_id", "turn", "role", "text", "rid", F.expr(f"rid div {piece}").alias("chunk"), F.unhex(same).alias("same"))


def coded(rows: DataFrame) -> DataFrame:
    """``conv_id, chunk, rid, code`` and the first fault of each row."""
    space = r"[\x20\x09-\x0D]"
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    narrow = rows.select("conv_id", "chunk", "rid", "same", F.substring("role", 1, 1).alias("initial"), blank.alias("blank"), (~F.col("text").rlike(rf"[.!?]{space}*\z")).alias("cut"))
    first = rows.groupBy("conv_id", "same").agg(F.min("rid").alias("rid")).select("rid", F.lit(True).alias("first"))
    narrow = narrow.join(first, "rid", "left").withColumn("repeated", F.col("first").isNull() & ~F.col("blank"))
    narrow = narrow.withColumn("cut", F.col("cut") & ~F.col("blank") & ~F.col("repeated"))
    initial = F.when(F.col("initial").isin(*INITIALS[:3]), F.col("initial")).otherwise(INITIALS[3])
    forced = F.translate(initial, INITIALS, FORCED)
    code = F.when(F.col("blank") | F.col("repeated"), forced).when(F.col("cut"), F.upper(initial)).otherwise(initial)
    return narrow.select("conv_id", "chunk", "rid", code.alias("code"), "blank", "repeated", "cut")


def pieces(rows: DataFrame) -> DataFrame:
    """``conv_id, rid, codes`` and the faults of each piece; ``rid`` is that of its first row."""
    counts = [F.count_if(F.col(name)).alias(name) for name in ("blank", "repeated", "cut")]
    codes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rid", "code"))), lambda row: row["code"]), "").alias("codes")
    return rows.groupBy("conv_id", "chunk").agg(F.min("rid").alias("rid"), codes, *counts).drop("chunk")


def _arcs(code: str, state: int) -> list[tuple[str, int, int, int]]:
    """(letter, cost, rows passed, state) of the edits before and at a row, in ASCII order."""
    cut = CUT_OFF if code.isupper() else 0
    arcs = [("D", DELETE, 1, state), ("I", INSERT, 0, AFTER[state])]
    kept = KEPT[state].get(code.lower())
    if kept is not None:
        arcs.append(("K", KEEP + cut, 1, kept))
    return [*arcs, ("R", REROLE + cut, 1, AFTER[state])]


ARCS = {code: [_arcs(code, state) for state in range(4)] for code in INITIALS + INITIALS.upper()}


def auction(codes: str, ends: tuple[int, ...], allowed=frozenset(range(4))) -> list[list[int]]:
    """Settled prices of all nodes: the least cost from each to the end, whose four states have the prices ``ends``.

    ``codes`` has no forced rows. Only ``allowed`` states are nodes; from the others there is no way.
    """
    prices = [list(ends)]
    for code in reversed(codes):
        following = prices[-1]
        bound = min(following)
        price = [bound if state in allowed else NOWHERE for state in range(4)]
        settled = [state not in allowed for state in range(4)]
        for origin in range(4):
            path = [] if settled[origin] else [origin]
            while path:
                state = path[-1]
                cost, inserted, target = min((cost + (following if passed else price)[end], not passed, end) for _, cost, passed, end in ARCS[code][state])
                cost = min(cost, NOWHERE)
                if price[state] < cost:
                    price[state] = cost
                    if len(path) > 1:
                        path.pop()
                elif not inserted or settled[target] or cost == NOWHERE:
                    for node in path:
                        settled[node] = True
                    path = []
                else:
                    path.append(target)
        prices.append(price)
    return prices[::-1]


def unforced(codes: str) -> str:
    return codes.translate({ord(digit): None for digit in FORCED})


@lru_cache(maxsize=50_000)
def costs(codes: str) -> tuple[int, ...]:
    """Least costs of a piece from state to state, row by row, forced deletions included."""
    lattice = unforced(codes)
    forced = DELETE * (len(codes) - len(lattice))
    ends = [[0 if state == end else NOWHERE for state in range(4)] for end in range(4)]
    to = [auction(lattice, tuple(ends[end]), frozenset(REACHING[end]))[0] for end in range(4)]
    return tuple(to[end][state] + forced if to[end][state] < NOWHERE else NOWHERE for state in range(4) for end in range(4))


def remaining(matrices: list[tuple[int, ...]]) -> list[list[int]]:
    """Prices before each piece and at the end, by the same auction over pieces: a node's arcs lead to the four states after a piece."""
    prices = [[INSERT * len(closing) for closing in CLOSING]]
    for matrix in reversed(matrices):
        price = [min(prices[-1])] * 4
        for state in range(4):
            # The path contracts to its origin until the price has met the cheapest arc; then it extends to a settled node.
            while price[state] < (least := min(matrix[4 * state + end] + prices[-1][end] for end in range(4))):
                price[state] = least
        prices.append(price)
    return prices[::-1]


@lru_cache(maxsize=50_000)
def walk(codes: str, ends: tuple[int, ...], state: int) -> tuple[tuple[str, ...], int]:
    """Letters for each row of a piece along tight arcs, the ASCII-least first, and the state at its end."""
    lattice = unforced(codes)
    prices = auction(lattice, ends)
    row, letters, line = 0, [], ""
    for code in codes:
        if code in FORCED:
            letters.append("D")
            continue
        passed = 0
        while not passed:
            letter, _, passed, state = next(arc for arc in ARCS[code][state] if arc[1] + (prices[row + 1] if arc[2] else prices[row])[arc[3]] == prices[row][state])
            line += letter
        letters.append(line)
        row, line = row + 1, ""
    return tuple(letters), state


def matrices(found: DataFrame) -> DataFrame:
    """The pieces with their ``costs``."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.append_column("costs", pa.array([list(costs(codes)) for codes in batch.column("codes").to_pylist()], pa.list_(pa.int64())))

    kinds = ", ".join(f"{name} {kind}" for name, kind in [*found.dtypes, ("costs", "array<bigint>")])
    return found.mapInArrow(solve, kinds)


def priced(found: DataFrame) -> DataFrame:
    """``rid, ends, cost``: the prices after each piece, and for the first piece of a conversation the cost of its repair."""

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ends, total = [], [], []
            for chain in batch.column("chain").to_pylist():
                prices = remaining([piece["costs"] for piece in chain])
                rids += [piece["rid"] for piece in chain]
                ends += prices[1:]
                total += [prices[0][START], *[0] * (len(chain) - 1)]
            yield pa.RecordBatch.from_arrays([pa.array(rids, pa.int64()), pa.array(ends, pa.list_(pa.int64())), pa.array(total, pa.int64())], names=["rid", "ends", "cost"])

    chains = found.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("rid", "costs"))).alias("chain"))
    return chains.select("chain").mapInArrow(price, "rid long, ends array<long>, cost long")


class Repair:
    """What is known of one conversation while its pieces and rows pass."""

    COUNTS = ("blank", "repeated", "cut", "cost")
    COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    SCHEMA = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.counts = dict.fromkeys(self.COUNTS, 0)
        self.state, self.initial, self.illegal = START, "", 0
        self.first_turn = self.last_turn = None
        self.turns = 0
        self.audit: list[str] = []
        self.digest, self.lines = hashlib.sha256(), 0
        self.letters: Iterator[str] = iter(())
        self.at = START

    def add_piece(self, piece: dict) -> None:
        for name in self.COUNTS:
            self.counts[name] += piece[name]
        initials = self.initial + piece["codes"].lower().translate(dict(zip(map(ord, FORCED), INITIALS)))
        self.illegal += sum(pair not in ("su", "ua", "au") for pair in map("".join, zip(initials, initials[1:])))
        self.initial = initials[-1]
        least = min(piece["ends"])
        letters, after = walk(piece["codes"], tuple(price - least for price in piece["ends"]), self.state)
        self.at, self.state = self.state, after
        self.audit.append("".join(letters))
        self.letters = iter(letters)

    def add_row(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.last_turn:
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
            self.turns += 1
        for letter in next(self.letters):
            if letter == "K":
                self._write(role, text)
                self.at = KEPT[self.at][role[:1]]
            elif letter != "D":
                self._write(GIVEN[self.at], text if letter == "R" else "")
                self.at = AFTER[self.at]

    def _write(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode())
        self.lines += 1

    def result(self) -> tuple:
        closing = CLOSING[self.state] if self.audit else ""
        for _ in closing:
            self._write(GIVEN[self.at], "")
            self.at = AFTER[self.at]
        gaps = 0 if self.first_turn is None else self.last_turn - self.first_turn + 1 - self.turns
        counts = [self.counts[name] for name in self.COUNTS]
        return self.conv_id, gaps, *counts[:3], self.illegal, counts[3], "".join(self.audit) + closing, self.digest.hexdigest()


# In a conversation, a mark that it exists comes first, and each piece before its rows.
MARK, PIECE_ROW, ROW = range(3)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    current: Repair | None = None

    def lines(done: list[Repair]) -> pa.RecordBatch:
        columns = list(zip(*[repair.result() for repair in done])) or [[]] * len(Repair.COLUMNS)
        kinds = [pa.int64()] * 7 + [pa.string()] * 2
        return pa.RecordBatch.from_arrays([pa.array(values, kind) for values, kind in zip(columns, kinds)], names=Repair.COLUMNS)

    for batch in (part for whole in batches for part in (whole.slice(start, 1_000) for start in range(0, whole.num_rows, 1_000))):
        done = []
        for row in batch.to_pylist():
            if row["kind"] == MARK:
                if current is not None:
                    done.append(current)
                current = Repair(row["conv_id"])
            elif row["kind"] == PIECE_ROW:
                current.add_piece(row)
            else:
                current.add_row(row["turn"], row["role"], row["text"])
        yield lines(done)
    if current is not None:
        yield lines([current])


def repaired(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row per original ``conv_id`` (see ``Repair.SCHEMA``)."""
    rows = stored(ordered(damaged(conversations), piece), "ordered-rows")
    solved = stored(matrices(pieces(coded(rows))), "pieces")
    prices = solved.drop("costs").join(priced(solved), "rid")
    marks = require(conversations, ["conv_id"]).distinct()
    parts = [
        marks.select(F.lit(MARK).alias("kind"), F.col("conv_id").cast("long"), F.lit(-1).cast("long").alias("rid")),
        prices.withColumn("kind", F.lit(PIECE_ROW)),
        rows.select(F.lit(ROW).alias("kind"), "conv_id", "rid", "turn", "role", "text"),
    ]
    together = parts[0].unionByName(parts[1], allowMissingColumns=True).unionByName(parts[2], allowMissingColumns=True)
    return together.repartition("conv_id").sortWithinPartitions("conv_id", "rid", "kind").mapInArrow(_repairs, Repair.SCHEMA)
