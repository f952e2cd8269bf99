import random
import re

import numpy as np
import xxhash

from cardflux.llm import simhash

LOWER = {c: c + 32 for c in range(65, 91)}


def brute_fingerprint(text):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not found:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(found[i : i + 3]).encode(), 42) for i in range(max(1, len(found) - 2))]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Least reachable index per fingerprint, over all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def check(pairs, rows):
    ids = [i for i, _ in pairs]
    prints = [brute_fingerprint(t) for _, t in pairs]
    groups = brute_components(prints)
    least = {}
    for i, group in zip(ids, groups):
        if i is not None:
            least[group] = min(i, least.get(group, i))
    want = sorted((repr(i), f"{p:016x}", least.get(g)) for i, p, g in zip(ids, prints, groups))
    assert sorted((repr(r["doc_id"]), r["fingerprint"], r["component_id"]) for r in rows) == want


def test_odd_rows_and_copies(table_of, odd_pairs):
    check(odd_pairs, simhash.near_duplicates(table_of(odd_pairs)).collect())


def test_empty_table(table_of):
    assert simhash.near_duplicates(table_of([(1, "a")]).limit(0)).count() == 0


def test_a_large_group_of_edited_copies_over_many_blocks(table_of):
    draw = random.Random(8)
    base = [f"w{draw.randrange(5000)}" for _ in range(150)]
    pairs = [(0, " ".join(base))]
    for i in range(1, 260):
        edited = base.copy()
        for _ in range(draw.randrange(1, 5)):
            edited[draw.randrange(150)] = f"x{draw.randrange(10**6)}"
        pairs.append((i, " ".join(edited)))
    pairs += [(i, " ".join(f"y{draw.randrange(10**6)}" for _ in range(60))) for i in range(300, 420)]
    check(pairs, simhash.near_duplicates(table_of(pairs), block=8).collect())


def test_long_texts_are_counted_span_by_span(monkeypatch):
    texts = ["", "One", *[" ".join(random.Random(n).choice("ab Cd é ☃ q".split()) for _ in range(n)) for n in (2, 3, 4, 40, 333)]]
    data = [t.encode() for t in texts]
    bounds = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    for span in (simhash.SPAN, 7):
        monkeypatch.setattr(simhash, "SPAN", span)
        got = simhash.fingerprints(np.frombuffer(b"".join(data), np.uint8), bounds)
        assert got.tolist() == [brute_fingerprint(t) for t in texts]


def test_every_linked_pair_meets_in_a_cell(shipped):
    """Random fingerprints with all kinds of one to three flipped bits, against all pairs."""
    draw = random.Random(3)
    prints = set()
    for _ in range(150):
        one = draw.getrandbits(64) & draw.getrandbits(64)
        prints |= {one} | {one ^ sum(1 << b for b in draw.sample(range(64), n)) for n in (1, 2, 3)}
    prints = sorted(prints)
    signed = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    for distance in (0, 1, 2, 3, 5):
        cells = simhash.cells(shipped.createDataFrame(signed, "fp long"), distance).toPandas()
        together, at_home = {}, set()
        for cell, fp, home in cells.itertuples(index=False):
            together.setdefault(cell, set()).add(fp)
            if home:
                at_home.add(cell)
        met = {(a, b) for cell in at_home for a in together[cell] for b in together[cell] if a < b}
        close = {(a, b) for (a,) in signed for (b,) in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= distance}
        assert close <= met and (distance == 0 or close)
