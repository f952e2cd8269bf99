import hashlib
import itertools
import os
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from cardflux.llm import minhash, passages, run_index
from tests.llm.conftest import words


def shingle_set(text):
    own = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def linked(x, y):
    return bool(x) and bool(y) and 100 * len(x & y) >= 75 * len(x | y)


def brute_components(pairs):
    sets = {i: shingle_set(t) for i, t in pairs}
    root = {i: i for i in sets}
    changed = True
    while changed:
        changed = False
        for x, y in itertools.combinations(sorted(sets), 2):
            if linked(sets[x], sets[y]) and root[x] != root[y]:
                low, high = sorted((root[x], root[y]))
                root = {k: low if v == high else v for k, v in root.items()}
                changed = True
    return {i: (len(sets[i]), root[i]) for i in sets}


def test_near_duplicates_equal_brute_force(table_of, odd_pairs):
    named = [(i, t) for i, t in odd_pairs if i is not None]
    rows = minhash.near_duplicates(table_of(odd_pairs)).collect()
    assert len(rows) == len(odd_pairs)
    want = brute_components(named)
    for row in rows:
        if row["doc_id"] is None:
            assert row["component_id"] is None and row["kept"]
        else:
            assert (row["n_shingles"], row["component_id"]) == want[row["doc_id"]]
            assert row["kept"] == (row["doc_id"] == row["component_id"])


def test_one_row_of_each_group_stays(table_of):
    """Rows are told apart by id and text, whatever they share."""
    text, other, third = (" ".join(words(n, 60)) for n in (51, 52, 53))
    near = " ".join("edited" if place == 30 else word for place, word in enumerate(text.split()))
    pairs = [(1, text), (1, other), (1, text), (2, near), (3, text), (None, other), (None, third), (None, third), (4, ""), (5, None), (5, None), (6, "two words"), (6, "two words")]
    rows = minhash.representatives(table_of(pairs))
    assert rows.columns == table_of(pairs).columns
    assert Counter((r["doc_id"], r["text"]) for r in rows.collect()) == Counter([(1, text), (1, other), (None, third), (4, ""), (5, None), (5, None), (6, "two words")])


def test_a_chain_and_a_crowd_of_variants(table_of):
    base = words(11, 100)
    pairs = []
    for n in range(40):
        variant = base.copy()
        for place in range(n % 5):
            variant[(n * 7 + place * 23) % 100] = f"v{n}.{place}"
        pairs.append((100 + n, " ".join(variant)))
    want = brute_components(pairs)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(table_of(pairs)).collect()}
    assert got == want and len({c for _, c in want.values()}) < 40


def test_texts_are_fetched_by_one_plan_at_any_size(table_of, odd_pairs):
    """The wanted nodes are as many as the documents allow, so they are no broadcast, even where they are few."""
    docs = table_of(odd_pairs)
    nodes = minhash.stored(minhash.signatures(docs).where("node is not null").select("node", "doc_id"), "few-nodes")
    plan = minhash._node_sets(docs, nodes, minhash.SHINGLE)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan


def test_densified_bins_agree_as_often_as_sets_are_alike():
    shared, rest = np.arange(1, 400, dtype=np.uint64), np.arange(1000, 1100, dtype=np.uint64)
    pair = [np.unique(minhash.mix(s)) for s in (shared, np.concatenate([shared[:320], rest]))]
    signature = minhash.densified(pair, 4000)
    assert abs((signature[0] == signature[1]).mean() - 320 / 499) < 0.06
    sparse = minhash.densified([pair[0][:3]], 200)
    assert set(sparse[0].tolist()) == set(minhash.mix(pair[0][:3] ^ np.uint64(0x5BD1E995)).tolist())


def brute_cut(texts, length):
    where = {}
    for n, text in enumerate(texts):
        for i in range(len(text) - length + 1):
            where.setdefault(text[i : i + length], []).append((n, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for places in where.values():
        if len(places) > 1:
            for n, i in places:
                gone[n][i : i + length] = True
    return gone


@pytest.mark.parametrize("most_indexed", [1, 8000])
def test_repeated_bytes_equal_brute_force(table_of, odd_pairs, most_indexed):
    block = " ".join(words(21, 60))
    pairs = [*odd_pairs, (20, "a" + block[:230] + "tail"), (21, "other " + block[10:240]), (22, block[:199]), (23, "x" * 450), (24, "ab" * 300 + "x" * 120)]
    rows = run_index.without_repeats(table_of(pairs), most_indexed=most_indexed).collect()
    texts = [(t or "").encode() for _, t in pairs]
    want = []
    for (doc_id, _), text, gone in zip(pairs, texts, brute_cut(texts, 200)):
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        want.append((doc_id or 0, len(text), int(gone.sum()), len(run_index.runs_of(gone)[0]), hashlib.sha256(kept).hexdigest()))
    assert sorted((r["doc_id"] or 0, *list(r)[1:5]) for r in rows) == sorted(want)


def test_run_index_keeps_few_samples_of_a_repetitive_text():
    texts = [b"the same long enough sentence once more" * 5 for _ in range(30)]
    flags = run_index.repeated_windows([*texts, b"something else entirely, and only once"], 20)
    assert all(f.all() for f in flags[:-1]) and not flags[-1].any()


def test_repeated_passages_are_found_and_cut_once(table_of, odd_pairs):
    passage = words(2, 70)
    found = passages.passages(table_of(odd_pairs)).collect()
    spans = {(r["doc_id"], r["kept"]) for r in found}
    texts = dict(odd_pairs)
    for doc_id in (4, 5):
        own = texts[doc_id].split()
        place = next(i for i in range(len(own)) if own[i : i + 70] == passage)
        assert any(r["doc_id"] == doc_id and r["start_word"] <= place and r["start_word"] + r["n_words"] >= place + 70 for r in found)
    assert len({kept for i, kept in spans if i in (4, 5)}) == 2
    assert {i for i, _ in spans} == {1, 2, 3, 4, 5}
    left = passages.without_repeats(table_of(odd_pairs))
    assert left.columns == table_of(odd_pairs).columns
    rows = left.collect()
    assert sum(" ".join(passage) in (r["text"] or "") for r in rows) == 1
    assert all(r["n_chars"] == (None if r["text"] is None else len(r["text"])) for r in rows)
    clean = {6: None, 7: "", 9: "three little words", 11: texts[11], 13: texts[13]}
    assert clean.items() <= {r["doc_id"]: r["text"] for r in rows}.items()


def test_compact_windows_hold_each_passage_once():
    values = np.random.default_rng(3).integers(1, 50, 120).astype(np.uint64)
    starts, ends = np.zeros(120, np.int64), np.full(120, 120)
    found = list(zip(*passages.compact_windows(values, ends, starts, 30)))
    for i in range(120):
        for j in range(i + 29, 120):
            inside = [c for left, c, right in found if left <= i <= c <= j <= right]
            assert inside == [i + int(values[i : j + 1].argmin())]


def test_empty_tables(table_of):
    empty = table_of([(1, "x")]).limit(0)
    assert minhash.near_duplicates(empty).count() == 0
    assert run_index.without_repeats(empty).count() == 0
    assert passages.passages(empty).count() == 0 and passages.without_repeats(empty).count() == 0


def test_copies_meet_beside_a_frequent_line(table_of, monkeypatch):
    """Pairs of copies that share a line of 30 words with all other documents are found, though their hubs are unrelated."""
    monkeypatch.setattr(passages, "BLOCK", 4)
    line = words(30, 30)
    pairs = []
    for n in range(30):
        body = words(100 + n, 11) + line + words(200 + n, 11)
        pairs += [(1000 + 2 * n + k, " ".join(words(300 + 2 * n + k, 60) + body + words(500 + 2 * n + k, 60))) for k in (0, 1)]
    found = passages.passages(table_of(pairs)).collect()
    met = {frozenset((r["doc_id"], r["first_doc_id"])) for r in found if not r["kept"]}
    assert met == {frozenset((1000 + 2 * n, 1001 + 2 * n)) for n in range(30)}


def test_edited_passages_share_a_least_token(table_of):
    """Pairs of 50 words with two changed in the middle: similarity 40/52, found but for 1e-5 of them."""
    pairs = []
    for n in range(1000):
        body = words(10_000 + n, 50)
        pairs += [(2 * n, " ".join(body)), (2 * n + 1, " ".join([*body[:24], "changed", "twice", *body[26:]]))]
    alike = {n for n in range(1000) if linked(shingle_set(pairs[2 * n][1]), shingle_set(pairs[2 * n + 1][1]))}
    found = passages.near_duplicate_passages(table_of(pairs)).select("hub_doc_id").collect()
    assert len(alike) > 990
    assert len(alike - {r["hub_doc_id"] // 2 for r in found}) <= 1


def test_long_copies_that_drift_apart_are_cut(table_of):
    """2,000 words against the same with ten others after each hundred."""
    base = words(40, 2000)
    drifted = [w for n in range(20) for w in (*base[100 * n : 100 * n + 100], *words(50 + n, 10))]
    found = passages.passages(table_of([(1, " ".join(base)), (2, " ".join(drifted))])).where("not kept").collect()
    (doc_id,) = {r["doc_id"] for r in found}
    gone = {i for r in found for i in range(r["start_word"], r["start_word"] + r["n_words"])}
    period = 100 if doc_id == 1 else 110
    wanted = {period * n + i for n in range(20) for i in range(100)}
    assert wanted <= gone

    # Each section comes a second time in the range, and the second places lie on the diagonal.
    own = np.concatenate([np.arange(200), np.arange(100), np.arange(200, 300)]).astype("<u4")
    assert [m[:4] for m in passages.matching_passages(own, own, None, 0)] == [(0, 399, 0, 399)]


def test_ruled_out_pairs_have_no_alike_passage_and_most_pairs_are_ruled_out(monkeypatch):
    """Variants of one text, with words changed, moved, doubled and taken out: the first alike window is that of a search of all pairs."""
    draw = np.random.default_rng(3)
    windows = []
    for uid in range(120):
        tokens = np.arange(2 * passages.MARGIN + 1) + 1
        tokens = np.where(draw.random(len(tokens)) < draw.choice([0.05, 0.15, 0.35]), draw.integers(1000, 10**6, len(tokens)), tokens)
        if uid % 4 == 1:
            tokens = np.delete(tokens, draw.integers(0, len(tokens), 8))
        if uid % 4 == 2:
            tokens[80:95] = tokens[20:35]
        if uid % 4 == 3:
            tokens = np.concatenate([tokens[:30], tokens[90:120], tokens[30:90], tokens[120:]])
        windows.append({"uid": uid // 2, "c": passages.MARGIN + 1000 * (uid % 2), "sequence": tokens.astype("<u4").tobytes()})
    x, y = windows[::2] + windows[1::6], windows

    def searched(m):
        own, at = np.frombuffer(m["sequence"], "<u4"), passages.MARGIN
        for hub in sorted(y, key=lambda h: (h["uid"], h["c"])):
            if (hub["uid"], hub["c"]) >= (m["uid"], m["c"]):
                return []
            shift = hub["c"] - m["c"] if hub["uid"] == m["uid"] else None
            if any(a <= at <= b for a, b, *_ in passages.matching_passages(own, np.frombuffer(hub["sequence"], "<u4"), shift, 0)):
                return [(m["uid"], hub["uid"], hub["c"], m["c"])]
        return []

    wanted = [edge for m in x for edge in searched(m)]
    looked, real = [], passages.matching_passages
    monkeypatch.setattr(passages, "matching_passages", lambda *pair: looked.append(0) or real(*pair))
    assert passages.first_alike(x, y) == wanted and wanted
    assert len(looked) < sum((h["uid"], h["c"]) < (m["uid"], m["c"]) for m in x for h in y) // 4


def test_windows_of_a_frequent_line_are_not_compared_pair_by_pair(monkeypatch):
    """Windows that have a line of 30 tokens in common and nothing else, and among them groups of copies."""
    draw = np.random.default_rng(6)
    line, size = np.arange(30) + 1, 2 * passages.MARGIN + 1
    rows = [draw.integers(10**3, 10**9, size) for _ in range(400)]
    for copy in range(0, 400, 20):
        rows[copy + 7] = np.where(draw.random(size) < 0.02, rows[copy + 7], rows[copy])
    for row in rows:
        row[passages.MARGIN - 15 : passages.MARGIN + 15] = line
    windows = [{"uid": uid, "c": passages.MARGIN, "sequence": row.astype("<u4").tobytes()} for uid, row in enumerate(rows)]
    judged, real = [], passages.may_be_alike
    monkeypatch.setattr(passages, "may_be_alike", lambda targets, *more: judged.append(len(targets)) or real(targets, *more))
    assert passages.first_alike(windows, windows) == [(copy + 7, copy, passages.MARGIN, passages.MARGIN) for copy in range(0, 400, 20)]
    assert sum(judged) < 400


def test_large_groups_are_dealt_out_in_cells(table_of, monkeypatch):
    line = words(30, 30)
    pairs = []
    for n in range(12):
        body = words(100 + n, 11) + line + words(200 + n, 11)
        pairs += [(1000 + 3 * n + k, " ".join(words(300 + 3 * n + k, 60) + body + words(500 + 3 * n + k, 60))) for k in (0, 1, 2)]
    pairs += pairs[:5]

    def found():
        return sorted(map(tuple, passages.near_duplicate_passages(table_of(pairs)).collect()))

    monkeypatch.setattr(passages, "BLOCK", 4)
    whole = found()
    sizes, real = [], passages._windows_of
    monkeypatch.setattr(passages, "PART", 8)
    assert found() == whole and len({(r[0], r[1]) for r in whole}) >= 24
    # Cells come whole, however rows are cut into batches, and equal rows are one window.
    names = ["key", "cell", "uid", "c", "open", "whole", "part", "chunk", "sequence"]
    rows = [(n // 5, 0, n, 9, True, True, 0, 0, bytes(4 * (n + 1))) for n in range(40) for _ in range(1 + n % 2)]
    batch = pa.RecordBatch.from_arrays([pa.array(column) for column in zip(*rows)], names=names)
    monkeypatch.setattr(passages, "TOGETHER", 7)
    for step in (1, 4, 60):
        parts = list(passages._cells(iter([batch.slice(i, step) for i in range(0, 60, step)])))
        assert len(parts) > 3 and [x for part in parts for x in part.column("uid").to_pylist()] == batch.column("uid").to_pylist()
        assert all(part.num_rows >= 7 for part in parts[:-1])
        seen = [part.column("key").to_pylist() for part in parts]
        assert all(not set(x) & set(y) for x, y in zip(seen, seen[1:]))
        for w in map(real, parts):
            sizes += np.diff(w.bounds).tolist()
            assert (w.tokens == 0).all() and len(w.uid) == len(set(w.uid.tolist()))
    assert sizes == 3 * list(range(1, 41))


def test_places_of_common_tokens_tell_whether_a_passage_is_alike():
    draw, met = np.random.default_rng(5), 0
    for n in range(1500):
        first, other_first = draw.integers(0, 60, 2)
        own, other = np.arange(first, first + draw.integers(46, 136)), np.arange(other_first, other_first + draw.integers(46, 136))
        for tokens, unlike in ((own, 1000), (other, 200_000)):
            changed = draw.random(len(tokens)) < draw.choice([0, 0.05, 0.15, 0.25])
            tokens[changed] = unlike + draw.permutation(100_000)[: changed.sum()]
        if n % 3 == 0:
            other = np.delete(other, draw.integers(0, len(other), 6))
        if n % 3 == 1:
            other = np.roll(other, draw.integers(0, 40))
        own, other = own.astype("<u4"), other.astype("<u4")
        at, centre, shift = int(draw.integers(0, len(own))), int(first - other_first), None if n % 4 else int(draw.integers(0, 80))
        zeros, two = np.zeros(2, np.int64), np.arange(2)
        w = passages.Windows(zeros, zeros == 0, zeros, two, zeros, two == 0, zeros, np.concatenate([own, other]), np.cumsum([0, len(own), len(other)]))
        target = passages.targets(w, two[:1], two[1:])
        alike = any(a <= at <= b for a, b, *_ in passages.matching_passages(own, other, shift, centre))
        assert passages.alike_about(target[0], centre, at, shift) == alike
        assert not alike or len(passages.may_be_alike(target, np.array([True]), np.array([centre]), np.array([at]), zeros[:1])) == 1
        met += alike
    assert met > 100


def test_replaced_steps_are_deleted(table_of, odd_pairs, monkeypatch):
    """Of the steps that hold texts or tokens none is left; before, ranges, sequences, pairs and blocks were."""
    kept, real = {}, passages.stored
    monkeypatch.setattr(passages, "stored", lambda df, purpose, *more: kept.setdefault(purpose, []).append(real(df, purpose, *more)) or kept[purpose][-1])
    passages.passages(table_of(odd_pairs)).collect()
    there = {purpose for purpose, frames in kept.items() for frame in frames if os.path.exists(frame._stored_in)}
    assert not there & {"windows", "shared-windows", "hubs", "candidate-passages", "hub-ranges", "hub-sequences", "passage-pairs", "contexts", "blocks"}
