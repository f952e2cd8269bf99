import os
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cardflux.llm import labelled, postings, quality_rules, resampling, toxicity
from cardflux.llm.store import table

TABLES = "/root/testdata/sf0.01"
given = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


@pytest.fixture
def labels_of(shipped):
    return lambda rows: shipped.createDataFrame(rows, "doc_id long, quality int, toxic int, uid string").repartition(2) if rows and len(rows[0]) == 4 else shipped.createDataFrame(rows, "doc_id long, quality int, toxic int")


def brute_counts(text):
    own = re.findall("[^\x20\x09-\x0d]+", text or "")
    windows = Counter(tuple(own[i : i + 8]) for i in range(len(own) - 7))
    covered = {i + k for i in range(len(own) - 7) if windows[tuple(own[i : i + 8])] > 1 for k in range(8)}
    lines = [line for line in (text or "").split("\n") if re.search("[^\x20\x09-\x0d]", line)]
    failed = len(own) < 20 or 100 * len(covered) > 30 * len(own)
    return (len(own), sum(map(len, own)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), failed)


def test_base_counts_equal_brute_force(table_of, labels_of, odd_pairs):
    model = quality_rules.fit(table_of(odd_pairs), labels_of([(1, 1, 0), (4, 1, 0), (5, None, 0)]))
    rows = quality_rules.judged_documents(table_of(odd_pairs), model).collect()
    got = sorted((r["doc_id"] or 0, *list(r)[1:7]) for r in rows)
    assert got == sorted((i or 0, *brute_counts(t)) for i, t in odd_pairs)
    assert not any(r["kept"] for r in rows if r["base_failed"])


def test_without_labels_only_the_base_rules_decide(table_of, labels_of, odd_pairs):
    model = quality_rules.fit(table_of(odd_pairs), labels_of([]))
    assert all(r["kept"] != r["base_failed"] for r in quality_rules.judged_documents(table_of(odd_pairs), model).collect())
    nothing = toxicity.fit(table_of(odd_pairs), labels_of([(1, 1, 0)]))
    assert not any(r["rejected"] for r in toxicity.graded(table_of(odd_pairs), nothing).collect())
    assert resampling.resample(table_of(odd_pairs), labels_of([])).where("selected").count() == len(odd_pairs)


def test_the_ratio_is_that_of_two_multinomials(table_of, labels_of):
    from cardflux.llm import ngram_models

    ratios = ngram_models.log_ratios(table_of([(1, "a b"), (2, "c d"), (3, "c d")]), np.array([1]))
    assert (ratios > 0).sum() == 3 and (ratios < 0).sum() == 3


@given
def test_held_out_accuracy_on_the_given_labels(shipped):
    docs, labels = table(shipped, TABLES, "documents"), table(shipped, TABLES, "labels")
    known = {r["doc_id"]: r for r in labels.collect()}
    toxic = toxicity.graded(docs, toxicity.fit(docs, labels.where("doc_id % 3 <> 0"))).where("doc_id % 3 = 0").collect()
    clean = [r["rejected"] for r in toxic if r["doc_id"] in known and not known[r["doc_id"]]["toxic"]]
    assert sum(clean) <= 0.01 * len(clean)
    assert all(0 <= r["expected_severity"] <= 3 for r in toxic)
    verdicts = quality_rules.judged_documents(docs, quality_rules.fit(docs, labels)).collect()
    good = [r["kept"] for r in verdicts if r["doc_id"] in known and known[r["doc_id"]]["quality"] and r["n_words"] >= 20]
    bad = [r["kept"] for r in verdicts if r["doc_id"] in known and not known[r["doc_id"]]["quality"]]
    assert np.mean(good) > 0.95 and np.mean(bad) < 0.1


def test_ordinal_regression_orders_grades():
    draw = np.random.default_rng(5)
    x = draw.random(600)
    grade = np.digitize(x + draw.normal(0, 0.02, 600), [0.4, 0.6, 0.8])
    w, thetas = toxicity.ordinal_regression(600, np.arange(600), np.zeros(600, int), x * 10, 1, grade, steps=1500, penalty=0)
    severity = toxicity.Model(w, thetas, 0.5).expected_severity(x * 10 * w[0])
    assert (np.diff(thetas) > 0).all() and np.abs(severity - grade).mean() < 0.25


def test_the_toxicity_fit_counts_every_labelled_document(table_of, labels_of, monkeypatch):
    toxic, clean = 3_300, 4_400
    docs = table_of([(i, f"vile filth word{i % 7}" if i < toxic else f"calm talk word{i % 7}") for i in range(toxic + clean)])
    added, seen = toxicity._added, []
    monkeypatch.setattr(toxicity, "_added", lambda *a: seen.append(added(*a)) or seen[-1])
    monkeypatch.setattr(toxicity, "_fitted", lambda summed, n, squares: (seen.append(n), (np.zeros(len(squares)), np.arange(3.0)))[1])
    toxicity.fit(docs, labels_of([(i, 1, int(i < toxic)) for i in range(toxic + clean)]))
    assert list(seen[0][-3:]) == [toxic, clean * 4 // 5, clean // 5] and seen[1] == toxic + clean * 4 // 5


def test_slopes_of_the_ordinal_loss_equal_differences():
    draw = np.random.default_rng(3)
    n, width = 40, 6
    row, column, value = draw.integers(0, n, 200), draw.integers(0, width, 200), draw.random(200)
    x, grade = draw.normal(0, 0.5, width + 3), draw.integers(0, 4, n)
    at = lambda x: toxicity.loss_and_gradient(x[:width], x[width:], n, row, column, value, grade)
    steps = np.eye(width + 3) * 1e-6
    assert np.allclose([(at(x + step)[0] - at(x - step)[0]) / 2e-6 for step in steps], at(x)[1:], atol=1e-4)


def test_trusted_text_is_that_of_every_trusted_document(shipped):
    labels = shipped.range(21_000).selectExpr("id AS doc_id", "1 AS quality", "0 AS toxic")
    docs = shipped.range(21_000).selectExpr("id AS doc_id", "CASE WHEN id < 5 THEN NULL ELSE 'one two' END AS text")
    marked = labelled.marked(docs, labelled.ids_where(labels, "quality > 0"), "trusted")
    assert marked.where("trusted").count() == 21_000


def test_a_quantile_is_that_of_numpy(shipped):
    values = np.random.default_rng(4).normal(0, 3, 501)
    rows = shipped.createDataFrame([(float(v),) for v in values], "v double")
    for share in (0.0, 0.005, 0.5, 0.999, 1.0):
        assert abs(labelled.quantile(rows, "v", share, 501) - np.quantile(values, share)) < 1e-6


def test_top_k_is_exact_with_ties(shipped):
    rows = shipped.range(1000).selectExpr("id AS tie", "(id * 7919) % 50 AS key")
    got = {r["tie"] for r in resampling.top_k(rows, "key", "tie", 333).where("selected").collect()}
    assert got == {i for _, i in sorted((-(i * 7919 % 50), i) for i in range(1000))[:333]}


@given
def test_resampling_prefers_good_documents(shipped):
    docs, labels = table(shipped, TABLES, "documents"), table(shipped, TABLES, "labels")
    rows = resampling.resample(docs, labels, fraction=0.7).collect()
    assert sum(r["selected"] for r in rows) == round(0.7 * len(rows))
    bad = {r["doc_id"] for r in labels.where("quality = 0").collect()}
    assert np.mean([r["selected"] for r in rows if r["doc_id"] in bad]) < 0.2


def test_neighbours_and_odd_vectors(shipped):
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(12, 16))
    vectors = [(i, (centres[i % 12] + draw.normal(size=16) * 0.4).tolist()) for i in range(1500)]
    vectors += [(2000 + i, [1.0] * 16) for i in range(60)]
    odd = [(3000, None), (3020, [0.0] * 16), (3040, [float("nan")] * 16), (3060, [1.0] * 3), (3080, [None] * 16), (None, [1.0] * 16), (40, [0.1] * 16)]
    frame = shipped.createDataFrame([(i, v, "x") for i, v in vectors + odd], "vec_id long, embedding array<float>, v string").repartition(4)
    rows = postings.search(frame).collect()
    ids = np.array([i for i, _ in vectors] + [40])
    stored = np.array([v for _, v in vectors] + [[0.1] * 16], np.float32).astype(float)
    found = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert set(found) == {int(i) for i in ids if i % 20 == 0}
    hits = []
    for query in set(found) - {40}:
        exact = (stored * stored[ids == query][0]).sum(axis=1)
        order = [int(i) for i in np.lexsort((ids, -exact)) if ids[i] != query]
        best = list(dict.fromkeys(int(ids[i]) for i in order))[:20]
        hits.append(len(set(best) & {i for i, _ in found[query]}) / 20)
        assert all(np.isclose(score, exact[ids == i].max(), rtol=0, atol=1e-12) for i, score in found[query])
    assert np.mean(hits) > 0.97
    assert [i for i, _ in found[2000]] == list(range(2001, 2021))


def nearest_by_brute_force(ids, vectors, k=20):
    """Sets of the nearest ids per query."""
    out = {}
    for place in np.flatnonzero(ids % 20 == 0):
        scores = vectors @ vectors[place]
        scores[ids == ids[place]] = -np.inf
        out[int(ids[place])] = set(ids[np.lexsort((ids, -scores))[:k]].tolist())
    return out


def recall(rows, want):
    got = {}
    for row in rows:
        got.setdefault(row["query_id"], set()).add(row["vec_id"])
    return sum(len(got[i] & ids) for i, ids in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize(("spread", "replicas"), [(0.25, 1.02), (100.0, 1.1)])
def test_neighbours_where_lists_are_pruned(shipped, spread, replicas):
    """Two hundred lists over clustered vectors, few of which lie near a boundary, and over random ones: replicas, lists read, and recall."""
    draw = np.random.default_rng(12)
    vectors = draw.normal(size=(40, 64))[draw.integers(0, 40, 6400)] + spread * draw.normal(size=(6400, 64))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    ids = np.arange(6400)
    frame = shipped.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<double>").repartition(4)
    graph, greatest, ratio = postings.fit(postings.usable(frame, "vec_id", "embedding"), 32)
    holding = graph.lists_to_hold(postings.lifted(vectors, greatest), postings.MARGIN)
    reading = graph.lists_to_read(np.concatenate([vectors[::20], np.zeros((320, 1))], axis=1), ratio, 4)
    assert len(graph.centroids) >= 190
    assert replicas < sum(map(len, holding)) / 6400 < 2.5
    assert sum(map(len, reading)) / 320 < 0.85 * len(graph.centroids)
    rows = postings.search(frame, list_size=32, least_probes=4).collect()
    assert recall(rows, nearest_by_brute_force(ids, vectors)) > 0.95


def test_neighbours_of_the_given_vectors_with_small_lists(shipped):
    given = table(shipped, "/root/testdata/sf0.1", "embeddings").where("embedding is not null").toPandas()
    ids, vectors = given["vec_id"].to_numpy(), np.stack(given["embedding"]).astype(float)
    rows = postings.search(table(shipped, "/root/testdata/sf0.1", "embeddings"), list_size=16).collect()
    assert recall(rows, nearest_by_brute_force(ids, vectors)) > 0.95


def test_rows_of_one_id_do_not_crowd_others_out_and_short_lists_are_made_up_for(shipped):
    draw = np.random.default_rng(3)
    rows = [(7, [1.0, 0.001 * n, *draw.normal(size=6)]) for n in range(300)] + [(20, [1.0, 0.0, 0, 0, 0, 0, 0, 0])]
    rows += [(100 + n, draw.normal(size=8).tolist()) for n in range(1, 41) if (100 + n) % 20]
    frame = shipped.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for list_size, probes in ((256, 16), (4, 1)):
        found = postings.search(frame, list_size=list_size, least_probes=probes, recall=0.0).collect()
        assert sorted(r["rank"] for r in found if r["query_id"] == 20) == list(range(1, 21))
        assert len({r["vec_id"] for r in found if r["query_id"] == 20}) == 20


def test_a_task_sends_the_nearest_of_a_query_once(shipped, monkeypatch):
    """Whatever number of lists a query reads; a task that holds too much sends some on and loses none."""
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(400, 8))
    places = [(n, i, v.tolist()) for i, v in enumerate(vectors) for n in (i % 16, (i + 1) % 16)]
    asked = [(n, i, vectors[i].tolist()) for i in range(0, 400, 20) for n in range(16)]
    sides = [shipped.createDataFrame(side, "list int, vec_id long, v array<double>").coalesce(1) for side in (asked, places)]
    scores = vectors @ vectors.T
    np.fill_diagonal(scores, -np.inf)
    for most in (500_000, 10):
        monkeypatch.setattr(postings, "HELD", most)
        rows = postings._ranked(*sides, 5).collect()
        for i in range(0, 400, 20):
            found = sorted((r["rank"], r["vec_id"]) for r in rows if r["query_id"] == i)
            assert [v for _, v in found] == np.argsort(-scores[i])[:5].tolist()
    monkeypatch.undo()
    sent = postings._found(*sides, 5).withColumn("task", F.spark_partition_id()).groupBy("task", "query_id").count().collect()
    assert sent and max(r["count"] for r in sent) == 5
    block = [(np.array([1, 1, 2]), np.array([7, 9, 7]), np.array([0.5, 0.5, 1.0])), (np.array([1, 2]), np.array([7, 3]), np.array([0.9, 1.0]))]
    assert [c.tolist() for c in postings.foremost(block, 1)] == [[1, 2], [7, 3], [0.9, 1.0]]


def test_a_query_is_stored_once_and_passes_join_nothing(shipped, monkeypatch):
    """Rows of queries do not grow with the lists they read; no side is broadcast by Spark's estimate; passes and dealt lists give the same rows."""
    draw = np.random.default_rng(9)
    frame = shipped.createDataFrame([(i, v.tolist()) for i, v in enumerate(draw.normal(size=(1200, 8)))], "vec_id long, embedding array<double>")
    counts, real = {}, postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, purpose: counts.setdefault(purpose, []).append(real(df, purpose)) or counts[purpose][-1])
    whole = sorted(map(tuple, postings.search(frame, list_size=16, least_probes=4).collect()))
    assert len(whole) == 60 * 20
    assert [f.count() for f in counts["list-queries"]][0] == 60
    for name, value in (("QUERIES", 7), ("DEALT", 8), ("HELD", 90), ("TILE", 5)):
        monkeypatch.setattr(postings, name, value)
    counts.clear()
    assert sorted(map(tuple, postings.search(frame, list_size=16, least_probes=4).collect())) == whole
    assert len(counts["neighbours"]) >= 9
    plan = postings._found(counts["list-queries"][0], counts["posting-lists"][0], 5)._jdf.queryExecution().sparkPlan().toString()
    assert "Join" not in plan and "Broadcast" not in plan


def test_the_fit_takes_little_memory_and_its_sample_the_least_hashes(shipped, monkeypatch):
    draw = np.random.default_rng(10)
    points = draw.normal(size=(4096, 9))
    tracemalloc.start()
    graph = postings.Graph.over(points[:1024])
    postings.nearest(points, graph.centroids)
    graph.lists_to_hold(points, 1.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30e6
    rows = shipped.createDataFrame([(i, v.tolist()) for i, v in enumerate(points[:600])], "vec_id long, v array<double>")
    wanted = np.array([r["v"] for r in rows.orderBy(F.xxhash64("vec_id", "v")).limit(40).collect()])
    taken, real = [], postings.balanced_centroids
    monkeypatch.setattr(postings, "balanced_centroids", lambda sample, lists: taken.append(sample) or real(sample, lists))
    monkeypatch.setattr(postings, "MAX_SAMPLE", 40)
    postings.fit(rows, 100)
    assert np.array_equal(taken[0][:, :9], wanted)


def test_no_vectors(shipped):
    assert postings.search(shipped.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_passes_leave_no_shuffle_files_and_labels_are_not_broadcast(shipped):
    """However many passes a fit makes, each deletes what it shuffled; a plan that changes with the size of the labels would not scale alike."""
    from cardflux.llm import ngram_models

    tracker = shipped._jvm.org.apache.spark.SparkEnv.get().mapOutputTracker()
    docs = shipped.createDataFrame([(n, f"word{n % 3} text") for n in range(40)], "doc_id long, text string")
    ids = shipped.createDataFrame([(1,), (2,)], "doc_id long")
    plan = labelled.marked(docs, ids, "trusted")._jdf.queryExecution().sparkPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
    before = tracker.shuffleStatuses().size()
    ngram_models.log_ratios(docs, ids)
    labelled.kth_largest(docs.selectExpr("doc_id AS key"), "key", 3)
    assert tracker.shuffleStatuses().size() <= before


def test_a_pass_of_the_fit_sends_a_vector_per_core(shipped):
    """However many files its documents are in; documents are unpacked up to a number of features, stored in few bytes each."""
    texts = ["one two", "one " * 300 + "two", None, " ".join(f"word{n}" for n in range(400))]
    docs = shipped.createDataFrame([(n, texts[n % 4]) for n in range(64)], "doc_id long, text string").repartition(64)
    labels = shipped.createDataFrame([(n, 1, n % 2) for n in range(64)], "doc_id long, quality int, toxic int")
    rows = toxicity.stored(toxicity._stored_features(docs, labels), "features").repartition(64)
    cores = shipped.sparkContext.defaultParallelism
    assert 64 > cores >= toxicity._in_few_tasks(rows).rdd.getNumPartitions()
    assert toxicity._added(rows, lambda part: np.array([len(part.toxic), part.toxic.sum()], float), 2).tolist() == [64, 32]
    whole = rows.toArrow().combine_chunks().to_batches()
    expected = list(toxicity._unpack(iter(whole)))
    assert len(expected) == 1
    parts = list(toxicity._unpack(iter(whole), 50))
    assert len(parts) > 16 and np.allclose(np.concatenate([p.rate for p in parts]), expected[0].rate)
    assert np.concatenate([p.bucket for p in parts]).tolist() == expected[0].bucket.tolist()
    assert np.isclose(expected[0].rate, 300 / 301).any()
    bytes_each = rows.agg((F.sum(F.length("gaps") + F.length("times")) / F.sum("n_features")).alias("b")).first()["b"]
    assert bytes_each < 5


def test_a_pass_of_the_fit_leaves_no_files(shipped):
    """What goes to the tasks of a pass is gone with it, also where it is large."""
    def size():
        paths = [os.path.join(d, f) for d, _, names in os.walk(shipped.sparkContext._temp_dir) for f in names]
        return sum(os.path.getsize(path) for path in paths if os.path.exists(path))

    docs = shipped.createDataFrame([(n, "one two") for n in range(8)], "doc_id long, text string")
    labels = shipped.createDataFrame([(n, 1, n % 2) for n in range(8)], "doc_id long, quality int, toxic int")
    rows = toxicity._stored_features(docs, labels)
    before = size()
    table = np.random.default_rng(1).random(400_000)
    for _ in range(3):
        added = toxicity._added(rows, lambda part, given: np.array([part.toxic.sum() * given[5]]), 1, table)
        assert np.allclose(added, 4 * table[5])
    assert size() - before < 1_000_000
