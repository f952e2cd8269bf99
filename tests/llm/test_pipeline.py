import os

import pytest

import corpus_pipeline
from cardflux.llm import minhash, passages
from cardflux.llm.store import stored, table

TABLES = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


def test_stages_hand_on_whole_documents(shipped):
    given = table(shipped, TABLES, "documents")
    docs, ids = given, {r["doc_id"] for r in given.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(shipped, docs, TABLES), "test-stage")
        assert docs.columns == given.columns, name
        kept = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert kept <= ids and len(kept) > 0.5 * len(ids), name
        ids = kept
        if name == "near duplicates":
            assert all(r["kept"] for r in minhash.near_duplicates(docs).collect())
        if name == "repeated passages":
            assert passages.passages(docs).where("similarity = 1 and not kept").count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](shipped, docs, TABLES)
    assert {r["doc_id"] for r in pieces.select("doc_id").distinct().collect()} == ids


def test_stages_take_odd_rows(shipped, table_of, odd_pairs):
    docs = table_of([(i, t) for i, t in odd_pairs])
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(shipped, docs, TABLES), "odd-stage")
        assert docs.count() > 0, name
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(shipped, table_of(odd_pairs).limit(0), TABLES).count() == 0, name
