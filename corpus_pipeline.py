"""Corpus pipeline: stages on ``documents``, each on all that its predecessor kept.

1. toxicity: documents graded as toxic go;
2. quality rules: documents that fail them or their likelihood ratio go;
3. near duplicates: one document of each group stays, the one with the least ``doc_id``;
4. repeated passages: later copies of a passage are cut out of their texts;
5. packing: what is left is tokenised and packed into training sequences.

Classifiers are fitted on all labelled documents among a stage's own input. Columns other than ``doc_id`` and
``text`` are passed on as they are, whatever their names, except ``n_chars``, which follows its text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardflux.llm import minhash, packing, passages, quality_rules, toxicity
from cardflux.llm.shipping import ship
from cardflux.llm.store import stored, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return toxicity.accepted(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return quality_rules.accepted(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are told apart by ``doc_id`` and text: rows that share a ``doc_id`` but not their text are documents of their own."""
    ship(spark)
    return minhash.representatives(docs)


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return passages.without_repeats(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship(spark)
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("quality rules", drop_low_quality),
    ("near duplicates", drop_near_duplicates),
    ("repeated passages", drop_repeated_passages),
    ("packing", pack),
]

#: SQL can express none of the stages. Near duplicates are tested against brute force by themselves; the other stages and the
#: pipeline as a whole are not, their tests check what is kept and that repeats go.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
