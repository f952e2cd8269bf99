"""Registered queries of this subpackage: ``(spark, sf_dir) -> DataFrame`` over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cardflux.llm import binary_ids, conversations, minhash, negatives, packing, passages, pieces, postings, quality_rules, resampling, run_index, simhash, toxicity
from cardflux.llm.shipping import ship
from cardflux.llm.store import table
from cardflux.sources.scratch import scratch_folder


def op1_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.graded(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op2_hilbert_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_posting_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings.search(table(spark, sf_dir, "embeddings"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality_rules.judged_documents(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))


def op6_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passages(table(spark, sf_dir, "documents"))


def op8_orc_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_folder(spark, "token-ids")
    binary_ids.write_token_ids(table(spark, sf_dir, "documents"), folder, "word_bpe_49k.json", end_id=2)
    return binary_ids.checksums(binary_ids.read_token_ids(spark, folder))


def op9_run_length_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_index.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text")


def op10_sentencepiece_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.decode(pieces.encode(table(spark, sf_dir, "documents"))))


def op11_auction_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repaired(table(spark, sf_dir, "conversations"))


def op12_segment_popcounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op13_one_bit_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_ordinal_toxicity": op1_ordinal_toxicity,
    "op2_hilbert_packing": op2_hilbert_packing,
    "op3_minhash_near_dedup": op3_minhash_near_dedup,
    "op4_posting_lists": op4_posting_lists,
    "op5_quality_rules": op5_quality_rules,
    "op6_importance_resampling": op6_importance_resampling,
    "op7_compact_windows": op7_compact_windows,
    "op8_orc_token_ids": op8_orc_token_ids,
    "op9_run_length_index": op9_run_length_index,
    "op10_sentencepiece_viterbi": op10_sentencepiece_viterbi,
    "op11_auction_repair": op11_auction_repair,
    "op12_segment_popcounts": op12_segment_popcounts,
    "op13_one_bit_negatives": op13_one_bit_negatives,
}


def registered():
    def wrap(query):
        return lambda spark, sf_dir: query(ship(spark), sf_dir)

    return {name: wrap(query) for name, query in QUERIES.items()}


def statements() -> dict[str, str]:
    """SQL counterparts, where SQL can express the query."""
    return {"op13_one_bit_negatives": negatives.SQL}
