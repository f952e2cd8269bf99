"""Quality classifier by importance resampling: hashed n-gram models, Gumbel noise, exact top-k.

A document's log weight is the mean log ratio of the trusted and the raw model over its grams, times
``GRAMS`` so that length does not decide. Adding Gumbel noise and taking the k largest draws k documents
without replacement in proportion to their weights. The noise is a hash of ``doc_id``, text and seed, so
a recomputed task draws the same. The k-th largest key is found by counting key prefixes, a bounded table
per pass; no sort and no limit runs over the documents.

Defined cases: a NULL or empty text has log weight 0; equal keys go to the smaller ``doc_id``, NULL last;
rows that are equal in key and ``doc_id`` are selected together, which may exceed k by their number; without
trusted labels all weights are 0, a uniform draw; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflux.llm.labelled import fixed_point, ids_where, judged, kth_largest
from cardflux.llm.ngram_models import log_ratios, mean_ratio
from cardflux.llm.store import require, stored
from cardflux.llm.textbytes import Words, text_slices

GRAMS = 200.0


def log_weight(text: Column, ratios: np.ndarray) -> Column:
    @F.arrow_udf("double")
    def weigh(texts: pa.Array) -> pa.Array:
        parts = [np.zeros(0)]
        for _, data, bounds in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            parts.append(mean_ratio(Words(data, bounds), ratios)[0] * GRAMS)
        return pa.array(np.concatenate(parts))

    return weigh(text)


def top_k(rows: DataFrame, key: str, tie: str, k: int) -> DataFrame:
    """``rows`` with ``selected``: the k largest of ``key``, ties to the smaller ``tie`` (48 bits each)."""
    if k <= 0:
        return rows.withColumn("selected", F.lit(False))
    cut, above = kth_largest(rows, key, k)
    # Among rows at the cut the smallest ties win: the largest of their complements.
    level = rows.where(F.col(key) == cut).withColumn("against", F.lit((1 << 48) - 1) - F.col(tie))
    last, _ = kth_largest(level, "against", k - above)
    wins = (F.col(key) > cut) | ((F.col(key) == cut) & (F.lit((1 << 48) - 1) - F.col(tie) >= last))
    return rows.withColumn("selected", wins)


def resample(docs: DataFrame, labels: DataFrame, fraction: float | None = None, seed: int = 6) -> DataFrame:
    """``doc_id, log_weight, sampling_key, selected`` of every row; a ``fraction`` of the rows is selected.

    By default that is the share of good quality among the labelled documents.
    """
    if fraction is None:
        fraction = judged(labels).agg(F.avg(F.when(F.col("quality") > 0, 1.0).otherwise(0.0))).first()[0]
        fraction = 1.0 if fraction is None else fraction
    ratios = log_ratios(docs, ids_where(labels, "quality > 0 and toxic = 0"))
    draw = (F.shiftrightunsigned(F.xxhash64("doc_id", "text", F.lit(seed)), 11) + 0.5) / F.lit(2.0**53)
    weighed = require(docs, ["doc_id", "text"]).select("doc_id", log_weight(F.col("text"), ratios).alias("log_weight"), (-F.log(-F.log(draw))).alias("gumbel"))
    keyed = weighed.withColumn("sampling_key", F.col("log_weight") + F.col("gumbel"))
    # Fixed point, so that keys can be counted by their bits; weights beyond +-2**22 do not occur.
    fixed = fixed_point(F.col("sampling_key"))
    tie = F.coalesce(F.least(F.greatest(F.col("doc_id"), F.lit(0)), F.lit((1 << 48) - 1)), F.lit((1 << 48) - 1)).cast("long")
    rows = stored(keyed.select("doc_id", "log_weight", "sampling_key", fixed.alias("fixed"), tie.alias("tie")), "weights")
    k = round(rows.count() * fraction)
    return top_k(rows, "fixed", "tie", k).drop("fixed", "tie")
