"""Labelled documents, for fitting."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflux.llm.store import collected, require

#: Real numbers are counted as integers with this many fractional bits, by so many bits per pass.
FRACTION = 24
DIGIT = 16


def judged(labels: DataFrame) -> DataFrame:
    """One row per labelled ``doc_id``; if rows disagree the worse judgement counts. Rows with a NULL are no labels."""
    known = require(labels, ["doc_id", "quality", "toxic"]).dropna()
    return known.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("toxic").alias("toxic"))


def ids_where(labels: DataFrame, condition: Column | str) -> DataFrame:
    """``doc_id`` of all labelled documents that meet ``condition``, each once."""
    return judged(labels).where(condition).select("doc_id")


def marked(docs: DataFrame, ids: DataFrame, mark: str) -> DataFrame:
    """``doc_id`` and ``text`` of every document, and whether its id is among ``ids``, which holds each once.

    Labels grow with the documents, so they are never broadcast: the texts are shuffled once.
    """
    known = ids.select(F.col("doc_id").alias("_marked_id")).hint("merge")
    found = require(docs, ["doc_id", "text"]).join(known, F.col("doc_id") == F.col("_marked_id"), "left")
    return found.select("doc_id", "text", F.col("_marked_id").isNotNull().alias(mark))


def fixed_point(value: Column) -> Column:
    """A real number within +-2**22 as a 48-bit integer in the same order; others count as the nearest of these."""
    return F.least(F.greatest(F.round((value + 2.0**22) * 2.0**FRACTION), F.lit(0.0)), F.lit(2.0**48 - 1)).cast("long")


def kth_largest(rows: DataFrame, key: str, k: int) -> tuple[int, int]:
    """The k-th largest value of a non-negative 48-bit integer column, and how many rows lie above it.

    Keys are counted by their digits, a bounded table per pass; nothing is sorted, and no rows are collected.
    """
    prefix, above = 0, 0
    for shift in range(48 - DIGIT, -1, -DIGIT):
        digit = F.shiftright(key, shift)
        here = rows.where(F.shiftright(key, shift + DIGIT) == prefix).groupBy(digit.alias("digit")).count()
        for value, count in sorted(collected(here), reverse=True):
            if above + count >= k:
                prefix = value
                break
            above += count
    return prefix, above


def value_at(rows: DataFrame, column: str, rank: int, n: int) -> float:
    """The value at ``rank`` (from 0, ascending) of the ``n`` numbers of a stored column, to within 2**-24."""
    keys = rows.select(fixed_point(F.col(column)).alias("key"))
    return kth_largest(keys, "key", n - rank)[0] / 2.0**FRACTION - 2.0**22


def quantile(rows: DataFrame, column: str, share: float, n: int) -> float:
    """The value below which ``share`` of the ``n`` numbers of a stored column lie, between the two nearest as numpy does."""
    place = share * (n - 1)
    rank = int(place)
    low = value_at(rows, column, rank, n)
    return low if place == rank else low + (place - rank) * (value_at(rows, column, rank + 1, n) - low)
