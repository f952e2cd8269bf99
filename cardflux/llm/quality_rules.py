"""Quality rules: base counts, and a length-normalised log-likelihood ratio of trusted against all text.

The trusted model is a multinomial over hashed words and word pairs of labelled documents of good quality
(half of them, by a hash of the id; the others are held out); the other one covers every document. A document's score is the mean log ratio of its grams. The threshold is
the score below which ``TRUSTED_LOSS`` of all held-out trusted documents fall, so each document's verdict
depends on its own text and the models alone.

Defined cases: a NULL text counts as none: all counts are 0 and the base rules fail; repeated rows get
the same verdict; without labels of good quality only the base rules decide; other columns are untouched.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflux.llm.labelled import ids_where, marked, quantile
from cardflux.llm.ngram_models import log_ratios, mean_ratio
from cardflux.llm.store import require, stored
from cardflux.llm.textbytes import SPACES, Words, grams, mix, split_ranges, text_slices

TRUSTED_LOSS = 0.005
WINDOW = 8
LEAST_WORDS = 20
MOST_REPEATED = 30
VERDICT = "struct<n_words: long, word_chars: long, n_symbols: long, n_dup_lines: long, n_repeat_words: long, base_failed: boolean, log_ratio: double, kept: boolean>"
SYMBOLS = np.zeros(256, np.int64)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = 1
WORD_START = np.zeros(256, np.int64)  # first bytes of code points in words
WORD_START[[b for b in range(256) if not 0x80 <= b < 0xC0]] = 1
WORD_START[SPACES] = 0


def _per_text(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags)])[bounds])


def _within(hashes: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mix(hashes ^ mix(owners.astype(np.uint64) + np.uint64(0x51ED270B)))


def repeated_words(words: Words, window: int = WINDOW) -> np.ndarray:
    """Per text, its words in windows of ``window`` words that occur twice or more in it."""
    n = len(words.hashes)
    windows = grams(words.hashes, window, seed=29)
    begin = np.arange(len(windows))
    whole = words.text[begin] == words.text[begin + window - 1] if len(begin) else np.zeros(0, bool)
    begin = begin[whole]
    keys = _within(windows[begin], words.text[begin])
    order = np.argsort(keys)
    same = keys[order][1:] == keys[order][:-1]
    twice = np.zeros(len(begin), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    change = np.zeros(n + 1, np.int64)
    change[begin[twice]] += 1
    np.subtract.at(change, begin[twice] + window, 1)
    return np.bincount(words.text[np.cumsum(change)[:n] > 0], minlength=len(words.counts))


def duplicate_lines(words: Words) -> np.ndarray:
    """Per text, its lines with a word that equal an earlier line."""
    starts, ends = split_ranges(words.data == 10, words.bounds)
    filled = np.searchsorted(words.starts, ends) > np.searchsorted(words.starts, starts)
    starts, ends = starts[filled], ends[filled]
    text = np.searchsorted(words.bounds, starts, "right") - 1
    _, first = np.unique(_within(words.ranges.hash(starts, ends), text), return_index=True)
    n = len(words.counts)
    return np.bincount(text, minlength=n) - np.bincount(text[first], minlength=n)


@dataclass
class Model:
    ratios: np.ndarray
    threshold: float


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Models and threshold, from all trusted documents: one half of them counts, the other half places the threshold."""
    trusted = ids_where(labels, "quality > 0 and toxic = 0")
    counts = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(2)) == 0
    model = Model(log_ratios(docs, trusted.where(counts)), -np.inf)
    others = marked(docs, trusted.where(~counts), "held_out").where("held_out")
    scored = others.select(verdict(F.col("text"), model).alias("v")).where("not v.base_failed").select("v.log_ratio")
    scored = stored(scored, "held-out-ratios")
    n = scored.count()
    if n:
        model.threshold = quantile(scored, "log_ratio", TRUSTED_LOSS, n)
    return model


def verdict(text: Column, model: Model) -> Column:
    """Struct of the counts and the verdict for a text column."""
    ratios, threshold = model.ratios, model.threshold

    @F.arrow_udf(VERDICT)
    def judge(texts: pa.Array) -> pa.Array:
        parts = []
        for _, data, bounds in text_slices(iter([pa.RecordBatch.from_arrays([texts], names=["text"])])):
            words = Words(data, bounds)
            repeated = repeated_words(words)
            failed = (words.counts < LEAST_WORDS) | (100 * repeated > MOST_REPEATED * words.counts)
            score, _ = mean_ratio(words, ratios)
            counts = [words.counts, _per_text(WORD_START[data], bounds), _per_text(SYMBOLS[data], bounds), duplicate_lines(words), repeated]
            parts.append([*[c.astype(np.int64) for c in counts], failed, score, ~failed & (score >= threshold)])
        kinds = [np.int64] * 5 + [bool, np.float64, bool]
        columns = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, k) for k in kinds]
        names = [field.strip().split(":")[0] for field in VERDICT[7:-1].split(",")]
        return pa.StructArray.from_arrays([pa.array(c) for c in columns], names=names)

    return judge(text)


def judged_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, the counts, ``log_ratio`` and ``kept`` of every document."""
    return require(docs, ["doc_id", "text"]).select("doc_id", verdict(F.col("text"), model).alias("v")).select("doc_id", "v.*")


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The documents that the rules keep, with all their columns."""
    return docs.where(verdict(docs["text"], model)["kept"])
