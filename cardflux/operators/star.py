"""Loading stage rows into the fact table."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions.calendar import load_time
from cardflux.functions.labels import high_velocity
from cardflux.model import LIMITS, Limits
from cardflux.operators.rows import assign_surrogate_keys, first_per_key

FOREIGN_KEYS = ["customer_key", "merchant_key", "date_key", "fraud_signal_key"]
SIGNALS = ["cross_merchant_flag", "is_international", "risk_tier", "high_velocity_flag"]

# Which copy of a transaction id is kept: the earliest, then the smallest by amount and merchant.
COPY_ORDER = ["event_time", "amount_usd", "merchant_id"]
# What the fact takes from the stage; further ties are broken by these before any other column.
FACT_INPUTS = ["transaction_id", *COPY_ORDER, "customer_id", *SIGNALS[:3], *model.FACT_COLUMNS[7:15], "ingest_date"]


@dataclass(frozen=True)
class Star:
    """The dimensions and, once loaded, the fact."""

    customers: DataFrame
    merchants: DataFrame
    dates: DataFrame
    signals: DataFrame
    fact: DataFrame | None = None
    #: What loads left out: rows without a dimension match, and files that could not be read.
    unresolved: DataFrame | None = None
    skipped: DataFrame | None = None
    #: The ledger: one row per load with its time, its rows (also none), and the greatest row key after it.
    loads: DataFrame | None = None

    def with_fact(self, fact: DataFrame) -> "Star":
        return replace(self, fact=fact)


def distinct_transactions(stage: DataFrame) -> DataFrame:
    """One row per transaction id."""
    return first_per_key(stage, "transaction_id", [name for name in FACT_INPUTS[1:] if name in stage.columns])


def not_yet_loaded(stage: DataFrame, fact: DataFrame | None, same_days_only: bool = False) -> DataFrame:
    """Stage rows whose transaction id the fact does not hold.

    The fact is first reduced to the ids of the batch: Spark broadcasts a small batch into that
    scan, or filters the scan by it at run time, so the fact's ids need not be shuffled for it.
    ``same_days_only`` also prunes the fact to the batch's days; use it only when a re-delivered
    transaction always keeps its event day.
    """
    if fact is None:
        return stage
    loaded = fact.select("transaction_id", "ingest_date")
    if same_days_only:
        span = stage.agg(F.struct(F.min("ingest_date").alias("first"), F.max("ingest_date").alias("last"))).scalar()
        loaded = loaded.where(F.col("ingest_date").between(span.getField("first"), span.getField("last")))
    seen = loaded.select("transaction_id").join(stage.select("transaction_id"), "transaction_id", "left_semi")
    return stage.join(seen, "transaction_id", "left_anti")


def not_indexed(new: DataFrame, ids: DataFrame, buckets: int, days_of: DataFrame | None = None) -> DataFrame:
    """Rows, one per transaction id, that the id index does not hold; the index is read in its buckets and not shuffled.

    ``days_of`` limits the ids to the days from the first to the last of that frame, as ``same_days_only`` of :func:`not_yet_loaded` does.
    """
    if days_of is not None:
        span = days_of.agg(F.struct(F.min("ingest_date").alias("first"), F.max("ingest_date").alias("last"))).scalar()
        ids = ids.where(F.col("ingest_date").between(span.getField("first"), span.getField("last")))
    return new.repartition(buckets, "transaction_id").join(ids.select("transaction_id").hint("merge"), "transaction_id", "left_anti")


def look_up_keys(stage: DataFrame, star: Star, limits: Limits = LIMITS) -> DataFrame:
    """Stage rows with the four surrogate keys, NULL where a dimension has no match.

    Dates and signals are broadcast: one row per calendar day and 24 rows. Customers and merchants
    grow with the data; Spark decides on their size, and splits hot keys of a sort-merge join.
    """
    days = star.dates.select(F.col("full_date").alias("ingest_date"), "date_key")
    return (
        stage.withColumns(
            {
                "is_international": F.coalesce("is_international", F.lit(False)),
                "high_velocity_flag": high_velocity(F.col("txn_count_last_1h"), limits),
            }
        )
        .join(F.broadcast(star.signals.select("fraud_signal_key", *SIGNALS)), SIGNALS, "left")
        .join(F.broadcast(days), "ingest_date", "left")
        .join(star.merchants.select("merchant_id", "merchant_key"), "merchant_id", "left")
        .join(star.customers.select("customer_id", "customer_key"), "customer_id", "left")
    )


def missing_keys() -> Column:
    """Names of the dimensions without a match, empty if there is a row in each."""
    return F.concat_ws(",", *[F.when(F.col(key).isNull(), F.lit(key)) for key in FOREIGN_KEYS])


def as_fact(found: DataFrame, load_ts: dt.datetime | None = None) -> DataFrame:
    """Rows with all keys as fact rows, without row keys."""
    return found.withColumns({"currency": F.coalesce("currency", F.lit("USD")), "dw_loaded_at": load_time(load_ts)}).select(*model.FACT_COLUMNS[1:])


def resolve_fact(
    stage: DataFrame,
    star: Star,
    load_ts: dt.datetime | None = None,
    limits: Limits = LIMITS,
    same_days_only: bool = False,
) -> DataFrame:
    """The rows a batch adds to the fact, without row keys: de-duplicated, not yet loaded, resolved in every dimension.

    Columns the fact does not take are dropped before the first shuffle.
    """
    new = not_yet_loaded(distinct_transactions(stage.select(*FACT_INPUTS)), star.fact, same_days_only)
    found = look_up_keys(new, star, limits)
    for key in FOREIGN_KEYS:
        found = found.where(F.col(key).isNotNull())
    return as_fact(found, load_ts)


def number_fact(resolved: DataFrame, existing: DataFrame | None = None, after: int | None = None) -> DataFrame:
    """Row keys after the greatest of ``existing``, or ``after`` a known one; dense, and a function of the set of transaction ids alone.

    The rows are read twice, so store them first. A recomputed task gives its rows the same keys.
    """
    return assign_surrogate_keys(resolved, "transaction_id", "transaction_sk", existing, after).select(*model.FACT_COLUMNS)


def load_fact(
    stage: DataFrame,
    star: Star,
    load_ts: dt.datetime | None = None,
    limits: Limits = LIMITS,
    same_days_only: bool = False,
) -> DataFrame:
    """The fact rows a batch adds, with their row keys; ``star.fact`` has to be stored."""
    return number_fact(resolve_fact(stage, star, load_ts, limits, same_days_only), star.fact)


def unresolved_rows(stage: DataFrame, star: Star, limits: Limits = LIMITS, same_days_only: bool = False) -> DataFrame:
    """What the load leaves out because a dimension has no match, with the missing dimensions named."""
    new = not_yet_loaded(distinct_transactions(stage), star.fact, same_days_only)
    found = look_up_keys(new, star, limits).withColumn("missing_keys", missing_keys())
    return found.where("missing_keys <> ''").select(*stage.columns, "missing_keys")


def references(star: Star) -> dict[str, DataFrame]:
    """Foreign key to the dimension that must hold it."""
    return dict(zip(FOREIGN_KEYS, [star.customers, star.merchants, star.dates, star.signals]))
