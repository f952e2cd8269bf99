"""The four dimensions: two generated, two kept current by type-1 upserts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions.calendar import date_key, load_time
from cardflux.functions.labels import signal_label
from cardflux.operators.rows import assign_surrogate_keys, latest_per_key
from cardflux.sources.scratch import scratch_folder

FIRST_DATE = dt.date(2020, 1, 1)
LAST_DATE = dt.date(2030, 12, 31)


def build_dim_date(spark: SparkSession, first: dt.date = FIRST_DATE, last: dt.date = LAST_DATE) -> DataFrame:
    """One row per calendar day; day of week counts from Sunday = 1."""
    spine = spark.range(1).select(F.explode(F.sequence(F.lit(first), F.lit(last))).alias("full_date"))
    return describe_days(spine)


def describe_days(days: DataFrame) -> DataFrame:
    day = F.col("full_date")
    weekday = F.dayofweek(day)
    return days.select(
        date_key(day).alias("date_key"),
        day,
        weekday.alias("day_of_week"),
        F.dayname(day).alias("day_name"),
        F.dayofmonth(day).alias("day_of_month"),
        F.dayofyear(day).alias("day_of_year"),
        F.weekofyear(day).alias("week_of_year"),
        F.month(day).alias("month_num"),
        F.monthname(day).alias("month_name"),
        F.quarter(day).alias("quarter"),
        F.year(day).alias("year"),
        weekday.isin(1, 7).alias("is_weekend"),
        F.lit(False).alias("is_holiday"),
    )


def build_dim_fraud_signal(spark: SparkSession) -> DataFrame:
    """All 24 combinations of the four signals, numbered from 1."""
    flags = F.array(F.lit(True), F.lit(False))
    combined = (
        spark.range(1)
        .select(F.posexplode(flags).alias("c", "cross_merchant_flag"))
        .select("*", F.posexplode(flags).alias("i", "is_international"))
        .select("*", F.posexplode(F.array(*[F.lit(t) for t in model.RISK_TIERS])).alias("r", "risk_tier"))
        .select("*", F.posexplode(flags).alias("v", "high_velocity_flag"))
    )
    signals = ["risk_tier", "cross_merchant_flag", "is_international", "high_velocity_flag"]
    return combined.select(
        (F.col("c") * 12 + F.col("i") * 6 + F.col("r") * 2 + F.col("v") + 1).alias("fraud_signal_key"),
        "cross_merchant_flag",
        "is_international",
        "risk_tier",
        "high_velocity_flag",
        signal_label(*[F.col(name) for name in signals]).alias("signal_label"),
    )


def merchant_candidates(stage: DataFrame) -> DataFrame:
    """Every distinct description of every merchant in the batch."""
    return stage.select("merchant_id", *model.MERCHANT_ATTRIBUTES).distinct()


def latest_attributes(stage: DataFrame, natural_key: str, attributes: list[str]) -> DataFrame:
    """One description per key: that of its latest transaction."""
    order = ["event_time", "transaction_id"]
    return latest_per_key(stage.select(natural_key, *order, *attributes), natural_key, order).drop(*order)


def upsert_type1(
    current: DataFrame | None,
    source: DataFrame,
    natural_key: str,
    surrogate_key: str,
    attributes: list[str],
    load_ts: dt.datetime | None = None,
) -> DataFrame:
    """The dimension after a type-1 merge, as a new frame; write it beside the old one, not over it.

    Known keys keep their surrogate key and creation time and take the source's attributes; unknown
    keys are inserted with new surrogate keys. ``source`` has one row per natural key.

    One full outer join runs source and dimension once, and its rows are stored by what happened to them. Only the new ones are
    numbered, which takes two reads of them but none of the source.
    """
    now = load_time(load_ts)
    layout = [surrogate_key, natural_key, *attributes, "dw_created_at", "dw_updated_at"]
    update = source.select(natural_key, F.struct(*attributes).alias("_update"))
    if current is None:
        merged = update.select(F.lit("new").alias("_change"), natural_key, "_update.*")
    else:
        known, hit = F.col(surrogate_key).isNotNull(), F.col("_update").isNotNull()
        merged = current.join(update, natural_key, "full").select(
            F.when(~known, "new").when(hit, "updated").otherwise("kept").alias("_change"),
            surrogate_key,
            natural_key,
            *[F.when(hit, F.col(f"_update.{name}")).otherwise(F.col(name)).alias(name) for name in attributes],
            "dw_created_at",
            F.when(hit & known, now).otherwise(F.col("dw_updated_at")).alias("dw_updated_at"),
        )
    folder = scratch_folder(source.sparkSession, f"merged-{surrogate_key}")
    merged.write.partitionBy("_change").parquet(folder)
    kept = source.sparkSession.read.schema(merged.schema).parquet(folder)
    new = kept.where("_change = 'new'").select(natural_key, *attributes)
    old = None if current is None else kept.where("_change <> 'new'").select(*layout)
    inserted = assign_surrogate_keys(new, natural_key, surrogate_key, old).withColumns({"dw_created_at": now, "dw_updated_at": now}).select(*layout)
    return inserted if old is None else old.unionByName(inserted)


def upsert_dim_merchant(current: DataFrame | None, stage: DataFrame, load_ts: dt.datetime | None = None) -> DataFrame:
    source = latest_attributes(stage, "merchant_id", model.MERCHANT_ATTRIBUTES)
    return upsert_type1(current, source, "merchant_id", "merchant_key", model.MERCHANT_ATTRIBUTES, load_ts)


def upsert_dim_customer(current: DataFrame | None, stage: DataFrame, load_ts: dt.datetime | None = None) -> DataFrame:
    """Account type and risk tier of the customer's latest transaction."""
    source = latest_attributes(stage, "customer_id", model.CUSTOMER_ATTRIBUTES)
    return upsert_type1(current, source, "customer_id", "customer_key", model.CUSTOMER_ATTRIBUTES, load_ts)
