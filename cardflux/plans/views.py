"""Analytical views over the star schema.

Each view aggregates the fact on its surrogate keys before it joins a dimension, so the joins see
one row per group and a hot merchant or customer is combined before any shuffle.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions import labels
from cardflux.functions.calendar import as_of_date
from cardflux.model import LIMITS, Limits
from cardflux.operators.star import Star


def merchant_daily_performance(star: Star, since: dt.date | None = None) -> DataFrame:
    """Revenue, volume and ticket sizes per merchant and day, with rolling and day-over-day revenue.

    "Rolling 7" and "previous day" count the merchant's days with sales, not calendar days. ``since``
    prunes the fact to its partitions from that day on; rolling and previous values then start there,
    too, so use it for panels that take neither.
    """
    fact = star.fact if since is None else star.fact.where(F.col("ingest_date") >= F.lit(since))
    daily = fact.groupBy("merchant_key", "date_key").agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.sum("amount_usd").alias("total_revenue_usd"),
        F.max("amount_usd").alias("max_ticket_usd"),
        F.min("amount_usd").alias("min_ticket_usd"),
    )
    days = star.dates.select("date_key", F.col("full_date").alias("txn_date"), "month_name", "quarter", "year")
    merchants = star.merchants.select(
        "merchant_key", "merchant_id", "merchant_name", "merchant_category", "merchant_segment", "state"
    )
    by_day = Window.partitionBy("merchant_id").orderBy("txn_date")
    revenue = F.col("total_revenue_usd")
    previous = F.lag(revenue).over(by_day)
    return (
        daily.join(F.broadcast(days), "date_key")  # one row per calendar day
        .join(merchants, "merchant_key")
        .select(
            "txn_date",
            "month_name",
            "quarter",
            "year",
            "merchant_id",
            "merchant_name",
            "merchant_category",
            "merchant_segment",
            "state",
            "txn_count",
            revenue,
            (revenue.cast("double") / F.col("txn_count")).alias("avg_ticket_usd"),
            "max_ticket_usd",
            "min_ticket_usd",
            F.sum(revenue).over(by_day.rowsBetween(-6, Window.currentRow)).alias("revenue_rolling_7d"),
            previous.alias("prev_day_revenue"),
            (revenue - previous).alias("revenue_dod_delta"),
        )
    )


def fraud_velocity_alerts(star: Star) -> DataFrame:
    """One row per transaction with a risky signal.

    Signals and severity are properties of the 24 signal rows: they are filtered and labelled
    there, and the broadcast join drops quiet transactions before customers and merchants are joined.
    """
    flags = [F.col(name) for name in ("risk_tier", "cross_merchant_flag", "is_international", "high_velocity_flag")]
    tier, cross_merchant, international, velocity = flags
    risky = (
        star.signals.where(velocity | cross_merchant | international | (tier == "high"))
        .withColumn("alert_severity", labels.alert_severity(*flags))
        .withColumn("alert_score", labels.alert_score(F.col("alert_severity")))
    )
    customers = star.customers.select(
        "customer_key", "customer_id", "account_type", F.col("risk_tier").alias("customer_risk_tier")
    )
    merchants = star.merchants.select("merchant_key", "merchant_id", *model.MERCHANT_ATTRIBUTES)
    return (
        star.fact.join(F.broadcast(risky), "fraud_signal_key")
        .join(merchants, "merchant_key")
        .join(customers, "customer_key")
        .select(
            "event_time",
            "ingest_date",
            "customer_id",
            "account_type",
            "customer_risk_tier",
            "merchant_id",
            *model.MERCHANT_ATTRIBUTES,
            "transaction_id",
            "amount_usd",
            "currency",
            "channel",
            "transaction_type",
            "txn_count_last_1h",
            "distinct_merchants_1h",
            "spend_velocity_24h",
            "cross_merchant_flag",
            "is_international",
            "high_velocity_flag",
            "risk_tier",
            "signal_label",
            "alert_severity",
            "alert_score",
        )
    )


def customer_spend_profile(star: Star, as_of: dt.date | None = None, limits: Limits = LIMITS) -> DataFrame:
    """Lifetime recency, frequency and spend per customer.

    Distinct merchants and categories come from stepwise groupings (customer and merchant, customer
    and category, customer), which combine in the map tasks; no row is copied per distinct count.
    """
    signals = star.signals.select("fraud_signal_key", "cross_merchant_flag", "is_international")
    per_merchant = (
        star.fact.join(F.broadcast(signals), "fraud_signal_key")
        .groupBy("customer_key", "merchant_key")
        .agg(
            F.count(F.lit(1)).alias("txns"),
            F.sum("amount_usd").alias("spend"),
            F.max("event_time").alias("last"),
            F.min("event_time").alias("first"),
            F.count_if("cross_merchant_flag").alias("cross_merchant"),
            F.count_if("is_international").alias("intl"),
        )
    )

    def totals():
        return [
            F.sum("txns").alias("txns"),
            F.sum("spend").alias("spend"),
            F.max("last").alias("last"),
            F.min("first").alias("first"),
            F.sum("cross_merchant").alias("cross_merchant"),
            F.sum("intl").alias("intl"),
        ]

    merchants = star.merchants.select("merchant_key", "merchant_id", "merchant_category")
    per_customer = (
        per_merchant.join(merchants, "merchant_key")
        .groupBy("customer_key", "merchant_category")
        .agg(*totals(), F.count("merchant_id").alias("merchants"))
        .groupBy("customer_key")
        .agg(*totals(), F.sum("merchants").alias("merchants"), F.count("merchant_category").alias("categories"))
    )
    first_day, last_day = F.to_date("first"), F.to_date("last")
    active_days = F.datediff(last_day, first_day)
    return per_customer.join(
        star.customers.select("customer_key", "customer_id", "account_type", "risk_tier"), "customer_key"
    ).select(
        "customer_id",
        "account_type",
        "risk_tier",
        F.col("txns").alias("lifetime_txn_count"),
        F.col("spend").alias("lifetime_spend_usd"),
        (F.col("spend").cast("double") / F.col("txns")).alias("avg_txn_usd"),
        F.col("last").alias("last_txn_time"),
        F.col("first").alias("first_txn_time"),
        active_days.alias("active_days"),
        F.col("merchants").alias("distinct_merchants_visited"),
        F.col("categories").alias("distinct_categories_visited"),
        F.col("cross_merchant").alias("cross_merchant_events"),
        F.col("intl").alias("intl_txn_count"),
        F.datediff(as_of_date(as_of), last_day).alias("recency_days"),
        labels.ratio(F.col("txns"), active_days, 2).alias("txn_frequency_per_day"),
        labels.spend_segment(F.col("spend"), limits).alias("spend_segment"),
    )


def top_merchants(star: Star, as_of: dt.date | None = None, days: int = 30, n: int = 10) -> DataFrame:
    """Highest revenue by merchant name and category since ``days`` before ``as_of``.

    The cut on the fact's own partition column prunes its scan; the date dimension keeps the rows
    to known days.
    """
    since = F.date_sub(as_of_date(as_of), days)
    recent = (
        star.fact.where(F.col("ingest_date") >= since)
        .join(F.broadcast(star.dates.where(F.col("full_date") >= since).select("date_key")), "date_key")
        .groupBy("merchant_key")
        .agg(F.sum("amount_usd").alias("revenue"), F.count("transaction_id").alias("txns"))
    )
    return (
        recent.join(star.merchants.select("merchant_key", "merchant_name", "merchant_category"), "merchant_key")
        .groupBy("merchant_name", "merchant_category")
        .agg(F.sum("revenue").alias("total_revenue"), F.sum("txns").alias("txn_count"))
        .orderBy(F.desc("total_revenue"), "merchant_name", "merchant_category")
        .limit(n)
    )


def high_velocity_signals(star: Star, limits: Limits = LIMITS) -> DataFrame:
    """How often each customer showed each combination of velocity values, most frequent first."""
    signals = star.signals.select("fraud_signal_key", "cross_merchant_flag")
    values = ["txn_count_last_1h", "spend_velocity_24h", "cross_merchant_flag"]
    striking = (
        (F.col("txn_count_last_1h") > limits.high_velocity_above)
        | F.col("cross_merchant_flag")
        | (F.col("spend_velocity_24h") > limits.signal_spend_above)
    )
    return (
        star.fact.join(F.broadcast(signals), "fraud_signal_key")
        .where(striking)
        .groupBy("customer_key", *values)
        .agg(F.count(F.lit(1)).alias("alert_count"))
        .join(star.customers.select("customer_key", "customer_id"), "customer_key")
        .select("customer_id", *values, "alert_count")
        .orderBy(F.desc("alert_count"), "customer_id", *values)
    )


def register_views(star: Star, as_of: dt.date | None = None) -> None:
    """Expose tables and views to SQL under their usual names."""
    frames = {
        "fact_transactions": star.fact,
        "dim_customer": star.customers,
        "dim_merchant": star.merchants,
        "dim_date": star.dates,
        "dim_fraud_signal": star.signals,
        "merchant_daily_performance_v": merchant_daily_performance(star),
        "fraud_velocity_alerts_v": fraud_velocity_alerts(star),
        "customer_spend_profile_v": customer_spend_profile(star, as_of),
    }
    for name, frame in frames.items():
        frame.createOrReplaceTempView(name)
