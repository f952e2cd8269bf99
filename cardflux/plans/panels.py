"""Dashboard panels: small aggregates over the views."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions import labels
from cardflux.functions.calendar import as_of_date
from cardflux.functions.rules import RULE_NAMES, all_passed
from cardflux.sources.landing import dead_letters


def latest(df: DataFrame, by: str, n: int = 500, ties: list[str] | None = None) -> DataFrame:
    """The ``n`` latest rows; ``ties`` makes the choice unique."""
    return df.orderBy(F.desc(by), *(ties or [])).limit(n)


# -- merchant panel ---------------------------------------------------------


def last_days(performance: DataFrame, as_of: dt.date | None = None, days: int = 14) -> DataFrame:
    return performance.where(F.col("txn_date") >= F.date_sub(as_of_date(as_of), days))


def merchant_kpis(performance: DataFrame) -> DataFrame:
    """Totals, the mean of the daily average tickets (each day counts once) and active merchants."""
    per_name = performance.groupBy("merchant_name").agg(
        F.sum("total_revenue_usd").alias("revenue"),
        F.sum("txn_count").alias("txns"),
        F.sum("avg_ticket_usd").alias("tickets"),
        F.count("avg_ticket_usd").alias("days"),
    )
    return per_name.agg(
        F.sum("revenue").alias("total_revenue"),
        F.sum("txns").alias("total_transactions"),
        (F.sum("tickets") / F.nullif(F.sum("days"), F.lit(0))).alias("avg_ticket"),
        F.count("merchant_name").alias("active_merchants"),
    )


def revenue_by_category(performance: DataFrame) -> DataFrame:
    totals = performance.groupBy("merchant_category").agg(F.sum("total_revenue_usd").alias("total_revenue_usd"))
    return totals.orderBy("total_revenue_usd", "merchant_category")


def revenue_share_by_segment(performance: DataFrame) -> DataFrame:
    """Revenue per segment and its share of the whole; the window spans the handful of segments."""
    totals = performance.groupBy("merchant_segment").agg(F.sum("total_revenue_usd").alias("total_revenue_usd"))
    whole = F.sum("total_revenue_usd").over(Window.partitionBy())
    return totals.withColumn("revenue_share", F.col("total_revenue_usd").cast("double") / whole.cast("double"))


def daily_revenue(performance: DataFrame) -> DataFrame:
    return performance.groupBy("txn_date").agg(F.sum("total_revenue_usd").alias("total_revenue_usd")).orderBy("txn_date")


def top_merchants_table(performance: DataFrame, n: int = 20) -> DataFrame:
    names = ["merchant_name", "merchant_category", "state"]
    return (
        performance.groupBy(*names)
        .agg(F.sum("total_revenue_usd").alias("revenue"), F.sum("txn_count").alias("txns"))
        .orderBy(F.desc("revenue"), *names)
        .limit(n)
    )


def format_top_merchants(top: DataFrame) -> DataFrame:
    return top.withColumns({"revenue": labels.money_text(F.col("revenue")), "txns": labels.count_text(F.col("txns"))})


# -- fraud panel ------------------------------------------------------------


def alert_kpis(alerts: DataFrame) -> DataFrame:
    return alerts.agg(
        F.count_if(F.col("alert_score") == 4).alias("critical_alerts"),
        F.count_if(F.col("alert_score").isin(2, 3)).alias("medium_alerts"),
        F.count_if("is_international").alias("international_txns"),
        F.count_if("cross_merchant_flag").alias("cross_merchant_events"),
    )


def alert_score_distribution(alerts: DataFrame) -> DataFrame:
    counts = alerts.groupBy(F.col("alert_score").alias("score")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy("score")


def signal_heatmap(alerts: DataFrame) -> DataFrame:
    """Alerts per merchant category (rows) and risk tier (columns), zero where there is none."""
    return alerts.groupBy("merchant_category").pivot("risk_tier", sorted(model.RISK_TIERS)).count().na.fill(0)


def velocity_profile(alerts: DataFrame) -> DataFrame:
    return alerts.select(
        "txn_count_last_1h",
        "spend_velocity_24h",
        "risk_tier",
        "amount_usd",
        "customer_id",
        "merchant_name",
        "channel",
        "alert_score",
    )


def alert_feed(alerts: DataFrame, n: int = 50) -> DataFrame:
    """Highest scores first, the most recent of a score first."""
    shown = alerts.select(
        "event_time",
        "transaction_id",
        "customer_id",
        "merchant_name",
        "amount_usd",
        "alert_score",
        "risk_tier",
        "cross_merchant_flag",
        "is_international",
        "channel",
    )
    top = shown.orderBy(F.desc("alert_score"), F.desc("event_time"), "transaction_id").limit(n)
    return top.withColumn("amount_usd", labels.money_text(F.col("amount_usd")))


# -- customer panel ---------------------------------------------------------


def customer_kpis(profiles: DataFrame) -> DataFrame:
    return profiles.agg(
        F.count(F.lit(1)).alias("total_customers"),
        (F.sum("lifetime_spend_usd").cast("double") / F.count("lifetime_spend_usd")).alias("avg_lifetime_spend"),
        F.count_if(F.col("risk_tier") == "high").alias("high_risk_customers"),
        F.count_if(F.col("spend_segment") == "platinum").alias("platinum_customers"),
    )


def spend_segment_distribution(profiles: DataFrame) -> DataFrame:
    """Customers per spend segment, from platinum to bronze."""
    counts = profiles.groupBy(F.col("spend_segment").alias("segment")).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("segment_rank", labels.segment_rank(F.col("segment"))).orderBy("segment_rank")


def recency_frequency(profiles: DataFrame) -> DataFrame:
    return profiles.select("customer_id", "recency_days", "txn_frequency_per_day", "spend_segment", "lifetime_spend_usd")


def customer_table(profiles: DataFrame, n: int = 100) -> DataFrame:
    shown = profiles.select(
        "customer_id",
        "account_type",
        "risk_tier",
        "spend_segment",
        "lifetime_txn_count",
        "lifetime_spend_usd",
        "avg_txn_usd",
        "recency_days",
        "distinct_merchants_visited",
    )
    formatted = {name: labels.money_text(F.col(name)) for name in ("lifetime_spend_usd", "avg_txn_usd")}
    return shown.orderBy("customer_id").limit(n).withColumns(formatted)


# -- health panel -----------------------------------------------------------


def health_report(fact: DataFrame, flagged: DataFrame, parsed: DataFrame, as_of: dt.date | None = None) -> DataFrame:
    """One row about the day ``as_of``: loads, latency, quarantine, violations and dead letters.

    ``flagged`` are rows with rule verdicts; ``parsed`` are topic records after parsing, with the
    topic's ``timestamp``. Each input is cut to the day and reduced to one row on its own. A record whose
    event time does not parse belongs to the day of its arrival.
    """
    day = as_of_date(as_of)
    loaded = fact.where(F.col("ingest_date") == day)
    loads = loaded.groupBy("dw_loaded_at").agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(F.unix_timestamp("dw_loaded_at") - F.unix_timestamp("event_time")).alias("lag_s"),
        F.count("event_time").alias("timed"),
    )
    load = loads.agg(
        F.max("dw_loaded_at").alias("last_flush"),
        F.coalesce(F.max_by("rows", "dw_loaded_at"), F.lit(0)).alias("records_last_batch"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("total_loaded_today"),
        labels.ratio(F.sum("lag_s"), F.sum("timed"), 1).alias("load_latency_s"),
    )
    broken = sum((F.when(F.col(name), 0).otherwise(1) for name in RULE_NAMES[1:]), F.when(F.col(RULE_NAMES[0]), 0).otherwise(1))
    checked_on = F.coalesce("ingest_date", F.to_date(F.try_to_timestamp("kafka_ingest_time")))
    quality = flagged.where(checked_on == day).agg(
        F.coalesce(labels.ratio(F.count_if(~all_passed()) * 100, F.count(F.lit(1)), 2), F.lit(0.0)).alias("quarantine_rate_pct"),
        F.coalesce(F.sum(broken), F.lit(0)).alias("schema_violations_today"),
    )
    dead = dead_letters(parsed).where(F.to_date("timestamp") == day).agg(F.count(F.lit(1)).alias("dlq_count_today"))
    measured = quality.select(F.struct("*")).scalar()
    return load.select(
        "*",
        *[measured.getField(name).alias(name) for name in quality.columns],
        dead.scalar().alias("dlq_count_today"),
    )


# Label of a check, its health column and the value above which it warns.
SCORECARD = [
    ("Failed rule checks", "schema_violations_today", 5.0),
    ("Records that do not parse", "dlq_count_today", 5.0),
    ("Share of rejected records in percent", "quarantine_rate_pct", 1.0),
]


def quality_scorecard(health: DataFrame) -> DataFrame:
    lines = [
        F.struct(F.lit(label).alias("check_name"), F.col(name).cast("double").alias("value"), F.lit(limit).alias("threshold"))
        for label, name, limit in SCORECARD
    ]
    status = F.when(F.col("value") > F.col("threshold"), "WARN").otherwise("OK")
    return health.select(F.inline(F.array(*lines))).withColumn("status", status)


def load_freshness(loads: DataFrame, now: dt.datetime | None = None, fresh_minutes: int = 10) -> DataFrame:
    """Whole minutes since the last load; green below the limit. ``loads`` is the load log, a row per load."""
    current = (F.current_timestamp() if now is None else F.lit(now.replace(tzinfo=now.tzinfo or dt.timezone.utc))).cast("timestamp_ntz")
    age = F.floor((F.unix_timestamp(current) - F.unix_timestamp("last_load")) / 60)
    return (
        loads.agg(F.max("dw_loaded_at").alias("last_load"))
        .withColumn("age_minutes", age)
        .withColumn("status", F.when(F.col("age_minutes") < fresh_minutes, "green").otherwise("red"))
    )
