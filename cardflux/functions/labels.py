"""Labels, tiers and display formats derived from other columns."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflux.model import LIMITS, OTHER_SEGMENT, SEGMENT_OF_CATEGORY, SPEND_SEGMENTS, Limits


def risk_tier(spend_24h: Column, limits: Limits = LIMITS) -> Column:
    return (
        F.when(spend_24h >= limits.risk_high_from, "high")
        .when(spend_24h >= limits.risk_medium_from, "medium")
        .otherwise("low")
    )


def merchant_segment(category: Column) -> Column:
    lookup = F.create_map(*[F.lit(text) for text in chain(*SEGMENT_OF_CATEGORY.items())])
    return F.coalesce(lookup[category], F.lit(OTHER_SEGMENT))


def high_velocity(txn_count_1h: Column, limits: Limits = LIMITS) -> Column:
    return txn_count_1h > limits.high_velocity_above


def signal_label(tier: Column, cross_merchant: Column, international: Column, velocity: Column) -> Column:
    def suffix(flag: Column, text: str) -> Column:
        return F.when(flag, text).otherwise("")

    return F.concat(
        tier,
        suffix(cross_merchant, "_cross_merchant"),
        suffix(international, "_intl"),
        suffix(velocity, "_high_velocity"),
    )


def alert_severity(tier: Column, cross_merchant: Column, international: Column, velocity: Column) -> Column:
    return (
        F.when((tier == "high") & (velocity | cross_merchant | international), "critical")
        .when(velocity | cross_merchant, "high")
        .when(international | (tier == "high"), "medium")
        .otherwise("low")
    )


def alert_score(severity: Column) -> Column:
    return F.when(severity == "critical", 4).when(severity == "high", 3).when(severity == "medium", 2).otherwise(1)


def spend_segment(lifetime_spend: Column, limits: Limits = LIMITS) -> Column:
    return (
        F.when(lifetime_spend >= limits.platinum_from, "platinum")
        .when(lifetime_spend >= limits.gold_from, "gold")
        .when(lifetime_spend >= limits.silver_from, "silver")
        .otherwise("bronze")
    )


def segment_rank(segment: Column) -> Column:
    """Position of a spend segment from best (1) to lowest."""
    return F.array_position(F.array(*[F.lit(name) for name in SPEND_SEGMENTS]), segment).cast("int")


def ratio(part: Column, whole: Column, digits: int) -> Column:
    """``part / whole`` of two integer columns, rounded half up without binary error; NULL for a zero whole."""
    exact = part.cast("decimal(20,0)") / F.nullif(whole.cast("decimal(20,0)"), F.lit(0))
    return F.round(exact, digits).cast("double")


def money_text(amount: Column) -> Column:
    return F.concat(F.lit("$"), F.format_number(amount, 2))


def count_text(count: Column) -> Column:
    return F.format_number(count, 0)
