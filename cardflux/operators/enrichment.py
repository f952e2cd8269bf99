"""Time features, risk tier and merchant segment on top of the rolling features."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.functions.labels import merchant_segment, risk_tier
from cardflux.model import CURATED_COLUMNS, LIMITS, OTHER_SEGMENT, Limits
from cardflux.operators.velocity import add_velocity_features


def add_time_features(df: DataFrame) -> DataFrame:
    """Hour, day of week (1 = Sunday ... 7 = Saturday) and ISO week of the event, in UTC."""
    return df.withColumns(
        {
            "hour_of_day": F.hour("event_time_ts"),
            "day_of_week": F.dayofweek("event_time_ts"),
            "week_of_year": F.weekofyear("event_time_ts"),
        }
    )


def add_risk_tier(df: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    return df.withColumn("risk_tier", risk_tier(F.col("spend_velocity_24h"), limits))


def add_merchant_segment(df: DataFrame) -> DataFrame:
    return df.withColumn("merchant_segment", merchant_segment(F.col("merchant_category")))


def add_merchant_segment_from(df: DataFrame, segments: DataFrame) -> DataFrame:
    """The same lookup against a table ``(merchant_category, merchant_segment)``.

    Spark broadcasts the table when it is small enough and splits a hot category otherwise.
    """
    return df.join(segments, "merchant_category", "left").withColumn(
        "merchant_segment", F.coalesce("merchant_segment", F.lit(OTHER_SEGMENT))
    )


def enrich(
    valid: DataFrame, history: DataFrame | None = None, limits: Limits = LIMITS, approx: bool = False
) -> DataFrame:
    """Validated rows to curated rows."""
    featured = add_velocity_features(valid, history, limits, approx)
    return add_merchant_segment(add_risk_tier(add_time_features(featured), limits)).select(*CURATED_COLUMNS)
