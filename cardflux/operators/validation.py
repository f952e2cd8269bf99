"""Type enforcement, rule flags and the valid/invalid split."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux.functions.rules import RULE_NAMES, all_passed, failed_list, rules
from cardflux.model import LIMITS, Limits


def enforce_schema(raw: DataFrame) -> DataFrame:
    """Typed amount and flag, parsed event time, and the UTC day of the event.

    Text that does not parse becomes NULL, for the rules to reject, instead of ending the job.
    """
    return raw.withColumns(
        {
            "amount_usd": F.col("amount_usd").try_cast("double"),
            "is_international": F.col("is_international").try_cast("boolean"),
            "event_time_ts": F.try_to_timestamp(F.col("event_time").cast("string")),
        }
    ).withColumn("ingest_date", F.to_date("event_time_ts"))


def flag_rules(typed: DataFrame, now: dt.datetime | None = None, limits: Limits = LIMITS) -> DataFrame:
    return typed.withColumns(rules(now, limits))


def split_flagged(flagged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that pass every rule (helper columns dropped) and rows that do not (with the reasons)."""
    judged = flagged.withColumn("_is_valid", all_passed())
    valid = judged.where("_is_valid").drop(*RULE_NAMES, "_is_valid")
    return valid, with_reasons(judged.where("NOT _is_valid"))


def with_reasons(rejected: DataFrame) -> DataFrame:
    return rejected.withColumns({"_quarantine_ts": F.current_timestamp(), "_failed_checks": failed_list()})


def validation_counts() -> list:
    """Aggregates for one pass over flagged rows; usable in ``agg`` and in ``observe``."""
    return [
        F.count(F.lit(1)).alias("total"),
        F.count_if(all_passed()).alias("passed"),
        F.count_if(~all_passed()).alias("quarantined"),
    ]


def validation_summary(flagged: DataFrame) -> DataFrame:
    return flagged.agg(*validation_counts())


def rule_failures(flagged: DataFrame) -> DataFrame:
    """How many rows broke each rule: one aggregated row, turned into one row per rule."""
    counted = flagged.agg(*[F.count_if(~F.col(name)).alias(name) for name in RULE_NAMES])
    return counted.unpivot([], RULE_NAMES, "rule", "failures")
