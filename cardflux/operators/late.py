"""Late rows: rows that arrive after later ones of their customer were already written.

A late row changes the rolling features of the customer's rows up to a day after it. Those rows are found by customer and
day, taken out, and computed anew together with the late ones, on the history that is left; all others stay as they are.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cardflux import model
from cardflux.model import LIMITS, Limits
from cardflux.operators.enrichment import add_merchant_segment, add_risk_tier, add_time_features
from cardflux.operators.velocity import add_velocity_features

REVISED = ["txn_count_last_1h", "distinct_merchants_1h", "spend_velocity_24h", "cross_merchant_flag", "risk_tier"]


def days_in_reach(late: DataFrame) -> DataFrame:
    """``customer_id, ingest_date``: the days of each late row's customer on which rows can change: its own and the next one."""
    days = F.explode(F.array(F.col("ingest_date"), F.date_add("ingest_date", 1))).alias("ingest_date")
    return late.select("customer_id", days).distinct()


def revised_rows(curated: DataFrame, late: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The late rows (``late`` is validated, not yet enriched) and the curated rows that they change, with the features of one batch.

    They replace the curated rows of the same customers and days. The days are a list per customer, not a join over time, and
    history is pruned to the day before the earliest of them.
    """
    reach = days_in_reach(late)
    keys = ["customer_id", "ingest_date"]
    changed = curated.join(reach, keys, "left_semi")
    base = [name for name in model.CURATED_COLUMNS if name not in REVISED]
    batch = changed.select(*base).unionByName(add_merchant_segment(add_time_features(late)).select(*base))
    history = curated.join(reach, keys, "left_anti")
    return add_risk_tier(add_velocity_features(batch, history, limits), limits).select(*model.CURATED_COLUMNS)


def with_late_rows(curated: DataFrame, late: DataFrame, limits: Limits = LIMITS) -> DataFrame:
    """The curated table after late rows came in: what they do not reach stays, the rest is revised.

    ``curated`` and ``late`` have to be stored, as both are read several times.
    """
    untouched = curated.join(days_in_reach(late), ["customer_id", "ingest_date"], "left_anti").select(*model.CURATED_COLUMNS)
    return untouched.unionByName(revised_rows(curated, late, limits))
