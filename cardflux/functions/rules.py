"""Validation rules as named boolean columns."""

from __future__ import annotations

import datetime as dt
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from cardflux import model
from cardflux.model import LIMITS, Limits


def rules(now: dt.datetime | None = None, limits: Limits = LIMITS) -> dict[str, Column]:
    """Rule name to verdict, in report order.

    A verdict is never NULL: what cannot be shown to hold counts as failed, so that each row lands
    on exactly one side of the split. ``now`` fixes the latest accepted event time.
    """
    latest = F.current_timestamp() if now is None else F.lit(now.replace(tzinfo=now.tzinfo or dt.timezone.utc))
    verdicts = {
        "_chk_txn_id_notnull": F.col("transaction_id").isNotNull(),
        "_chk_customer_notnull": F.col("customer_id").isNotNull(),
        "_chk_merchant_notnull": F.col("merchant_id").isNotNull(),
        "_chk_amount_notnull": F.col("amount_usd").isNotNull(),
        "_chk_event_time_notnull": F.col("event_time").isNotNull(),
        "_chk_amount_range": F.col("amount_usd").between(limits.min_amount, limits.max_amount),
        "_chk_account_type": F.col("account_type").isin(model.ACCOUNT_TYPES),
        "_chk_txn_type": F.col("transaction_type").isin(model.TRANSACTION_TYPES),
        "_chk_channel": F.col("channel").isin(model.CHANNELS),
        "_chk_category": F.col("merchant_category").isin(model.MERCHANT_CATEGORIES),
        "_chk_event_time_valid": F.col("event_time_ts") <= latest,
        "_chk_txn_id_format": F.col("transaction_id").rlike(model.TRANSACTION_ID_PATTERN),
    }
    return {name: F.coalesce(verdict, F.lit(False)) for name, verdict in verdicts.items()}


RULE_NAMES = [
    "_chk_txn_id_notnull",
    "_chk_customer_notnull",
    "_chk_merchant_notnull",
    "_chk_amount_notnull",
    "_chk_event_time_notnull",
    "_chk_amount_range",
    "_chk_account_type",
    "_chk_txn_type",
    "_chk_channel",
    "_chk_category",
    "_chk_event_time_valid",
    "_chk_txn_id_format",
]


def all_passed(names: list[str] = RULE_NAMES) -> Column:
    """The amount, which is cheap to judge, comes first: a row that fails it is not parsed and matched any further."""
    return reduce(and_, [F.col(name) for name in sorted(names, key=lambda name: name != "_chk_amount_range")])


def failed_list(names: list[str] = RULE_NAMES) -> Column:
    """Comma-separated names of the rules a row broke."""
    return F.concat_ws(",", *[F.when(~F.col(name), F.lit(name)) for name in names])
