"""Record layouts, enumerations and thresholds shared by every stage."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql.types import (
    BooleanType,
    DateType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

# ---------------------------------------------------------------------------
# They decide which rows pass and how they are labelled.
# ---------------------------------------------------------------------------
ACCOUNT_TYPES = ["checking", "credit", "debit"]
TRANSACTION_TYPES = ["purchase", "refund", "chargeback", "atm_withdrawal"]
CHANNELS = ["in_store", "online", "mobile", "contactless"]
MERCHANT_CATEGORIES = [
    "grocery",
    "restaurant",
    "gas_station",
    "pharmacy",
    "retail_clothing",
    "electronics",
    "travel_hotel",
    "travel_airline",
    "entertainment",
    "healthcare",
    "subscription_services",
    "atm",
]
SEGMENT_OF_CATEGORY = {
    "grocery": "everyday_spend",
    "restaurant": "everyday_spend",
    "gas_station": "everyday_spend",
    "pharmacy": "healthcare_wellness",
    "healthcare": "healthcare_wellness",
    "retail_clothing": "discretionary",
    "electronics": "discretionary",
    "entertainment": "discretionary",
    "travel_hotel": "travel",
    "travel_airline": "travel",
    "subscription_services": "recurring",
    "atm": "cash_access",
}
OTHER_SEGMENT = "other"
RISK_TIERS = ["high", "medium", "low"]
SPEND_SEGMENTS = ["platinum", "gold", "silver", "bronze"]
TRANSACTION_ID_PATTERN = r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"

HOUR = 3_600
DAY = 86_400


@dataclass(frozen=True)
class Limits:
    """Business thresholds; pass another instance to change any of them."""

    min_amount: float = 0.01
    max_amount: float = 50_000.0
    cross_merchant_at_least: int = 5
    high_velocity_above: int = 10
    risk_high_from: float = 5_000.0
    risk_medium_from: float = 1_000.0
    signal_spend_above: float = 5_000.0
    platinum_from: int = 50_000
    gold_from: int = 10_000
    silver_from: int = 1_000


LIMITS = Limits()


# The layouts of raw events and curated rows, which feeds and readers rely on.
RAW_SCHEMA = StructType(
    [
        StructField("transaction_id", StringType()),
        StructField("customer_id", StringType()),
        StructField("merchant_id", StringType()),
        StructField("merchant_name", StringType()),
        StructField("merchant_category", StringType()),
        StructField("city", StringType()),
        StructField("state", StringType()),
        StructField("amount_usd", DoubleType()),
        StructField("currency", StringType()),
        StructField("account_type", StringType()),
        StructField("transaction_type", StringType()),
        StructField("channel", StringType()),
        StructField("event_time", StringType()),
        StructField("kafka_ingest_time", StringType()),
        StructField("is_international", BooleanType()),
        StructField("zip_code", StringType()),
    ]
)

CURATED_SCHEMA = StructType(
    [
        StructField("transaction_id", StringType()),
        StructField("customer_id", StringType()),
        StructField("merchant_id", StringType()),
        StructField("merchant_name", StringType()),
        StructField("merchant_category", StringType()),
        StructField("merchant_segment", StringType()),
        StructField("city", StringType()),
        StructField("state", StringType()),
        StructField("amount_usd", DoubleType()),
        StructField("currency", StringType()),
        StructField("account_type", StringType()),
        StructField("transaction_type", StringType()),
        StructField("channel", StringType()),
        StructField("is_international", BooleanType()),
        StructField("zip_code", StringType()),
        StructField("event_time", StringType()),
        StructField("event_time_ts", TimestampType()),
        StructField("ingest_date", DateType()),
        StructField("hour_of_day", IntegerType()),
        StructField("day_of_week", IntegerType()),
        StructField("week_of_year", IntegerType()),
        StructField("txn_count_last_1h", LongType()),
        StructField("distinct_merchants_1h", LongType()),
        StructField("spend_velocity_24h", DoubleType()),
        StructField("cross_merchant_flag", BooleanType()),
        StructField("risk_tier", StringType()),
    ]
)
CURATED_COLUMNS = CURATED_SCHEMA.fieldNames()

# Warehouse types. A 24 h total can exceed what a single amount can, so it is wider.
AMOUNT_TYPE = "decimal(12,2)"
TOTAL_TYPE = "decimal(18,2)"
STAGE_COLUMNS = [name for name in CURATED_COLUMNS if name != "event_time_ts"]

MERCHANT_ATTRIBUTES = ["merchant_name", "merchant_category", "merchant_segment", "city", "state"]
CUSTOMER_ATTRIBUTES = ["account_type", "risk_tier"]

# The fact table's layout.
FACT_COLUMNS = [
    "transaction_sk",
    "customer_key",
    "merchant_key",
    "date_key",
    "fraud_signal_key",
    "transaction_id",
    "amount_usd",
    "txn_count_last_1h",
    "distinct_merchants_1h",
    "spend_velocity_24h",
    "hour_of_day",
    "day_of_week",
    "transaction_type",
    "channel",
    "currency",
    "event_time",
    "ingest_date",
    "dw_loaded_at",
]

FACT_SCHEMA = (
    "transaction_sk long, customer_key long, merchant_key long, date_key int, fraud_signal_key int, transaction_id string, "
    "amount_usd decimal(12,2), txn_count_last_1h long, distinct_merchants_1h long, spend_velocity_24h decimal(18,2), "
    "hour_of_day int, day_of_week int, transaction_type string, channel string, currency string, event_time timestamp_ntz, "
    "ingest_date date, dw_loaded_at timestamp_ntz"
)
# Columns that a table declares unique and NOT NULL.
DECLARED_UNIQUE = {"dim_customer": ["customer_id"], "dim_merchant": ["merchant_id"], "dim_date": ["full_date"], "dim_fraud_signal": ["signal_label"], "fact": ["transaction_id"]}
FACT_REQUIRED = ["transaction_id", "customer_key", "merchant_key", "date_key", "fraud_signal_key", "amount_usd", "event_time"]
