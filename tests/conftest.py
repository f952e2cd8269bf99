import datetime as dt

import pytest
from pyspark.sql import SparkSession

from cardflux.model import RAW_SCHEMA
from cardflux.session import SETTINGS

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
LOAD = dt.datetime(2025, 5, 1, tzinfo=dt.timezone.utc)

PLAIN = {
    "transaction_id": "0f3c6d52-77aa-4be1-9c08-51d2e6a4b7f3",
    "customer_id": "C-0042",
    "merchant_id": "M-0007",
    "merchant_name": "Harbour Bakery",
    "merchant_category": "restaurant",
    "city": "Ostermouth",
    "state": "OM",
    "amount_usd": 18.25,
    "currency": "USD",
    "account_type": "credit",
    "transaction_type": "purchase",
    "channel": "online",
    "event_time": "2025-02-12T08:05:00+00:00",
    "kafka_ingest_time": "2025-02-12T08:05:04+00:00",
    "is_international": False,
    "zip_code": "77001",
}


def record(**changes):
    """A valid transaction, with changes."""
    return PLAIN | changes


def uuid(number: int) -> str:
    return f"00000000-0000-0000-0000-{number:012x}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    builder = SparkSession.builder.master("local[4]").appName("cardflux-tests")
    builder = builder.config("spark.sql.shuffle.partitions", "4").config("spark.ui.enabled", "false")
    builder = builder.config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("warehouse")))
    builder = builder.config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
    for name, value in SETTINGS.items():
        builder = builder.config(name, value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def raw(spark):
    def build(*records):
        return spark.createDataFrame([tuple(r[n] for n in RAW_SCHEMA.fieldNames()) for r in records], RAW_SCHEMA)

    return build
