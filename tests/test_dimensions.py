import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardflux import model
from cardflux.operators import dimensions as dims
from cardflux.operators import rows
from tests.conftest import LOAD

NEXT_LOAD = LOAD + dt.timedelta(hours=1)
MERCHANTS = (
    "merchant_id string, merchant_name string, merchant_category string, merchant_segment string, city string, state string, "
    "event_time timestamp_ntz, transaction_id string"
)


def stage(spark, *entries):
    built = [(m, name, "grocery", "everyday_spend", "Austin", "TX", dt.datetime(2025, 4, 1, hour), f"t{hour}") for m, name, hour in entries]
    return spark.createDataFrame(built, MERCHANTS)


def test_calendar_defaults(spark):
    days = dims.build_dim_date(spark)
    assert days.count() == 4018
    first, last = days.agg(F.min("full_date"), F.max("full_date")).first()
    assert (first, last) == (dt.date(2020, 1, 1), dt.date(2030, 12, 31))
    assert days.columns == [
        "date_key", "full_date", "day_of_week", "day_name", "day_of_month", "day_of_year", "week_of_year",
        "month_num", "month_name", "quarter", "year", "is_weekend", "is_holiday",
    ]


def test_calendar_row(spark):
    saturday = dims.build_dim_date(spark, dt.date(2025, 4, 12), dt.date(2025, 4, 12)).first()
    assert saturday == (20250412, dt.date(2025, 4, 12), 7, "Sat", 12, 102, 15, 4, "Apr", 2, 2025, True, False)


def test_calendar_weekends(spark):
    days = dims.build_dim_date(spark, dt.date(2025, 4, 12), dt.date(2025, 4, 18))
    assert [r["is_weekend"] for r in days.orderBy("full_date").collect()] == [True, True, False, False, False, False, False]


def test_fraud_signals(spark):
    signals = dims.build_dim_fraud_signal(spark)
    assert signals.count() == 24
    assert sorted(r[0] for r in signals.select("fraud_signal_key").collect()) == list(range(1, 25))
    assert signals.select("cross_merchant_flag", "is_international", "risk_tier", "high_velocity_flag").distinct().count() == 24
    label = {r["fraud_signal_key"]: r["signal_label"] for r in signals.collect()}
    assert label[1] == "high_cross_merchant_intl_high_velocity"
    assert label[2] == "high_cross_merchant_intl"
    assert label[24] == "low"


def test_surrogate_keys_are_dense_stable_and_continue(spark):
    names = spark.range(500).select(F.concat(F.lit("k"), "id").alias("name"))
    keyed = rows.assign_surrogate_keys(names, "name", "key", buckets=16)
    first = {r["name"]: r["key"] for r in keyed.collect()}
    assert sorted(first.values()) == list(range(1, 501))
    again = rows.assign_surrogate_keys(names.repartition(7), "name", "key", buckets=16)
    assert {r["name"]: r["key"] for r in again.collect()} == first
    more = rows.assign_surrogate_keys(spark.range(3).select(F.concat(F.lit("n"), "id").alias("name")), "name", "key", keyed)
    assert sorted(r["key"] for r in more.collect()) == [501, 502, 503]


def test_first_and_latest_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 5, "z"), ("a", 1, "w")], "k string, o int, v string")
    assert sorted(rows.first_per_key(df, "k", ["o"]).collect()) == [("a", 1, "w"), ("b", 5, "z")]
    assert sorted(rows.latest_per_key(df, "k", ["o"]).collect()) == [("a", 2, "x"), ("b", 5, "z")]


def test_copies_of_one_key_are_combined_before_the_shuffle(spark):
    df = spark.range(1000).select(F.lit("same").alias("k"), F.col("id").alias("o"))
    plan = rows.first_per_key(df, "k", ["o"])._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan and "Window" not in plan


def test_one_description_per_merchant(spark):
    batch = stage(spark, ("M1", "Old", 1), ("M1", "New", 3), ("M1", "Mid", 2), ("M2", "Other", 1))
    assert dims.merchant_candidates(batch).count() == 4
    dimension = dims.upsert_dim_merchant(None, batch, LOAD)
    assert {r["merchant_id"]: r["merchant_name"] for r in dimension.collect()} == {"M1": "New", "M2": "Other"}


def test_upsert_keeps_updates_and_inserts(spark):
    old = dims.upsert_dim_merchant(None, stage(spark, ("M1", "One", 1), ("M2", "Two", 1)), LOAD)
    new = dims.upsert_dim_merchant(old, stage(spark, ("M2", "Zwei", 2), ("M3", "Three", 2)), NEXT_LOAD)
    before = {r["merchant_id"]: r for r in old.collect()}
    after = {r["merchant_id"]: r for r in new.collect()}
    assert new.columns == ["merchant_key", "merchant_id", *model.MERCHANT_ATTRIBUTES, "dw_created_at", "dw_updated_at"]
    assert after["M1"] == before["M1"]
    assert after["M2"]["merchant_key"] == before["M2"]["merchant_key"]
    assert after["M2"]["merchant_name"] == "Zwei"
    assert (after["M2"]["dw_created_at"].hour, after["M2"]["dw_updated_at"].hour) == (0, 1)
    assert after["M3"]["merchant_key"] == 3
    assert after["M3"]["dw_created_at"] == after["M3"]["dw_updated_at"]


def test_upsert_overwrites_with_null(spark):
    old = dims.upsert_dim_merchant(None, stage(spark, ("M1", "One", 1)), LOAD)
    new = dims.upsert_dim_merchant(old, stage(spark, ("M1", None, 2)), NEXT_LOAD)
    assert new.first()["merchant_name"] is None


@pytest.mark.parametrize(("first", "second"), [("high", "low"), ("low", "high")])
def test_customer_takes_the_latest_tier(spark, first, second):
    columns = "customer_id string, account_type string, risk_tier string, event_time timestamp_ntz, transaction_id string"
    batch = spark.createDataFrame(
        [("C", "debit", second, dt.datetime(2025, 4, 2), "a"), ("C", "credit", first, dt.datetime(2025, 4, 1), "b")], columns
    )
    row = dims.upsert_dim_customer(None, batch, LOAD).first()
    assert (row["customer_key"], row["account_type"], row["risk_tier"]) == (1, "debit", second)


def test_key_checks(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", None)], "k string, v int")
    assert rows.duplicated_keys(df, ["k"]).collect() == [("a", 2)]
    assert dict(rows.null_counts(df, ["k", "v"]).collect()) == {"k": 0, "v": 1}
    dimension = spark.createDataFrame([("b",)], "k string")
    assert rows.orphan_counts(df, {"k": dimension}).collect() == [("k", 1, 2)]
