import datetime as dt

import pytest
from pyspark.sql import functions as F

from cardflux.functions.rules import RULE_NAMES, rules
from cardflux.model import Limits
from cardflux.operators.validation import enforce_schema, flag_rules, rule_failures, split_flagged, validation_summary
from cardflux.plans.jobs import NothingValid, run_validation
from tests.conftest import NOW, record, uuid


def flags(df):
    return flag_rules(enforce_schema(df), NOW).select(*RULE_NAMES).collect()[0].asDict()


def test_types_after_enforcement(raw):
    types = dict(enforce_schema(raw(record())).dtypes)
    assert types["amount_usd"] == "double"
    assert types["event_time_ts"] == "timestamp"
    assert types["ingest_date"] == "date"
    assert types["is_international"] == "boolean"


def test_names_listed_in_rule_order(spark):
    assert list(rules(NOW)) == RULE_NAMES


def test_clean_row_passes_every_rule(raw):
    assert all(flags(raw(record())).values())


@pytest.mark.parametrize(
    ("change", "rule"),
    [
        ({"transaction_id": None}, "_chk_txn_id_notnull"),
        ({"customer_id": None}, "_chk_customer_notnull"),
        ({"merchant_id": None}, "_chk_merchant_notnull"),
        ({"amount_usd": None}, "_chk_amount_notnull"),
        ({"event_time": None}, "_chk_event_time_notnull"),
        ({"amount_usd": -5.0}, "_chk_amount_range"),
        ({"amount_usd": 61_234.5}, "_chk_amount_range"),
        ({"amount_usd": 0.009}, "_chk_amount_range"),
        ({"amount_usd": 50_000.01}, "_chk_amount_range"),
        ({"amount_usd": float("nan")}, "_chk_amount_range"),
        ({"account_type": "brokerage"}, "_chk_account_type"),
        ({"account_type": None}, "_chk_account_type"),
        ({"transaction_type": "gift"}, "_chk_txn_type"),
        ({"transaction_type": None}, "_chk_txn_type"),
        ({"channel": "carrier_pigeon"}, "_chk_channel"),
        ({"channel": None}, "_chk_channel"),
        ({"merchant_category": "pawn_shop"}, "_chk_category"),
        ({"merchant_category": None}, "_chk_category"),
        ({"event_time": "not-a-time"}, "_chk_event_time_valid"),
        ({"event_time": "2026-01-02T00:00:00+00:00"}, "_chk_event_time_valid"),
        ({"transaction_id": "0f3c6d52"}, "_chk_txn_id_format"),
        ({"transaction_id": "0F3C6D52-77AA-4BE1-9C08-51D2E6A4B7F3"}, "_chk_txn_id_format"),
    ],
)
def test_each_rule_rejects(raw, change, rule):
    df = raw(record(**change))
    assert flags(df)[rule] is False
    valid, invalid = split_flagged(flag_rules(enforce_schema(df), NOW))
    assert valid.count() == 0
    assert rule in invalid.collect()[0]["_failed_checks"].split(",")


@pytest.mark.parametrize("amount", [0.01, 50_000.00])
def test_amount_bounds_are_inside(raw, amount):
    assert flags(raw(record(amount_usd=amount)))["_chk_amount_range"]


def test_limits_are_parameters(raw):
    flagged = flag_rules(enforce_schema(raw(record(amount_usd=60_000.0))), NOW, Limits(max_amount=70_000.0))
    assert flagged.first()["_chk_amount_range"]


def test_text_that_does_not_parse_is_quarantined_not_fatal(spark, raw):
    text = raw(record()).withColumn("amount_usd", F.lit("abc")).withColumn("is_international", F.lit("maybe"))
    valid, invalid = split_flagged(flag_rules(enforce_schema(text), NOW))
    assert valid.count() == 0
    assert invalid.first()["_failed_checks"] == "_chk_amount_notnull,_chk_amount_range"


def test_event_day_is_the_utc_day(raw):
    row = enforce_schema(raw(record(event_time="2025-02-12T23:30:00-05:00"))).selectExpr("string(event_time_ts) t", "ingest_date").first()
    assert row["t"] == "2025-02-13 04:30:00"
    assert row["ingest_date"] == dt.date(2025, 2, 13)


def test_split_keeps_every_row_once(raw):
    df = raw(record(), record(transaction_id=uuid(1)), record(amount_usd=-1.0), record(channel=None), record(event_time=None))
    flagged = flag_rules(enforce_schema(df), NOW)
    valid, invalid = split_flagged(flagged)
    assert (valid.count(), invalid.count()) == (2, 3)
    assert not [name for name in valid.columns if name.startswith("_")]
    assert {"_quarantine_ts", "_failed_checks", *RULE_NAMES} <= set(invalid.columns)
    assert validation_summary(flagged).first().asDict() == {"total": 5, "passed": 2, "quarantined": 3}


def test_failures_per_rule(raw):
    df = raw(record(amount_usd=-1.0), record(amount_usd=None), record())
    counted = {row["rule"]: row["failures"] for row in rule_failures(flag_rules(enforce_schema(df), NOW)).collect()}
    assert list(counted) == RULE_NAMES
    assert counted["_chk_amount_range"] == 2
    assert counted["_chk_amount_notnull"] == 1
    assert sum(counted.values()) == 3


def test_job_writes_the_quarantine_and_counts(spark, raw, tmp_path):
    df = raw(record(), record(amount_usd=-1.0), record(channel="fax", event_time="bad"))
    valid, counts = run_validation(df, str(tmp_path / "q"), NOW)
    assert counts == {"total": 3, "passed": 1, "quarantined": 2}
    assert valid.count() == 1
    assert spark.read.json(str(tmp_path / "q")).count() == 2


def test_job_stops_when_nothing_passes(raw, tmp_path):
    with pytest.raises(NothingValid):
        run_validation(raw(record(amount_usd=-1.0)), str(tmp_path / "q"), NOW)
