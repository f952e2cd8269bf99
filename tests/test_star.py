import datetime as dt
import decimal
import re

import pytest
from pyspark.sql import functions as F

from cardflux import model
from cardflux.operators import dimensions as dims
from cardflux.operators import rows
from cardflux.operators import star as ops
from cardflux.operators.enrichment import enrich
from cardflux.operators.star import Star
from cardflux.operators.validation import enforce_schema
from cardflux.plans import jobs, panels, views
from cardflux.sources import tables
from cardflux.sources.tables import to_stage
from cardflux.workload import fixtures, queries
from tests.conftest import LOAD, NOW, record, uuid

DATES = (dt.date(2025, 4, 1), dt.date(2025, 4, 30))
D = decimal.Decimal


@pytest.fixture
def build(spark, raw):
    """Star loaded from raw records, and the stage it came from."""

    def make(*records, dates=DATES):
        stage = to_stage(enrich(enforce_schema(raw(*records))))
        star = Star(
            dims.upsert_dim_customer(None, stage, LOAD),
            dims.upsert_dim_merchant(None, stage, LOAD),
            dims.build_dim_date(spark, *dates),
            dims.build_dim_fraud_signal(spark),
        )
        return star.with_fact(ops.load_fact(stage, star, LOAD)), stage

    return make


def at(day, hour=12, minute=0):
    return f"2025-04-{day:02d}T{hour:02d}:{minute:02d}:00+00:00"


def txn(number, day=12, **changes):
    return record(**{"transaction_id": uuid(number), "event_time": at(day), **changes})


def test_stage_types(build):
    _, stage = build(txn(1))
    types = dict(stage.dtypes)
    assert stage.columns == model.STAGE_COLUMNS
    assert types["amount_usd"] == "decimal(12,2)"
    assert types["event_time"] == "timestamp_ntz"
    assert "event_time_ts" not in types


def test_fact_row(build):
    star, _ = build(txn(1, currency=None, is_international=None))
    row = star.fact.first()
    assert star.fact.columns == model.FACT_COLUMNS
    assert (row["customer_key"], row["merchant_key"], row["date_key"]) == (1, 1, 20250412)
    assert row["fraud_signal_key"] == 24  # NULL is_international counts as domestic
    assert row["currency"] == "USD"
    assert row["event_time"] == dt.datetime(2025, 4, 12, 12)
    assert row["dw_loaded_at"] == dt.datetime(2025, 5, 1)


def test_copies_in_a_batch_load_once(build):
    star, stage = build(txn(1, amount_usd=9.0), txn(1, amount_usd=3.0), txn(1, day=13, amount_usd=1.0), txn(2))
    assert rows.duplicated_keys(stage, ["transaction_id"]).collect() == [(uuid(1), 3)]
    kept = {r["transaction_id"]: r["amount_usd"] for r in star.fact.collect()}
    assert kept == {uuid(1): D("3.00"), uuid(2): D("18.25")}


@pytest.mark.parametrize("same_days_only", [False, True])
def test_second_load_adds_only_what_is_new(spark, build, tmp_path, same_days_only):
    star, stage = build(*[txn(n, day=1 + n % 20) for n in range(40)])
    assert ops.load_fact(stage, star, LOAD, same_days_only=same_days_only).count() == 0
    star.fact.where(F.col("ingest_date") < dt.date(2025, 4, 11)).write.parquet(str(tmp_path / "fact"))
    half = star.with_fact(spark.read.parquet(str(tmp_path / "fact")))
    added = ops.load_fact(stage, half, LOAD, same_days_only=same_days_only)
    assert added.count() + half.fact.count() == 40
    keys = half.fact.select("transaction_sk").unionByName(added.select("transaction_sk"))
    assert keys.distinct().count() == 40


def test_same_days_only_prunes_and_misses_moved_days(build):
    star, stage = build(txn(1, day=2), txn(2, day=20))
    moved = stage.where(F.col("transaction_id") == uuid(1)).withColumn("ingest_date", F.lit(dt.date(2025, 4, 15)))
    assert ops.load_fact(moved, star, LOAD).count() == 0
    assert ops.load_fact(moved, star, LOAD, same_days_only=True).count() == 1


def test_nothing_is_lost_without_being_reported(build):
    records = [txn(n, day=1 + n % 28) for n in range(30)] + [txn(3), txn(4, amount_usd=1.0)]
    star, stage = build(*records, dates=(DATES[0], dt.date(2025, 4, 14)))
    bare = Star(star.customers, star.merchants, star.dates, star.signals)
    missing = ops.unresolved_rows(stage, bare)
    assert {r["missing_keys"] for r in missing.collect()} == {"date_key"}
    surplus = stage.count() - stage.select("transaction_id").distinct().count()
    assert star.fact.count() + missing.count() + surplus == stage.count() == 32


def test_every_dimension_can_be_missing(spark, build):
    star, stage = build(txn(1))
    empty = Star(star.customers.limit(0), star.merchants.limit(0), star.dates.limit(0), star.signals.limit(0))
    assert ops.unresolved_rows(stage, empty).first()["missing_keys"] == ",".join(ops.FOREIGN_KEYS)
    assert ops.load_fact(stage, empty, LOAD).count() == 0
    report = rows.orphan_counts(star.fact, ops.references(empty)).collect()
    assert report == [(key, 1, 1) for key in ops.FOREIGN_KEYS]
    assert all(r["orphan_rows"] == 0 for r in rows.orphan_counts(star.fact, ops.references(star)).collect())


@pytest.mark.parametrize(("count", "flag"), [(10, False), (11, True)])
def test_high_velocity_starts_above_ten(build, count, flag):
    star, _ = build(*[txn(n, event_time=at(12, 12, n)) for n in range(count)])
    alerts = views.fraud_velocity_alerts(star).where("high_velocity_flag")
    assert bool(alerts.count()) is flag


def test_merchant_days(build):
    days = [1, 2, 3, 5, 8, 9, 10, 20, 21]
    star, _ = build(*[txn(d, day=d, amount_usd=float(d)) for d in days], txn(100, day=21, amount_usd=9.0))
    view = views.merchant_daily_performance(star).orderBy("txn_date").collect()
    assert [r["txn_date"].day for r in view] == days
    last = view[-1]
    assert (last["txn_count"], last["total_revenue_usd"], last["avg_ticket_usd"]) == (2, D("30.00"), 15.0)
    assert (last["max_ticket_usd"], last["min_ticket_usd"]) == (D("21.00"), D("9.00"))
    assert last["revenue_rolling_7d"] == sum(days[-7:-1]) + D("30.00")  # seven days with sales, not seven dates
    assert (last["prev_day_revenue"], last["revenue_dod_delta"]) == (D("20.00"), D("10.00"))
    assert view[0]["prev_day_revenue"] is None and view[0]["revenue_dod_delta"] is None
    assert (last["month_name"], last["quarter"], last["year"]) == ("Apr", 2, 2025)


def test_alert_severities(build):
    many = [txn(n, customer_id="FAST", merchant_id=f"M{n % 2}", event_time=at(3, 1, n)) for n in range(12)]
    star, _ = build(
        *many,
        txn(50, customer_id="RICH", amount_usd=6000.0),
        txn(51, customer_id="BOTH", amount_usd=6000.0, is_international=True),
        txn(52, customer_id="INTL", is_international=True),
        txn(53, customer_id="CALM"),
    )
    alerts = views.fraud_velocity_alerts(star)
    worst = {r["customer_id"]: (r["alert_severity"], r["alert_score"]) for r in alerts.collect()}
    assert worst == {"FAST": ("high", 3), "RICH": ("medium", 2), "BOTH": ("critical", 4), "INTL": ("medium", 2)}
    assert panels.alert_kpis(alerts).first().asDict() == {
        "critical_alerts": 1, "medium_alerts": 4, "international_txns": 2, "cross_merchant_events": 0,
    }
    heat = panels.signal_heatmap(alerts).first().asDict()
    assert heat == {"merchant_category": "restaurant", "high": 2, "low": 3, "medium": 0}
    feed = panels.alert_feed(alerts, 2).collect()
    assert feed[0]["customer_id"] == "BOTH" and feed[0]["amount_usd"] == "$6,000.00" and len(feed) == 2


@pytest.mark.parametrize(
    ("spend", "segment"),
    [("999.99", "bronze"), ("1000.00", "silver"), ("9999.99", "silver"), ("10000.00", "gold"), ("49999.99", "gold"), ("50000.00", "platinum")],
)
def test_spend_segments(build, spend, segment):
    star, _ = build(txn(1, amount_usd=float(spend)))
    row = views.customer_spend_profile(star, dt.date(2025, 4, 30)).first()
    assert row["spend_segment"] == segment
    assert (row["recency_days"], row["active_days"], row["txn_frequency_per_day"]) == (18, 0, None)


def test_customer_profile(build):
    star, _ = build(
        txn(1, day=1, merchant_id="M1", amount_usd=10.0),
        txn(2, day=1, merchant_id="M1", amount_usd=20.0, is_international=True),
        txn(3, day=9, merchant_id="M2", amount_usd=30.0),
        txn(4, day=9, merchant_id="M3", amount_usd=40.0, merchant_category="atm"),
    )
    row = views.customer_spend_profile(star, dt.date(2025, 4, 30)).first().asDict()
    assert (row["lifetime_txn_count"], row["lifetime_spend_usd"], row["avg_txn_usd"]) == (4, D("100.00"), 25.0)
    assert (row["distinct_merchants_visited"], row["distinct_categories_visited"]) == (3, 2)
    assert (row["active_days"], row["recency_days"], row["txn_frequency_per_day"]) == (8, 21, 0.5)
    assert (row["cross_merchant_events"], row["intl_txn_count"]) == (0, 1)


def test_sample_questions(build):
    star, _ = build(*[txn(n, day=n, merchant_id=f"M{n}", merchant_name=f"Shop {n}", amount_usd=n * 10.0) for n in range(1, 29)])
    top = views.top_merchants(star, dt.date(2025, 4, 30), days=10, n=3).collect()
    assert [(r["merchant_name"], r["total_revenue"]) for r in top] == [("Shop 28", 280), ("Shop 27", 270), ("Shop 26", 260)]
    assert views.high_velocity_signals(star).count() == 0
    limits = model.Limits(high_velocity_above=0)
    assert sum(r["alert_count"] for r in views.high_velocity_signals(star, limits).collect()) == 28


def test_merchant_panel(build):
    star, _ = build(
        txn(1, day=20, merchant_id="M1", merchant_name="A", amount_usd=1000.0),
        txn(2, day=21, merchant_id="M2", merchant_name="B", merchant_category="atm", amount_usd=3000.5),
        txn(3, day=2, merchant_id="M2", merchant_name="B", merchant_category="atm", amount_usd=5.0),
    )
    recent = panels.last_days(views.merchant_daily_performance(star), dt.date(2025, 4, 30), 14)
    kpis = panels.merchant_kpis(recent).first().asDict()
    assert kpis == {"total_revenue": D("4000.50"), "total_transactions": 2, "avg_ticket": 2000.25, "active_merchants": 2}
    assert [r["merchant_category"] for r in panels.revenue_by_category(recent).collect()] == ["restaurant", "atm"]
    assert sum(r["revenue_share"] for r in panels.revenue_share_by_segment(recent).collect()) == pytest.approx(1)
    assert [r["txn_date"].day for r in panels.daily_revenue(recent).collect()] == [20, 21]
    shown = panels.format_top_merchants(panels.top_merchants_table(recent, 1)).first()
    assert (shown["merchant_name"], shown["revenue"], shown["txns"]) == ("B", "$3,000.50", "1")
    assert panels.latest(recent, "txn_date", 1).first()["txn_date"].day == 21


def test_customer_panel(build):
    star, _ = build(txn(1, customer_id="A", amount_usd=20_000.0), txn(2, customer_id="B", amount_usd=10.0), txn(3, customer_id="C", amount_usd=30.0))
    profiles = views.customer_spend_profile(star, dt.date(2025, 4, 30))
    kpis = panels.customer_kpis(profiles).first().asDict()
    assert kpis == {"total_customers": 3, "avg_lifetime_spend": 20_040 / 3, "high_risk_customers": 1, "platinum_customers": 0}
    assert [(r["segment"], r["count"]) for r in panels.spend_segment_distribution(profiles).collect()] == [("gold", 1), ("bronze", 2)]
    table = panels.customer_table(profiles, 2).collect()
    assert [(r["customer_id"], r["lifetime_spend_usd"]) for r in table] == [("A", "$20,000.00"), ("B", "$10.00")]


def test_views_by_name(spark, build):
    star, _ = build(txn(1), txn(2, day=13))
    views.register_views(star, dt.date(2025, 4, 30))
    assert spark.sql("SELECT SUM(txn_count) FROM merchant_daily_performance_v").first()[0] == 2
    assert spark.sql("SELECT * FROM fact_transactions JOIN dim_date USING (date_key)").count() == 2


@pytest.mark.parametrize(("minutes", "status"), [(9, "green"), (10, "red")])
def test_freshness(build, minutes, status):
    star, _ = build(txn(1))
    row = panels.load_freshness(star.fact, LOAD + dt.timedelta(minutes=minutes, seconds=59)).first()
    assert (row["age_minutes"], row["status"]) == (minutes, status)


def test_stored_loads(spark, raw, tmp_path):
    """Two loads through files: dimension versions are written beside each other, the fact grows."""
    fact, first, second = (str(tmp_path / name) for name in ("fact", "v1", "v2"))
    old = enrich(enforce_schema(raw(*[txn(n, day=1 + n % 5) for n in range(20)])))
    new = enrich(enforce_schema(raw(*[txn(n, day=1 + n % 5, merchant_id=f"M{n}") for n in range(15, 30)])))
    jobs.load_warehouse(spark, old, fact, first, None, LOAD, *DATES)
    star = jobs.load_warehouse(spark, new, fact, second, first, LOAD, *DATES)
    assert star.fact.count() == 30
    assert star.fact.select("transaction_sk").distinct().count() == 30
    assert star.merchants.count() == 16
    again = jobs.load_warehouse(spark, new, fact, str(tmp_path / "v3"), second, LOAD, *DATES)
    assert again.fact.count() == 30
    assert all(r["orphan_rows"] == 0 for r in rows.orphan_counts(again.fact, ops.references(again)).collect())


def test_repeating_a_first_load_adds_nothing(spark, raw, tmp_path):
    fact = str(tmp_path / "fact")
    batch = enrich(enforce_schema(raw(*[txn(n, day=1 + n % 5) for n in range(20)])))
    once = jobs.load_warehouse(spark, batch, fact, str(tmp_path / "v1"), None, LOAD).fact.collect()
    again = jobs.load_warehouse(spark, batch, fact, str(tmp_path / "v1"), None, LOAD)
    assert sorted(again.fact.collect()) == sorted(once)
    assert again.unresolved.count() == 0
    assert [(r["seq"], r["rows"], r["greatest_key"]) for r in again.loads.orderBy("seq").collect()] == [(1, 20, 20), (2, 0, 20)]
    row = panels.load_freshness(again.loads, LOAD + dt.timedelta(minutes=3)).first()
    assert (row["age_minutes"], row["status"]) == (3, "green")


def test_the_calendar_spans_the_batch_and_a_cut_one_reports_every_row(spark, raw, tmp_path):
    old = enrich(enforce_schema(raw(*[record(transaction_id=uuid(n), event_time=f"1995-03-0{1 + n}T00:00:00+00:00") for n in range(5)])))
    assert jobs.load_warehouse(spark, old, str(tmp_path / "f"), str(tmp_path / "v"), None, LOAD).fact.count() == 5
    cut = jobs.load_warehouse(spark, old, str(tmp_path / "g"), str(tmp_path / "w"), None, LOAD, *DATES)
    assert (cut.fact.count(), cut.unresolved.count()) == (0, 5)


def test_row_keys_do_not_depend_on_the_input_order(spark, build):
    star, stage = build(*[txn(n, day=1 + n % 5) for n in range(30)])
    resolved = ops.resolve_fact(stage, star.with_fact(None), LOAD)
    keys = {row["transaction_id"]: row["transaction_sk"] for row in ops.number_fact(resolved.repartition(7)).collect()}
    assert keys == {row["transaction_id"]: row["transaction_sk"] for row in ops.number_fact(resolved.repartition(2, "amount_usd")).collect()}
    assert sorted(keys.values()) == list(range(1, 31))


def test_panels_read_only_the_days_they_show(spark, build, tmp_path):
    star, _ = build(*[txn(n, day=1 + n % 20) for n in range(40)])
    star.fact.write.partitionBy("ingest_date").parquet(str(tmp_path / "fact"))
    stored = star.with_fact(tables.read_fact(spark, str(tmp_path / "fact")))
    shown = views.merchant_daily_performance(stored, dt.date(2025, 4, 15))
    plan = shown._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^]]*ingest_date[^]]*>= 2025-04-15", plan)
    assert {row["txn_date"].day for row in shown.collect()} == {15, 16, 17, 18, 19, 20}


def test_added_events_leave_other_customers_alone(spark):
    events = spark.createDataFrame([(n, n * 7, "purchase", 1.0, dt.datetime(2024, 1, 1)) for n in range(40)], "event_id long, user_id long, event_type string, value double, ts timestamp")
    some = {row["transaction_id"]: row["customer_id"] for row in fixtures.events_as_raw(events.where("event_id < 9")).collect()}
    more = {row["transaction_id"]: row["customer_id"] for row in fixtures.events_as_raw(events).collect()}
    assert some.items() <= more.items() and len(set(more.values())) > 1


def test_copies_are_told_apart_without_columns_that_nobody_asks_for(spark, build, monkeypatch):
    """The query's rows are those of whole copies, but the de-duplication gets the columns it needs."""
    copies = [txn(1, amount_usd=5.0, city="A"), txn(1, amount_usd=4.0, city="B"), txn(1, amount_usd=4.0, city="A", customer_id="C-1"), txn(2, day=20), txn(2, day=20, channel="atm")]
    _, stage = build(*copies)
    monkeypatch.setattr(queries, "_lines_stage", lambda *_: stage)
    whole = ops.distinct_transactions(stage)
    left_out = ops.unresolved_rows(stage, queries._load(spark, stage, (DATES[0], dt.date(2000, 6, 30))).with_fact(None))
    got, real = [], ops.distinct_transactions
    monkeypatch.setattr(ops, "distinct_transactions", lambda frame: got.append(set(frame.columns)) or real(frame))
    asked = ["transaction_id", "customer_id", "merchant_id", "event_time", "amount_usd"]
    assert sorted(queries.dedup_transactions(spark, "").collect()) == sorted(whole.select(*asked).collect())
    assert got == [set(asked)]
    kept = queries.load_star_unresolved(spark, "")
    assert sorted(kept.collect()) == sorted(left_out.select(*kept.columns).collect()) and kept.count() == 2
    assert all(columns <= set(ops.FACT_INPUTS) for columns in got)
