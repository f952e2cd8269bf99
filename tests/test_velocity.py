import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from cardflux.model import DAY, HOUR, Limits
from cardflux.operators import velocity
from cardflux.operators.enrichment import add_merchant_segment, add_merchant_segment_from, add_risk_tier, add_time_features, enrich
from cardflux.operators.late import revised_rows, with_late_rows
from cardflux.operators.validation import enforce_schema
from cardflux.operators.velocity import BLOCK, add_velocity_features
from cardflux.model import CURATED_COLUMNS, SEGMENT_OF_CATEGORY
from tests.conftest import record, uuid

SCHEMA = "transaction_id string, customer_id string, merchant_id string, amount_usd double, event_time_ts timestamp, ingest_date date"
START = (1_744_000_000 // BLOCK) * BLOCK


def activity(spark, rows):
    """Rows of (customer, merchant, amount, second)."""
    built = []
    for number, (customer, merchant, amount, second) in enumerate(rows):
        at = dt.datetime.fromtimestamp(second, dt.timezone.utc)
        built.append((uuid(number), customer, merchant, amount, at, at.date()))
    return spark.createDataFrame(built, SCHEMA)


def brute_force(rows):
    per_customer = defaultdict(list)
    for customer, merchant, amount, second in rows:
        per_customer[customer].append((second, merchant, amount))
    result = []
    for number, (customer, _, _, now) in enumerate(rows):
        hour = [r for r in per_customer[customer] if now - HOUR <= r[0] <= now]
        day = [r for r in per_customer[customer] if now - DAY <= r[0] <= now]
        merchants = len({m for _, m, _ in hour if m is not None})
        result.append((uuid(number), len(hour), merchants, round(sum(a for _, _, a in day), 2)))
    return sorted(result)


def features(df):
    columns = ["transaction_id", "txn_count_last_1h", "distinct_merchants_1h", "spend_velocity_24h"]
    return sorted((a, b, c, round(d, 2)) for a, b, c, d in df.select(*columns).collect())


def traffic(seed, n, customers, merchants, span):
    rng = random.Random(seed)
    names = [f"M{i}" for i in range(merchants)]
    return [
        (f"C{rng.randrange(customers)}", rng.choice(names), rng.randrange(1, 90_000) / 100, START + rng.randrange(span))
        for _ in range(n)
    ]


@pytest.mark.parametrize(
    ("n", "customers", "merchants", "span"),
    [
        (400, 3, 6, 6 * HOUR),  # dense: many merchants within the hour
        (300, 2, 3, 3 * DAY),  # day lookback matters
        (300, 1, 4, 3 * BLOCK),  # one customer over several blocks
        (200, 2, 5, 40),  # many rows in the same second
    ],
)
def test_equals_brute_force(spark, n, customers, merchants, span):
    rows = traffic(n + span, n, customers, merchants, span)
    assert features(add_velocity_features(activity(spark, rows))) == brute_force(rows)


def test_equals_brute_force_around_block_borders(spark):
    rng = random.Random(5)
    border = START + BLOCK
    near = [border + d for d in (-DAY - 1, -DAY, -HOUR - 1, -HOUR, -1, 0, 1, HOUR, HOUR + 1, DAY, DAY + 1)]
    rows = [("C", f"M{rng.randrange(3)}", 1.25, second) for second in near for _ in range(3)]
    assert features(add_velocity_features(activity(spark, rows))) == brute_force(rows)


def test_frame_is_closed_and_includes_peers(spark):
    rows = [
        ("A", "M", 1.0, START),
        ("A", "M", 1.0, START + HOUR),  # exactly an hour later: counted
        ("B", "M", 1.0, START),
        ("B", "M", 1.0, START + HOUR + 1),  # a second more: not
        ("C", "M", 1.0, START),
        ("C", "N", 1.0, START),  # same second: both see both
        ("D", "M", 1.0, START),
        ("D", "M", 2.0, START + DAY),
        ("E", "M", 1.0, START),
        ("E", "M", 2.0, START + DAY + 1),
    ]
    got = features(add_velocity_features(activity(spark, rows)))
    assert [r[1] for r in got] == [1, 2, 1, 1, 2, 2, 1, 1, 1, 1]
    assert [r[2] for r in got][4:6] == [2, 2]
    assert [r[3] for r in got][6:] == [1.0, 3.0, 1.0, 2.0]


def test_missing_merchant_counts_as_transaction_only(spark):
    rows = [("A", None, 1.0, START), ("A", "M", 1.0, START + 5), ("A", None, 1.0, START + 10)]
    assert features(add_velocity_features(activity(spark, rows))) == brute_force(rows)


def test_rows_without_customer_stay(spark):
    df = activity(spark, [("A", "M", 1.0, START), (None, "M", 1.0, START)])
    assert {r["customer_id"]: r["txn_count_last_1h"] for r in add_velocity_features(df).collect()} == {"A": 1, None: None}


@pytest.mark.parametrize(("merchants", "flag"), [(4, False), (5, True), (6, True)])
def test_cross_merchant_threshold(spark, merchants, flag):
    rows = [("A", f"M{i}", 1.0, START + 300 * i) for i in range(merchants)]
    last = add_velocity_features(activity(spark, rows)).orderBy(F.desc("event_time_ts")).first()
    assert last["cross_merchant_flag"] is flag
    strict = add_velocity_features(activity(spark, rows), limits=Limits(cross_merchant_at_least=7))
    assert not strict.where("cross_merchant_flag").count()


def test_batches_with_history_equal_one_batch(spark):
    rows = traffic(11, 400, 4, 5, 3 * DAY)
    whole = activity(spark, rows)
    cut = F.timestamp_seconds(F.lit(START + DAY + 7 * HOUR))
    early, late = whole.where(F.col("event_time_ts") < cut), whole.where(F.col("event_time_ts") >= cut)
    got = features(add_velocity_features(early)) + features(add_velocity_features(late, history=early))
    assert sorted(got) == brute_force(rows)


def test_history_of_other_customers_and_days_is_not_read(spark):
    early = activity(spark, [("A", "M", 5.0, START - 3 * DAY), ("B", "M", 7.0, START - 60), ("A", "N", 9.0, START + DAY)])
    late = activity(spark, [("A", "M", 1.0, START)])
    row = add_velocity_features(late, history=early).first()
    assert (row["txn_count_last_1h"], row["spend_velocity_24h"]) == (1, 1.0)


def test_approximate_merchant_count(spark):
    rows = traffic(3, 300, 3, 8, 6 * HOUR)
    exact = brute_force(rows)
    got = features(add_velocity_features(activity(spark, rows), approx=True))
    assert [(r[0], r[1], r[3]) for r in got] == [(r[0], r[1], r[3]) for r in exact]
    assert max(abs(a[2] - b[2]) for a, b in zip(got, exact)) <= 1


def test_hot_customer_window_is_bounded_by_seconds(spark):
    """However many rows a customer has, the windows see one row per second (and merchant)."""
    rows = [("HOT", f"M{i % 3}", 0.5, START + i % 20) for i in range(6000)] + [("COLD", "M0", 0.5, START)]
    df = add_velocity_features(activity(spark, rows))
    assert features(df)[:3] == brute_force(rows)[:3]
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window " in line]
    assert windows and all("_block" in line for line in windows)
    assert plan.index("Window") < plan.index("Aggregate")  # aggregates feed the windows


def test_time_features(spark, raw):
    row = add_time_features(enforce_schema(raw(record()))).first()
    assert (row["hour_of_day"], row["day_of_week"], row["week_of_year"]) == (8, 4, 7)


@pytest.mark.parametrize(
    ("spend", "tier"),
    [(6000.0, "high"), (5000.0, "high"), (4999.99, "medium"), (1500.0, "medium"), (1000.0, "medium"), (999.99, "low"), (200.0, "low"), (None, "low")],
)
def test_risk_tier(spark, spend, tier):
    df = spark.createDataFrame([(spend,)], "spend_velocity_24h double")
    assert add_risk_tier(df).first()["risk_tier"] == tier


def test_merchant_segment_both_ways(spark):
    names = [*SEGMENT_OF_CATEGORY, "pawn_shop", None]
    df = spark.createDataFrame([(n,) for n in names], "merchant_category string")
    table = spark.createDataFrame(list(SEGMENT_OF_CATEGORY.items()), "merchant_category string, merchant_segment string")
    want = {**SEGMENT_OF_CATEGORY, "pawn_shop": "other", None: "other"}
    assert {r[0]: r["merchant_segment"] for r in add_merchant_segment(df).collect()} == want
    assert {r[0]: r["merchant_segment"] for r in add_merchant_segment_from(df, table).collect()} == want


def test_enriched_columns(raw):
    enriched = enrich(enforce_schema(raw(record())))
    assert enriched.columns == CURATED_COLUMNS
    assert enriched.count() == 1


def test_late_rows_in_any_order_give_the_rows_of_one_batch(spark, raw, tmp_path):
    rng = random.Random(31)
    events = [
        record(transaction_id=uuid(n), customer_id=f"C{rng.randrange(4)}", merchant_id=f"M{rng.randrange(6)}", amount_usd=float(rng.randrange(1, 900)),
               event_time=f"2025-04-{1 + rng.randrange(5):02d}T{rng.choice([0, 11, 12, 22, 23]):02d}:{rng.randrange(60):02d}:00+00:00")
        for n in range(240)
    ]
    whole = enforce_schema(raw(*events))
    want = sorted(enrich(whole).collect())
    batches = [events[:60], events[60:200], events[200:]]
    for order in ((0, 1, 2), (2, 0, 1)):
        curated = enrich(enforce_schema(raw(*batches[order[0]])))
        for number in order[1:]:
            path = str(tmp_path / f"{order}-{number}")
            curated.write.parquet(path)
            curated = with_late_rows(spark.read.parquet(path), enforce_schema(raw(*batches[number])))
        assert sorted(curated.select(*enrich(whole).columns).collect()) == want


def test_only_the_customers_and_days_in_reach_are_revised(spark, raw):
    old = [record(transaction_id=uuid(n), customer_id=c, event_time=f"2025-04-0{d}T12:00:00+00:00") for n, (c, d) in enumerate([("A", 1), ("A", 2), ("A", 3), ("A", 5), ("B", 3)])]
    curated = enrich(enforce_schema(raw(*old)))
    late = enforce_schema(raw(record(transaction_id=uuid(99), customer_id="A", event_time="2025-04-02T11:30:00+00:00")))
    revised = {r["transaction_id"]: r["txn_count_last_1h"] for r in revised_rows(curated, late).collect()}
    assert revised == {uuid(99): 1, uuid(1): 2, uuid(2): 1}
    assert with_late_rows(curated, late).count() == 6


def test_sketches_follow_the_exact_count_of_a_busy_hour(spark):
    """Two thousand merchants of one customer around a pane's border."""
    border = START - START % (HOUR + 1) + 2 * (HOUR + 1)
    rows = [("C", f"M{n % 2000}", 1.0, border - HOUR + n) for n in range(7000)]
    df = activity(spark, rows)
    exact = {r["transaction_id"]: r["distinct_merchants_1h"] for r in add_velocity_features(df).collect()}
    sketched = {r["transaction_id"]: r["distinct_merchants_1h"] for r in add_velocity_features(df, approx=True).collect()}
    assert max(exact.values()) == 2000 and sketched.keys() == exact.keys()
    assert all(abs(sketched[t] - n) <= 0.06 * n for t, n in exact.items())
    assert sum(sketched[t] == n for t, n in exact.items()) > 100


def test_the_timeline_has_one_row_per_second_with_visits(spark):
    """The end of a stretch of visits is no row of its own, so nothing but the seconds of rows is shuffled."""
    rows = [("c", f"m{number}", 1.0, START + number * 2 * HOUR) for number in range(20)]
    activity_rows = activity(spark, rows).withColumn("_second", F.unix_timestamp("event_time_ts"))
    visits = activity_rows.groupBy("customer_id", "merchant_id", "_second").agg(F.count("*").alias("_txns"), F.sum("amount_usd").alias("_spend"))
    timeline = velocity._stretches_in_time(velocity._reaching_blocks(visits)).collect()
    assert len(timeline) == 20
    assert all(r["_opens"] == r["_closes"] == 1 for r in timeline)


def test_visits_of_a_block_are_shuffled_once_after_they_are_combined(spark):
    activity_rows = activity(spark, [("c", "m", 1.0, START)]).withColumn("_second", F.unix_timestamp("event_time_ts"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = velocity.rolling_features(activity_rows)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert plan.count("Exchange hashpartitioning") == 2
