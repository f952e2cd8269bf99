"""Every registered query: ``(spark, sf_dir) -> DataFrame``.

Results are made comparable across engines at the very end: dates and timestamps as text, decimals
as doubles. Audit times are pinned so that results repeat.
"""

from __future__ import annotations

import datetime as dt
import functools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions.labels import merchant_segment
from cardflux.functions.rules import RULE_NAMES
from cardflux.operators import dimensions as dims
from cardflux.operators import rows, star as star_ops
from cardflux.operators.enrichment import add_merchant_segment_from, add_risk_tier, add_time_features, enrich
from cardflux.operators.late import with_late_rows
from cardflux.operators.star import Star
from cardflux.operators.validation import enforce_schema, flag_rules, rule_failures, split_flagged, validation_summary
from cardflux.operators.velocity import add_velocity_features
from cardflux.plans import panels, views
from cardflux.plans.jobs import load_warehouse, run_batch
from cardflux.session import use_utc
from cardflux.sources import landing, ledger, manifest, tables
from cardflux.sources.ids import append_ids
from cardflux.sources.scratch import scratch_folder
from cardflux.streaming.flows import land_topic, validate_stream
from cardflux.workload import fixtures as fx

SECOND_LOAD = dt.datetime(2024, 2, 1, tzinfo=dt.timezone.utc)
THIRD_LOAD = dt.datetime(2024, 2, 2, tzinfo=dt.timezone.utc)
BROKEN_DAY, LOST_DAY, FOREIGN_DAY = "2024-01-05", "2024-01-09", "2024-01-12"
HISTORY_UNTIL = "2024-01-15 12:00:00"
FIRST_BATCH_BEFORE = "1998-07-01"
FIRST_EVENTS_BEFORE = dt.date(2024, 1, 16)
KNOWN_DATES_BEFORE = dt.date(2000, 6, 30)
VELOCITY_COLUMNS = ["txn_count_last_1h", "distinct_merchants_1h", "spend_velocity_24h", "cross_merchant_flag"]
#: Ids are digits at random, which only an entropy code makes shorter.
COMPACT = "zstd"
CURATED_KEYS = ["transaction_id", "customer_id", "merchant_id"]


def comparable(df: DataFrame) -> DataFrame:
    """Engine-neutral column types."""

    def plain(name: str, kind: str):
        column = F.col(name)
        if kind == "date":
            return F.date_format(column, "yyyy-MM-dd").alias(name)
        if kind.startswith("timestamp"):
            return F.date_format(column, "yyyy-MM-dd HH:mm:ss").alias(name)
        if kind.startswith("decimal"):
            return column.cast("double").alias(name)
        return column

    return df.select(*[plain(name, kind) for name, kind in df.dtypes])


# -- shared inputs ----------------------------------------------------------


def _flag(raw: DataFrame) -> DataFrame:
    return flag_rules(enforce_schema(raw), fx.NOW)


def _events_flagged(spark, sf_dir):
    return _flag(fx.events_raw(spark, sf_dir))


def _events_valid(spark, sf_dir):
    return split_flagged(_events_flagged(spark, sf_dir))[0]


def _events_curated(spark, sf_dir):
    return enrich(_events_valid(spark, sf_dir))


def _lines_valid(spark, sf_dir):
    """The features scan their input twice (rolling values, then rows): storing the joined lines as
    landing files first keeps the join from running twice. Lines are judged before they are stored, so that
    those to be rejected, most of which their amount tells, are neither joined nor written nor judged twice."""
    folder = scratch_folder(spark, "lines-landing")
    raw = fx.lineitem_raw(spark, sf_dir)
    split_flagged(_flag(raw))[0].select(*raw.columns).write.parquet(folder, compression=COMPACT)
    return enforce_schema(landing.read_landing(spark, folder, "parquet"))


def _staged(spark, curated: DataFrame, purpose: str) -> DataFrame:
    """Curated rows written once and read back: dimensions and fact each scan them, pruned to their columns."""
    folder = scratch_folder(spark, purpose)
    curated.write.parquet(folder, compression=COMPACT)
    return tables.read_stage(spark, folder)


def _events_stage(spark, sf_dir):
    return _staged(spark, _events_curated(spark, sf_dir), "events-curated")


def _lines_stage(spark, sf_dir):
    return _staged(spark, enrich(_lines_valid(spark, sf_dir)), "lines-curated")


def _load(spark: SparkSession, stage: DataFrame, dates: tuple[dt.date, dt.date], by_day: bool = False) -> Star:
    """The star after a first load of ``stage``, stored once: dimensions first, then the resolved rows.

    Row keys are left out, as no view reads them; the loads by the job are queries of their own. ``by_day``
    clusters the fact as the job does, for panels that read some of its days.
    """
    folder = scratch_folder(spark, "star")

    def kept(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{folder}/{name}", compression=COMPACT)
        return spark.read.schema(frame.schema).parquet(f"{folder}/{name}")

    star = Star(
        customers=kept(dims.upsert_dim_customer(None, stage, fx.LOAD_TS), "dim_customer"),
        merchants=kept(dims.upsert_dim_merchant(None, stage, fx.LOAD_TS), "dim_merchant"),
        dates=dims.build_dim_date(spark, *dates),
        signals=dims.build_dim_fraud_signal(spark),
    )
    resolved = star_ops.resolve_fact(stage, star, fx.LOAD_TS)
    if not by_day:
        return star.with_fact(kept(resolved, "fact"))
    tables.write_fact(resolved, f"{folder}/fact")
    return star.with_fact(spark.read.schema(resolved.schema).parquet(f"{folder}/fact"))


def _events_star(spark, sf_dir):
    return _load(spark, _events_stage(spark, sf_dir), fx.EVENTS_DATES)


def _lines_star(spark, sf_dir):
    return _load(spark, _lines_stage(spark, sf_dir), fx.LINES_DATES)


def _small_ticket_star(spark, sf_dir):
    """Order lines with amounts divided by 50, which spreads customers over the spend segments."""
    scaled = F.round(F.col("amount_usd") / F.lit(50).cast("decimal(2,0)"), 2).cast(model.AMOUNT_TYPE)
    return _load(spark, _lines_stage(spark, sf_dir).withColumn("amount_usd", scaled), fx.LINES_DATES)


def _performance(spark, sf_dir):
    return views.merchant_daily_performance(_lines_star(spark, sf_dir))


def _recent_performance(spark, sf_dir):
    """The last 30 days; the panels on it use no rolling value, so only these days of the fact are read."""
    since = fx.LINES_AS_OF - dt.timedelta(days=30)
    star = _load(spark, _lines_stage(spark, sf_dir), fx.LINES_DATES, by_day=True)
    return panels.last_days(views.merchant_daily_performance(star, since), fx.LINES_AS_OF, 30)


def _alerts(spark, sf_dir):
    return views.fraud_velocity_alerts(_events_star(spark, sf_dir))


def _profiles(spark, sf_dir):
    return views.customer_spend_profile(_small_ticket_star(spark, sf_dir), fx.LINES_AS_OF)


def _natural_fact(fact: DataFrame, star: Star) -> DataFrame:
    """Fact rows with natural keys in place of surrogate ones."""
    signals = star.signals.select("fraud_signal_key", "signal_label")
    return (
        fact.join(star.customers.select("customer_key", "customer_id"), "customer_key")
        .join(star.merchants.select("merchant_key", "merchant_id"), "merchant_key")
        .join(F.broadcast(signals), "fraud_signal_key")
        .select("customer_id", "merchant_id", "signal_label", "date_key", *model.FACT_COLUMNS[5:])
    )


# -- sources and sinks ------------------------------------------------------


def scan_raw(spark, sf_dir):
    folder = scratch_folder(spark, "landing")
    fx.events_raw(spark, sf_dir).write.parquet(folder)
    return landing.read_landing(spark, folder, "parquet")


def parse_json_events(spark, sf_dir):
    folder = scratch_folder(spark, "json")
    landing.to_topic_records(fx.events_raw(spark, sf_dir)).select("value").write.text(folder)
    return landing.read_json_events(spark, folder).drop(landing.CORRUPT)


def kafka_records(spark, sf_dir):
    """Keys, fields read back from the JSON, and the order in which the text names them."""
    records = landing.to_topic_records(fx.events_raw(spark, sf_dir))
    fields = [F.get_json_object("value", f"$.{name}").alias(name) for name in ("transaction_id", "merchant_category", "event_time", "zip_code")]
    amount = F.get_json_object("value", "$.amount_usd").cast("double").alias("amount_usd")
    return records.select("key", *fields, amount, F.array_join(F.json_object_keys("value"), ",").alias("field_order"))


def quarantine_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "quarantine")
    _, invalid = split_flagged(_events_flagged(spark, sf_dir))
    tables.write_quarantine(invalid, folder)
    return tables.read_quarantine(spark, folder, invalid.schema).select("transaction_id", "ingest_date", "amount_usd", "_failed_checks")


def curated_roundtrip(spark, sf_dir):
    folder = scratch_folder(spark, "curated")
    tables.write_curated(_events_curated(spark, sf_dir), folder)
    return tables.read_curated(spark, folder)


def adhoc_sql(spark, sf_dir):
    views.register_views(_lines_star(spark, sf_dir), fx.LINES_AS_OF)
    return spark.sql(
        "SELECT merchant_segment, year, SUM(total_revenue_usd) AS revenue, SUM(txn_count) AS txns "
        "FROM merchant_daily_performance_v GROUP BY merchant_segment, year"
    )


# -- validation -------------------------------------------------------------


def quarantine_rows(spark, sf_dir):
    _, invalid = split_flagged(_events_flagged(spark, sf_dir))
    return invalid.select("transaction_id", "transaction_type", "merchant_category", "ingest_date", "_failed_checks")


def lineitem_validation_summary(spark, sf_dir):
    return validation_summary(_flag(fx.lineitem_raw(spark, sf_dir)))


# -- features ---------------------------------------------------------------


def velocity_features(spark, sf_dir):
    featured = add_velocity_features(_events_valid(spark, sf_dir))
    return featured.select("transaction_id", "customer_id", *VELOCITY_COLUMNS)


def velocity_approx(spark, sf_dir):
    """The exact features, by how much the sketched number of merchants differs, and whether that is by one at most."""
    valid = _events_valid(spark, sf_dir)
    sketched = add_velocity_features(valid, approx=True).select("transaction_id", F.col("distinct_merchants_1h").alias("sketched"))
    both = add_velocity_features(valid).join(sketched, "transaction_id")
    error = F.col("sketched") - F.col("distinct_merchants_1h")
    return both.select("transaction_id", "customer_id", *VELOCITY_COLUMNS, error.alias("merchants_error"), (F.abs(error) <= 1).alias("within_one"))


def velocity_with_history(spark, sf_dir):
    """The second half of the events as a batch that looks back on the first half."""
    valid = _events_valid(spark, sf_dir)
    cut = F.lit(HISTORY_UNTIL).cast("timestamp")
    batch, history = valid.where(F.col("event_time_ts") >= cut), valid.where(F.col("event_time_ts") < cut)
    return add_velocity_features(batch, history).select("transaction_id", "customer_id", *VELOCITY_COLUMNS)


def velocity_late_rows(spark, sf_dir):
    """Features after every third event came first, and two further thirds late, each over all of the time."""
    valid, folder = _events_valid(spark, sf_dir), scratch_folder(spark, "late")
    third = F.pmod(F.xxhash64("transaction_id"), F.lit(3))
    curated = enrich(valid.where(third == 2))
    for number in (0, 1):
        curated.write.parquet(f"{folder}/curated-{number}")
        valid.where(third == number).write.parquet(f"{folder}/late-{number}")
        curated = with_late_rows(spark.read.parquet(f"{folder}/curated-{number}"), spark.read.parquet(f"{folder}/late-{number}"))
    return curated.select("transaction_id", "customer_id", *VELOCITY_COLUMNS, "risk_tier")


def time_features(spark, sf_dir):
    timed = add_time_features(enforce_schema(fx.events_raw(spark, sf_dir)))
    return timed.select("transaction_id", "event_time_ts", "hour_of_day", "day_of_week", "week_of_year")


def risk_tier(spark, sf_dir):
    tiered = add_risk_tier(add_velocity_features(_events_valid(spark, sf_dir)))
    return tiered.groupBy("risk_tier").agg(F.count(F.lit(1)).alias("txns"), F.max("spend_velocity_24h").alias("max_spend"))


def merchant_segment_literal(spark, sf_dir):
    raw = fx.events_raw(spark, sf_dir)
    return raw.select("transaction_id", "merchant_category", merchant_segment(F.col("merchant_category")).alias("merchant_segment"))


def merchant_segment_join(spark, sf_dir):
    raw = fx.events_raw(spark, sf_dir)
    segments = spark.createDataFrame(list(model.SEGMENT_OF_CATEGORY.items()), "merchant_category string, merchant_segment string")
    return add_merchant_segment_from(raw, segments).select("transaction_id", "merchant_category", "merchant_segment")


# -- dimensions and fact ----------------------------------------------------


def dim_date(spark, sf_dir):
    """The calendar of the order lines, generated from their first to their last day."""
    lines = fx.table(spark, sf_dir, "lineitem").agg(F.to_date(F.min("l_shipdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("b"))
    return dims.describe_days(lines.select(F.explode(F.sequence("a", "b")).alias("full_date")))


def dim_fraud_signal(spark, sf_dir):
    """All signal combinations with the number of loaded transactions that show each."""
    star = _events_star(spark, sf_dir)
    shown = star.fact.groupBy("fraud_signal_key").agg(F.count(F.lit(1)).alias("txns"))
    return star.signals.join(shown, "fraud_signal_key", "left").na.fill(0, ["txns"])


def merchant_candidates(spark, sf_dir):
    return dims.merchant_candidates(_lines_stage(spark, sf_dir))


def latest_merchant_row(spark, sf_dir):
    return dims.latest_attributes(_lines_stage(spark, sf_dir), "merchant_id", model.MERCHANT_ATTRIBUTES)


def dedup_transactions(spark, sf_dir):
    """The copy of each id that is kept; copies are told apart by these columns first, so that no others are shuffled for it."""
    return star_ops.distinct_transactions(_lines_stage(spark, sf_dir).select(*CURATED_KEYS, "event_time", "amount_usd"))


def _two_batches(stage):
    first_day = F.lit(FIRST_BATCH_BEFORE).cast("date")
    return stage.where(F.col("ingest_date") < first_day), stage.where(F.col("ingest_date") >= first_day)


def _upserted(spark, sf_dir, upsert):
    """A load of the earlier order lines followed by one of the later ones."""
    first, second = _two_batches(_lines_stage(spark, sf_dir))
    return upsert(upsert(None, first, fx.LOAD_TS), second, SECOND_LOAD)


def upsert_dim_merchant(spark, sf_dir):
    return _upserted(spark, sf_dir, dims.upsert_dim_merchant).drop("merchant_key")


def upsert_dim_customer(spark, sf_dir):
    return _upserted(spark, sf_dir, dims.upsert_dim_customer).drop("customer_key")


def assign_surrogate_keys(spark, sf_dir):
    """The keys given to all customers: as many as there are customers, from 1, without gaps or repeats."""
    names = _lines_stage(spark, sf_dir).select("customer_id").distinct()
    keyed = rows.assign_surrogate_keys(names, "customer_id", "customer_key")
    key = F.col("customer_key")
    return keyed.agg(
        F.count_distinct("customer_id").alias("customers"), F.min(key).alias("least"), F.max(key).alias("greatest"), F.count_distinct(key).alias("keys")
    )


def load_star_fact(spark, sf_dir):
    star = _lines_star(spark, sf_dir)
    return _natural_fact(star.fact, star)


def load_star_unresolved(spark, sf_dir):
    """Rows left out when the calendar ends before the data does."""
    star = _load(spark, stage := _lines_stage(spark, sf_dir), (fx.LINES_DATES[0], KNOWN_DATES_BEFORE))
    # The look-up takes what the fact takes, by which copies are told apart; further columns are not asked for.
    left_out = star_ops.unresolved_rows(stage.select(*star_ops.FACT_INPUTS), star.with_fact(None))
    return left_out.select(*CURATED_KEYS, "ingest_date", "amount_usd", "missing_keys")


def _loaded_twice(spark, first, second, again: str):
    """Two loads into one fact; ``again`` names the dimensions that the second one starts from, if any."""
    folder = scratch_folder(spark, "loads")
    load_warehouse(spark, first, f"{folder}/fact", f"{folder}/v1", None, fx.LOAD_TS)
    old = f"{folder}/{again}" if again else None
    return load_warehouse(spark, second, f"{folder}/fact", f"{folder}/v2", old, SECOND_LOAD)


def incremental_fact_load(spark, sf_dir):
    """What a second load of all order lines adds to a fact that holds the earlier ones."""
    stage = _lines_stage(spark, sf_dir)
    first, _ = _two_batches(stage)
    star = _loaded_twice(spark, first, stage, "v1")
    added = star.fact.where(F.col("dw_loaded_at") == F.lit(SECOND_LOAD).cast("timestamp_ntz"))
    return added.select("transaction_id", "date_key", "amount_usd", "event_time", "dw_loaded_at")


def warehouse_load_twice(spark, sf_dir):
    """The fact after the same first load was run twice, as after a crash."""
    stage = _events_stage(spark, sf_dir)
    star = _loaded_twice(spark, stage, stage, "")
    return _natural_fact(star.fact, star)


def warehouse_unresolved(spark, sf_dir):
    """Where every stage row went when the calendar ends too early: the counts add up, and the row keys are dense."""
    stage, folder = _events_stage(spark, sf_dir), scratch_folder(spark, "loads")
    star = load_warehouse(spark, stage, f"{folder}/fact", f"{folder}/v1", None, fx.LOAD_TS, fx.EVENTS_DATES[0], FIRST_EVENTS_BEFORE)
    counts = [
        stage.agg(F.count(F.lit(1)).alias("stage_rows"), (F.count(F.lit(1)) - F.count_distinct("transaction_id")).alias("duplicate_rows")),
        star.fact.agg(F.count(F.lit(1)).alias("fact_rows"), F.max("transaction_sk").alias("greatest_key"), F.count_distinct("transaction_sk").alias("keys")),
        star.unresolved.agg(F.count(F.lit(1)).alias("unresolved_rows")),
    ]
    return counts[0].join(counts[1]).join(counts[2])  # one row each


def warehouse_load_after_crash(spark, sf_dir):
    """The fact after a load that broke off before its last entry, with all its files written, and was run again."""
    stage, folder = _events_stage(spark, sf_dir), scratch_folder(spark, "loads")
    fact_path = f"{folder}/fact"
    lost = ledger.begin(spark, fact_path)
    left_behind = star_ops.number_fact(_load(spark, stage, fx.EVENTS_DATES).fact)
    tables.append_fact(left_behind, fact_path, lost)
    append_ids(left_behind, fact_path, 8, lost)
    star = load_warehouse(spark, stage, fact_path, f"{folder}/v1", None, fx.LOAD_TS, id_buckets=8)
    return _natural_fact(star.fact, star)


def load_log(spark, sf_dir):
    """The ledger after loads of the earlier events, of all events, and of all events again."""
    stage, folder = _events_stage(spark, sf_dir), scratch_folder(spark, "loads")
    first = stage.where(F.col("ingest_date") < F.lit(FIRST_EVENTS_BEFORE))
    for number, (batch, load_ts) in enumerate([(first, fx.LOAD_TS), (stage, SECOND_LOAD), (stage, THIRD_LOAD)], 1):
        star = load_warehouse(spark, batch, f"{folder}/fact", f"{folder}/v{number}", None, load_ts)
    keys = star.fact.agg(F.max("transaction_sk").alias("greatest_in_fact")).scalar()
    return star.loads.select("seq", "dw_loaded_at", "rows", "greatest_key", (F.col("greatest_key") <= keys).alias("in_fact"))


def stage_skipped_files(spark, sf_dir):
    """What a load got from a curated folder in which one day's files broke off, another day's are gone and a foreign one lies about.

    Damage is done to files of their own days: those of one day lose their second half, those of another are removed.
    """
    folder = scratch_folder(spark, "damaged")
    tables.write_curated(_events_curated(spark, sf_dir), folder)
    files = manifest.recorded(spark, folder)
    fx.break_off(spark, folder, files.where(F.col("file").contains(f"ingest_date={BROKEN_DAY}")))
    fx.remove(spark, folder, files.where(F.col("file").contains(f"ingest_date={LOST_DAY}")))
    spark.range(1).select(F.lit("not a table").alias("value")).write.text(f"{folder}/{tables.APPEND}=foreign/ingest_date={FOREIGN_DAY}")
    fx.rename_texts(spark, f"{folder}/{tables.APPEND}=foreign/ingest_date={FOREIGN_DAY}")
    stage, report = tables.keep_stage(spark, folder, f"{folder}-stage")
    day = F.regexp_extract("file", "ingest_date=([0-9-]+)", 1).alias("ingest_date")
    lost = report.groupBy(day, "state").agg(
        F.coalesce(F.sum("promised_rows"), F.lit(0)).alias("promised_rows"), F.sum("read_rows").alias("read_rows"), F.coalesce(F.sum("lost_rows"), F.lit(0)).alias("lost_rows")
    )
    kept = stage.groupBy(F.date_format("ingest_date", "yyyy-MM-dd").alias("ingest_date")).agg(F.count(F.lit(1)).alias("staged_rows"))
    return lost.join(kept, "ingest_date", "left").na.fill(0, ["staged_rows"])


def batch_job(spark, sf_dir):
    """Landing files through the whole batch job: rows per day of the curated table, and the job's counts."""
    folder = scratch_folder(spark, "batch")
    fx.events_raw(spark, sf_dir).write.parquet(f"{folder}/landing")
    counts = run_batch(spark, f"{folder}/landing", f"{folder}/curated", f"{folder}/quarantine", "parquet", fx.NOW)
    days = tables.read_curated(spark, f"{folder}/curated").groupBy("ingest_date").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("txn_count_last_1h").alias("txns_in_windows"), F.sum("distinct_merchants_1h").alias("merchants_in_windows")
    )
    return days.withColumns({name: F.lit(counts[name]).cast("long") for name in ("total", "passed", "quarantined", "written")})


def check_declared_unique(spark, sf_dir):
    """Values that occur twice in a column that a warehouse table declares unique, per table."""
    star = _lines_star(spark, sf_dir)
    frames = {"dim_customer": star.customers, "dim_merchant": star.merchants, "dim_date": star.dates, "dim_fraud_signal": star.signals, "fact": star.fact}
    reports = [
        rows.duplicated_keys(frame, keys).agg(F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("repeated"))
        for name, keys in model.DECLARED_UNIQUE.items()
        for frame in (frames[name],)
    ]
    return functools.reduce(DataFrame.unionByName, reports)


def check_fact_not_null(spark, sf_dir):
    return rows.null_counts(_lines_star(spark, sf_dir).fact, model.FACT_REQUIRED)


def check_declarations(spark, sf_dir):
    """All that the fact declares, per column and from one scan of it, with a calendar that ends too early."""
    star = _lines_star(spark, sf_dir)
    dates = dims.build_dim_date(spark, fx.LINES_DATES[0], KNOWN_DATES_BEFORE)
    checked = rows.column_checks(star.fact, [model.DECLARED_UNIQUE["fact"]], model.FACT_REQUIRED, {**star_ops.references(star), "date_key": dates})
    # Counts that were not asked for are NULL, in which engines differ for numbers.
    return checked.select("column", *[F.col(name).cast("string") for name in checked.columns[1:]])


def check_unique(spark, sf_dir):
    return rows.duplicated_keys(_lines_stage(spark, sf_dir), ["transaction_id"])


def check_not_null(spark, sf_dir):
    return rows.null_counts(fx.events_raw(spark, sf_dir), ["transaction_id", "customer_id", "merchant_id", "amount_usd", "is_international"])


def check_foreign_keys(spark, sf_dir):
    """The loaded fact against its dimensions, with a calendar that ends too early."""
    star = _lines_star(spark, sf_dir)
    dates = dims.build_dim_date(spark, fx.LINES_DATES[0], KNOWN_DATES_BEFORE)
    return rows.orphan_counts(star.fact, {**star_ops.references(star), "date_key": dates})


# -- health -----------------------------------------------------------------


def _topic(spark, sf_dir):
    """Topic records with their arrival time; those of one town arrive cut off on their way,
    those of another with text for an amount."""
    records = landing.to_topic_records(fx.events_raw(spark, sf_dir))
    arrival = F.try_to_timestamp(F.get_json_object("value", "$.kafka_ingest_time"))
    cut_off = F.get_json_object("value", "$.city") == "Town 3"
    mistyped = F.regexp_replace("value", '"amount_usd":[^,]*', '"amount_usd":"none"')
    value = F.when(cut_off, F.substring("value", 1, 40)).when(F.get_json_object("value", "$.city") == "Town 2", mistyped)
    return records.withColumns({"timestamp": arrival, "value": value.otherwise(F.col("value"))})


def _health(spark, sf_dir):
    """With the event times of one merchant unreadable, so that only their arrival has a day."""
    parsed = landing.parse_topic_values(_topic(spark, sf_dir))
    broken = F.when(F.col("zip_code") == "00005", "unknown").otherwise(F.col("event_time"))
    flagged = _flag(fx.events_raw(spark, sf_dir).withColumn("event_time", broken))
    return panels.health_report(_events_star(spark, sf_dir).fact, flagged, parsed, fx.EVENTS_LAST_DAY)


def _logged(spark, sf_dir):
    """The load log after one load of the events by the job."""
    folder = scratch_folder(spark, "loads")
    return load_warehouse(spark, _events_stage(spark, sf_dir), f"{folder}/fact", f"{folder}/v1", None, fx.LOAD_TS).loads


def load_freshness(spark, sf_dir):
    now = fx.LOAD_TS + dt.timedelta(minutes=7, seconds=30)
    return panels.load_freshness(_logged(spark, sf_dir), now)


# -- streaming --------------------------------------------------------------


def stage_curated(spark, sf_dir):
    folder = scratch_folder(spark, "stage")
    tables.write_curated(_events_curated(spark, sf_dir), folder)
    return tables.read_stage(spark, folder)


def _event_stream(spark, sf_dir):
    schema = fx.table(spark, sf_dir, "events").schema
    events = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return fx.events_as_raw(events)


def stream_landing(spark, sf_dir):
    folder = scratch_folder(spark, "stream-landing")
    records = landing.to_topic_records(_event_stream(spark, sf_dir))
    land_topic(records, f"{folder}/data", f"{folder}/checkpoint", "parquet", None).awaitTermination()
    return landing.read_landing(spark, f"{folder}/data", "parquet").select(*model.RAW_SCHEMA.fieldNames())


def stream_validate(spark, sf_dir):
    folder = scratch_folder(spark, "stream-validate")
    valid_path, rejected_path = f"{folder}/valid", f"{folder}/quarantine"
    validate_stream(_event_stream(spark, sf_dir), valid_path, rejected_path, f"{folder}/checkpoint", fx.NOW, flush=None).awaitTermination()
    kept = spark.read.parquet(valid_path).select("transaction_id", F.lit("valid").alias("side"))
    rejected = spark.read.schema("transaction_id string").json(rejected_path)
    return kept.unionByName(rejected.select("transaction_id", F.lit("quarantined").alias("side")))


QUERIES = {
    # sources and sinks
    "scan_raw": scan_raw,
    "parse_json_events": parse_json_events,
    "kafka_records": kafka_records,
    "quarantine_roundtrip": quarantine_roundtrip,
    "curated_roundtrip": curated_roundtrip,
    "stage_curated": stage_curated,
    "stage_skipped_files": stage_skipped_files,
    "adhoc_sql": adhoc_sql,
    # validation
    "enforce_schema": lambda s, d: enforce_schema(fx.events_raw(s, d)),
    "validation_flags": lambda s, d: _events_flagged(s, d).select("transaction_id", *RULE_NAMES),
    "valid_rows": lambda s, d: split_flagged(_events_flagged(s, d))[0],
    "quarantine_rows": quarantine_rows,
    "validation_summary": lambda s, d: validation_summary(_events_flagged(s, d)),
    "lineitem_validation_summary": lineitem_validation_summary,
    "rule_failure_counts": lambda s, d: rule_failures(_events_flagged(s, d)),
    # features
    "time_features": time_features,
    "velocity_features": velocity_features,
    "velocity_approx": velocity_approx,
    "velocity_with_history": velocity_with_history,
    "velocity_late_rows": velocity_late_rows,
    "risk_tier": risk_tier,
    "merchant_segment": merchant_segment_literal,
    "merchant_segment_join": merchant_segment_join,
    "enrich": _events_curated,
    # dimensions and fact
    "dim_date": dim_date,
    "dim_fraud_signal": dim_fraud_signal,
    "merchant_candidates": merchant_candidates,
    "latest_merchant_row": latest_merchant_row,
    "dedup_transactions": dedup_transactions,
    "upsert_dim_merchant": upsert_dim_merchant,
    "upsert_dim_customer": upsert_dim_customer,
    "assign_surrogate_keys": assign_surrogate_keys,
    "load_star_fact": load_star_fact,
    "load_star_unresolved": load_star_unresolved,
    "incremental_fact_load": incremental_fact_load,
    "warehouse_load_twice": warehouse_load_twice,
    "warehouse_load_after_crash": warehouse_load_after_crash,
    "warehouse_unresolved": warehouse_unresolved,
    "load_log": load_log,
    "batch_job": batch_job,
    "check_declared_unique": check_declared_unique,
    "check_fact_not_null": check_fact_not_null,
    "check_declarations": check_declarations,
    "check_unique": check_unique,
    "check_not_null": check_not_null,
    "check_foreign_keys": check_foreign_keys,
    # views and sample questions
    "merchant_daily_performance": _performance,
    "fraud_velocity_alerts": _alerts,
    "customer_spend_profile": _profiles,
    "top_merchants_30d": lambda s, d: views.top_merchants(_lines_star(s, d), fx.LINES_AS_OF),
    "high_velocity_signals": lambda s, d: views.high_velocity_signals(_events_star(s, d)),
    # merchant panel
    "merchant_kpis": lambda s, d: panels.merchant_kpis(_recent_performance(s, d)).withColumn("avg_ticket", F.round("avg_ticket", 4)),
    "revenue_by_category": lambda s, d: panels.revenue_by_category(_recent_performance(s, d)),
    "revenue_share_by_segment": lambda s, d: panels.revenue_share_by_segment(_recent_performance(s, d)),
    "daily_revenue_trend": lambda s, d: panels.daily_revenue(_recent_performance(s, d)),
    "top20_merchants": lambda s, d: panels.top_merchants_table(_recent_performance(s, d)),
    "top20_merchants_formatted": lambda s, d: panels.format_top_merchants(panels.top_merchants_table(_recent_performance(s, d))),
    "latest_merchant_days": lambda s, d: panels.latest(_performance(s, d), "txn_date", ties=["merchant_id"]),
    # fraud panel
    "alert_kpis": lambda s, d: panels.alert_kpis(_alerts(s, d)),
    "alert_score_distribution": lambda s, d: panels.alert_score_distribution(_alerts(s, d)),
    "signal_heatmap": lambda s, d: panels.signal_heatmap(_alerts(s, d)),
    "velocity_profile": lambda s, d: panels.velocity_profile(_alerts(s, d)),
    "alert_feed": lambda s, d: panels.alert_feed(_alerts(s, d)),
    "latest_alerts": lambda s, d: panels.latest(_alerts(s, d), "event_time", ties=["transaction_id"]),
    # customer panel
    "customer_kpis": lambda s, d: panels.customer_kpis(_profiles(s, d)),
    "spend_segment_distribution": lambda s, d: panels.spend_segment_distribution(_profiles(s, d)),
    "recency_frequency": lambda s, d: panels.recency_frequency(_profiles(s, d)),
    "customer_table": lambda s, d: panels.customer_table(_profiles(s, d)),
    # health panel
    "health_report": _health,
    "quality_scorecard": lambda s, d: panels.quality_scorecard(_health(s, d)),
    "load_freshness": load_freshness,
    # streaming
    "stream_landing": stream_landing,
    "stream_validate": stream_validate,
}


# Results in which is_international can be NULL give it as text, as engines differ in nullable booleans.
NULLABLE_FLAG = {
    "scan_raw",
    "parse_json_events",
    "enforce_schema",
    "valid_rows",
    "enrich",
    "curated_roundtrip",
    "stage_curated",
    "stream_landing",
}


def registered():
    """Name to callable, with session time zone and output types settled."""

    def wrap(name, query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            result = query(use_utc(spark), sf_dir)
            if name in NULLABLE_FLAG:
                result = result.withColumn("is_international", F.col("is_international").cast("string"))
            return comparable(result)

        return run

    return {name: wrap(name, query) for name, query in QUERIES.items()}
