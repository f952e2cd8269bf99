"""Batch jobs: landing to curated, and curated to the star schema."""

from __future__ import annotations

import datetime as dt
from dataclasses import replace

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from cardflux.model import LIMITS, Limits
from cardflux.operators.dimensions import FIRST_DATE, LAST_DATE, build_dim_date, build_dim_fraud_signal, upsert_dim_customer, upsert_dim_merchant
from cardflux.operators.enrichment import enrich
from cardflux.operators.star import Star, as_fact, distinct_transactions, look_up_keys, missing_keys, not_indexed, number_fact
from cardflux.operators.validation import enforce_schema, flag_rules, validation_counts
from cardflux.sources import ledger
from cardflux.sources.ids import append_ids, indexed_ids
from cardflux.sources.landing import read_landing
from cardflux.sources.scratch import scratch_folder
from cardflux.sources.tables import append_fact, keep_stage, read_fact, read_stage, store_judged, to_stage, write_curated, write_quarantine


class NothingValid(ValueError):
    """No record of the batch passed validation."""


def run_validation(
    raw: DataFrame, quarantine_path: str, now: dt.datetime | None = None, limits: Limits = LIMITS
) -> tuple[DataFrame, dict[str, int]]:
    """Quarantine the rejected rows and hand on the valid ones, with the counts of the batch.

    The input is read and judged once: rows are stored by verdict and counted on their way, and each side is a
    partition of what was stored. An empty batch, or one without a valid row, raises, with its rejected rows in quarantine.
    """
    counts = Observation()
    flagged = flag_rules(enforce_schema(raw), now or dt.datetime.now(dt.timezone.utc), limits)
    valid, invalid = store_judged(flagged.observe(counts, *validation_counts()), scratch_folder(raw.sparkSession, "judged"))
    write_quarantine(invalid, quarantine_path)
    measured = counts.get
    if not measured["passed"]:
        raise NothingValid("no record passed validation")
    return valid, measured


def run_batch(
    spark: SparkSession,
    input_path: str,
    curated_path: str,
    quarantine_path: str,
    fmt: str = "avro",
    now: dt.datetime | None = None,
    history: DataFrame | None = None,
    limits: Limits = LIMITS,
) -> dict[str, int]:
    """Landing files to curated rows: validate, enrich, append. Returns the counts of the batch.

    The landing files are scanned once; the features read the stored valid rows.
    """
    valid, counts = run_validation(read_landing(spark, input_path, fmt), quarantine_path, now, limits)
    written = write_curated(enrich(valid, history, limits), curated_path)
    return {**counts, "written": written}


DIMENSIONS = ("dim_customer", "dim_merchant", "dim_date", "dim_fraud_signal")


def _read_dimensions(spark: SparkSession, folder: str) -> Star:
    return Star(*[spark.read.parquet(f"{folder}/{name}") for name in DIMENSIONS])


def _calendar_span(stage: DataFrame, known: DataFrame | None) -> tuple[dt.date, dt.date]:
    """From the earliest to the latest day of the default calendar, the old calendar and the batch."""
    days = stage.select(F.col("ingest_date").alias("day"))
    if known is not None:
        days = days.union(known.select("full_date"))
    first, last = days.agg(F.min("day"), F.max("day")).first()
    return min(filter(None, (FIRST_DATE, first))), max(filter(None, (LAST_DATE, last)))


def load_warehouse(
    spark: SparkSession,
    curated: DataFrame | str,
    fact_path: str,
    new_version: str,
    old_version: str | None = None,
    load_ts: dt.datetime | None = None,
    first_date: dt.date | None = None,
    last_date: dt.date | None = None,
    limits: Limits = LIMITS,
    same_days_only: bool = False,
    skip_unreadable: bool = False,
    id_buckets: int | None = None,
) -> Star:
    """Load one batch: dimensions first, then the fact, then the entry that makes the load count.

    The dimensions are written whole to the folder ``new_version`` and read back, so the fact joins
    stored keys. They start from ``old_version`` or, without it, from those of the last committed load; that
    folder is never written to. Re-running a load adds no fact row, also after it broke off anywhere: nothing of a load is there
    for readers before its last entry in the ledger, and ids that the fact holds by then are skipped.

    Row keys go on from the greatest one in the ledger, and known ids come from the index beside the fact, in ``id_buckets``
    buckets as the first load chose (the session's shuffle partitions by default; choose them so that a bucket of the whole fact's ids suits
    a task); the fact itself is only appended to.

    The calendar spans the batch, unless ``first_date`` or ``last_date`` cut it. Nothing is lost without a
    trace: rows without a dimension match are kept in ``new_version`` and returned as ``unresolved``;
    an unreadable file ends the load, or with ``skip_unreadable`` is reported in ``skipped``, as is what a damaged file lost.
    """
    load_ts = load_ts or dt.datetime.now(dt.timezone.utc)
    before = ledger.last_load(spark, fact_path)
    hidden = ledger.uncommitted(spark, fact_path) or []
    id_buckets = id_buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    if before is not None:
        id_buckets = before["id_buckets"]
        old_version = old_version or (before["base"] if before["version"] == new_version else before["version"])
    load_id = ledger.begin(spark, fact_path)
    skipped = None
    if not isinstance(curated, str):
        stage = to_stage(curated) if "event_time_ts" in curated.columns else curated
    elif skip_unreadable:
        stage, files = keep_stage(spark, curated, f"{new_version}/stage")
        skipped = files.where("state <> 'whole'")
    else:
        stage = read_stage(spark, curated)

    old = _read_dimensions(spark, old_version) if old_version else None
    first, last = (first_date, last_date) if first_date and last_date else _calendar_span(stage, old.dates if old else None)
    dims = {
        "dim_customer": upsert_dim_customer(old.customers if old else None, stage, load_ts),
        "dim_merchant": upsert_dim_merchant(old.merchants if old else None, stage, load_ts),
        "dim_date": build_dim_date(spark, first_date or first, last_date or last),
        "dim_fraud_signal": build_dim_fraud_signal(spark),
    }
    for name, frame in dims.items():
        frame.write.mode("overwrite").parquet(f"{new_version}/{name}")
    star = _read_dimensions(spark, new_version)

    new = distinct_transactions(stage)
    if before is not None:
        new = not_indexed(new, indexed_ids(spark, fact_path, id_buckets, hidden), id_buckets, stage if same_days_only else None)
    # Looked up once and kept by outcome: both sides are read back by partition.
    found = look_up_keys(new, star, limits).withColumn("missing_keys", missing_keys())
    found.withColumn("resolved", F.col("missing_keys") == "").write.mode("overwrite").partitionBy("resolved").parquet(f"{new_version}/looked_up")
    looked_up = spark.read.schema(StructType([*found.schema.fields, StructField("resolved", BooleanType())])).parquet(f"{new_version}/looked_up")
    added = number_fact(as_fact(looked_up.where("resolved"), load_ts), after=before["greatest_key"] if before else 0)
    appended = append_fact(added, fact_path, load_id)
    append_ids(looked_up.where("resolved"), fact_path, id_buckets, load_id)
    ledger.commit(spark, fact_path, appended, before, load_ts, new_version, old_version, id_buckets)
    return replace(
        star,
        fact=read_fact(spark, fact_path),
        unresolved=looked_up.where("NOT resolved").select(*stage.columns, "missing_keys"),
        skipped=skipped,
        loads=ledger.loads(spark, fact_path),
    )
