"""Quarantine, curated, stage and fact storage.

Writers that partition by day first rebalance on the day: adaptive execution then splits a day that
holds much of the batch over several tasks and packs small days together, so file sizes stay even.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from cardflux import model
from cardflux.functions.rules import RULE_NAMES, all_passed
from cardflux.operators.validation import with_reasons
from cardflux.sources import ledger, manifest

#: Partition columns that tell appends of the curated folder and loads of the fact apart.
APPEND = "append_id"
LOAD = "load_id"


def by_day(df: DataFrame) -> DataFrame:
    return df.hint("rebalance", F.col("ingest_date"))


def store_judged(flagged: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows with rule verdicts, stored once by outcome: the valid side and the rejected side, each read back by partition."""
    judged = flagged.withColumn("is_valid", all_passed())
    judged.write.mode("overwrite").partitionBy("is_valid").parquet(folder)
    kept = flagged.sparkSession.read.schema(judged.schema).parquet(folder)
    valid = kept.where("is_valid").drop(*RULE_NAMES, "is_valid")
    return valid, with_reasons(kept.where("NOT is_valid").drop("is_valid"))


def write_quarantine(invalid: DataFrame, path: str) -> int:
    """Append rejected rows as JSON under their day and return how many there were, in one pass."""
    seen = Observation()
    by_day(invalid.observe(seen, F.count(F.lit(1)).alias("rows"))).write.mode("append").partitionBy("ingest_date").json(path)
    return seen.get["rows"]


def read_quarantine(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def create_curated_table(spark: SparkSession, table: str, fmt: str = "parquet") -> None:
    """Create the curated table unless it exists. ``fmt='iceberg'`` needs that runtime and its catalog."""
    columns = ", ".join(
        f"{field.name} {field.dataType.simpleString()}"
        + (" NOT NULL" if field.name in ("transaction_id", "customer_id", "merchant_id") and fmt == "iceberg" else "")
        for field in model.CURATED_SCHEMA
    )
    partitioning = "days(ingest_date)" if fmt == "iceberg" else "ingest_date"
    options = (
        "TBLPROPERTIES ('write.format.default'='parquet', 'write.parquet.compression-codec'='snappy')"
        if fmt == "iceberg"
        else "OPTIONS (compression 'snappy')"
    )
    layout = f"{options} PARTITIONED BY ({partitioning})" if fmt != "iceberg" else f"PARTITIONED BY ({partitioning}) {options}"
    spark.sql(f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING {fmt} {layout}")


def append_curated_table(enriched: DataFrame, table: str, fmt: str = "parquet") -> None:
    rows = by_day(enriched.select(*model.CURATED_COLUMNS))
    if fmt == "iceberg":
        rows.writeTo(table).append()
    else:
        rows.select(*rows.sparkSession.table(table).columns).write.insertInto(table)


def write_curated(enriched: DataFrame, path: str) -> int:
    """Append a batch to the curated Parquet folder and record its files; returns the rows that the files hold.

    The rows are counted on their way, too: an append whose files hold a different number is not recorded.
    """
    seen, append_id = Observation(), manifest.new_id()
    rows = enriched.select(*model.CURATED_COLUMNS).observe(seen, F.count(F.lit(1)).alias("rows"))
    by_day(rows).write.partitionBy("ingest_date").option("compression", "snappy").parquet(f"{path}/{APPEND}={append_id}")
    appended = manifest.record(enriched.sparkSession, model.CURATED_SCHEMA, path, APPEND, append_id)
    if appended.rows != seen.get["rows"]:
        raise OSError(f"{seen.get['rows']} rows were written to {path}, but its files hold {appended.rows}")
    return appended.rows


def _curated(spark: SparkSession, path: str, skip_unreadable: bool) -> DataFrame:
    return spark.read.schema(model.CURATED_SCHEMA).option("ignoreCorruptFiles", str(skip_unreadable).lower()).parquet(path)


def read_curated(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    """Columns are matched by name whatever their case.

    An unreadable file ends the job, unless ``skip_unreadable``; :func:`keep_stage` tells what is then left out.
    """
    return _curated(spark, path, skip_unreadable).select(*model.CURATED_COLUMNS)


def keep_stage(spark: SparkSession, path: str, folder: str) -> tuple[DataFrame, DataFrame]:
    """The readable rows of the curated folder as a stage, stored in ``folder``, and a report of each of its files.

    A file that breaks off gives what can be read before the break. Storing it once gives every later step the same
    rows, and the rows per file are counted on what was stored, not by reading the damaged files again.
    """
    to_stage(_curated(spark, path, True), "_metadata").withColumn("file", manifest.file_name(F.col("_metadata.file_path"), APPEND)).drop(
        "_metadata"
    ).write.mode("overwrite").parquet(folder)
    kept = spark.read.parquet(folder)
    return kept.drop("file"), manifest.file_report(spark, path, APPEND, kept)


def to_stage(curated: DataFrame, *further: str) -> DataFrame:
    """Narrow curated rows to warehouse types; ``event_time`` becomes the UTC wall clock."""
    return curated.withColumns(
        {
            "amount_usd": F.col("amount_usd").cast(model.AMOUNT_TYPE),
            "spend_velocity_24h": F.col("spend_velocity_24h").cast(model.TOTAL_TYPE),
            "event_time": F.col("event_time_ts").cast("timestamp_ntz"),
        }
    ).select(*model.STAGE_COLUMNS, *further)


def read_stage(spark: SparkSession, path: str, skip_unreadable: bool = False) -> DataFrame:
    return to_stage(read_curated(spark, path, skip_unreadable))


def read_fact(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored fact with its declared schema, or None where nothing was loaded yet.

    Of a fact that loads write, the rows of committed loads; loads are folders, so the others are not even opened.
    """
    hidden = ledger.uncommitted(spark, path)
    schema = model.FACT_SCHEMA if hidden is None else f"{model.FACT_SCHEMA}, {LOAD} string"
    found = manifest.read_if_there(spark, schema, path)
    if found is None or (hidden is not None and ledger.loads(spark, path) is None):
        return None
    if hidden:
        found = found.where(~F.col(LOAD).isin(hidden))
    return found.select(*model.FACT_COLUMNS)


def write_fact(fact: DataFrame, path: str) -> None:
    """Append fact rows clustered by day and merchant.

    The transaction id closes the range key so that a merchant with much of a day's traffic is cut
    into several tasks; row groups stay narrow in ``merchant_key`` for min/max skipping.
    """
    (
        fact.repartitionByRange("ingest_date", "merchant_key", "transaction_id")
        .sortWithinPartitions("ingest_date", "merchant_key", "transaction_id")
        .write.mode("append")
        .partitionBy("ingest_date")
        .parquet(path)
    )


def append_fact(fact: DataFrame, path: str, load_id: str) -> manifest.Appended:
    """Fact rows of one load, in its folder, and their record. They are there for readers once the load is committed."""
    write_fact(fact, f"{path}/{LOAD}={load_id}")
    return manifest.record(fact.sparkSession, model.FACT_SCHEMA, path, LOAD, load_id)
