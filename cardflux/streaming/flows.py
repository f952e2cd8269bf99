"""Streaming jobs. Validation is stateless, so the batch functions serve unchanged; rolling features
stay a batch step, because range windows need rows that a stream no longer has."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from cardflux.model import LIMITS, Limits
from cardflux.operators.validation import enforce_schema, flag_rules
from cardflux.sources.landing import parse_topic_values
from cardflux.sources.tables import by_day, store_judged

FLUSH_INTERVAL = "5 minutes"
#: How long after its arrival a record is known again.
REPEATS_WITHIN = "1 day"


def _trigger(flush: str | None) -> dict:
    """``None`` drains what is there and stops; otherwise one micro-batch per interval."""
    return {"availableNow": True} if flush is None else {"processingTime": flush}


def read_topic(spark: SparkSession, bootstrap_servers: str, topic: str, most_records: int | None = None) -> DataFrame:
    """Keyed topic records, at most ``most_records`` per micro-batch. Needs the Kafka connector package."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", bootstrap_servers).option("subscribe", topic)
    if most_records is not None:
        reader = reader.option("maxOffsetsPerTrigger", most_records)
    return reader.load().select("key", "value", "timestamp")


def land_topic(
    records: DataFrame,
    path: str,
    checkpoint: str,
    fmt: str = "avro",
    flush: str | None = FLUSH_INTERVAL,
    repeats_within: str | None = REPEATS_WITHIN,
    files_per_hour: int = 1,
) -> StreamingQuery:
    """Write topic records to landing files by event day and hour, one flush per micro-batch.

    The checkpoint makes the file sink exactly-once across restarts. Records that are no event at
    all keep their text in ``_corrupt_record`` and land in the NULL day.

    A record that the topic delivers again within ``repeats_within`` of its arrival lands once. The watermark is on arrival
    here, not on the event, so no record is ever late, and the state holds one digest per record of that
    time. Records alike in id but not in content all land: which of them counts is for the rules and the load to say.
    Each hour of a day is written by ``files_per_hour`` tasks, so a flush makes that many files of it.
    """
    if repeats_within is not None:
        seen = records.withColumns({"_arrived": F.current_timestamp(), "_digest": F.sha2(F.col("value").cast("string"), 256)})
        seen = seen.withWatermark("_arrived", repeats_within).dropDuplicatesWithinWatermark(["_digest"])
        records = seen.drop("_arrived")
    parsed = parse_topic_values(records)
    event_time = F.try_to_timestamp(F.col("event_time"))
    placed = parsed.withColumns({"event_date": F.to_date(event_time), "event_hour": F.hour(event_time)})
    part = F.pmod(F.xxhash64("transaction_id"), F.lit(files_per_hour))
    return (
        placed.drop("_digest")
        .repartition("event_date", "event_hour", part)
        .writeStream.format(fmt)
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("event_date", "event_hour")
        .trigger(**_trigger(flush))
        .start()
    )


def validate_stream(
    raw: DataFrame,
    valid_path: str,
    quarantine_path: str,
    checkpoint: str,
    now: dt.datetime | None = None,
    limits: Limits = LIMITS,
    flush: str | None = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Split a stream of raw events into valid rows (Parquet) and quarantined rows (JSON).

    Each micro-batch overwrites folders of its own, so repeating one after a failure leaves no
    duplicates; a folder carries the query's id, which the checkpoint keeps, so a query with a new checkpoint
    overwrites nothing. A batch is judged once: its rows are stored by verdict beside the checkpoint, however many there are, and both
    sides are read back from there. ``now`` defaults to the batch's start.
    """

    def write_both(batch: DataFrame, batch_id: int) -> None:
        judged_at = now or dt.datetime.now(dt.timezone.utc)
        run = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        # Batches run one after the other, so the next one may overwrite what this one judged.
        valid, invalid = store_judged(flag_rules(enforce_schema(batch), judged_at, limits), f"{checkpoint}-judged/query_id={run}")
        folder = f"query_id={run}/batch_id={batch_id}"
        by_day(valid).write.mode("overwrite").partitionBy("ingest_date").parquet(f"{valid_path}/{folder}")
        by_day(invalid).write.mode("overwrite").partitionBy("ingest_date").json(f"{quarantine_path}/{folder}")

    return (
        raw.writeStream.foreachBatch(write_both)
        .option("checkpointLocation", checkpoint)
        .trigger(**_trigger(flush))
        .start()
    )
