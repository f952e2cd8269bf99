"""Raw events: landing files, JSON lines and keyed topic records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cardflux.model import RAW_SCHEMA

CORRUPT = "_corrupt_record"
# All fields as text: a field of the wrong type is a violation of its record, not a record that does not parse.
_JSON_SCHEMA = StructType([StructField(name, StringType()) for name in [*RAW_SCHEMA.fieldNames(), CORRUPT]])


def read_landing(spark: SparkSession, path: str, fmt: str = "avro") -> DataFrame:
    """Landing files with the declared raw schema. ``avro`` needs the spark-avro package."""
    return spark.read.schema(RAW_SCHEMA).format(fmt).load(path)


def read_json_events(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, one event each; lines that do not parse keep their text in ``_corrupt_record``.

    Lines are read as text and parsed by expression: the JSON reader refuses queries on its corrupt
    record column alone.
    """
    return parse_topic_values(spark.read.text(path))


def parse_topic_values(records: DataFrame, value: str = "value") -> DataFrame:
    """Replace the JSON ``value`` of topic records (batch or stream) by the event's columns.

    A value that is not of its column's type becomes NULL, which the rules reject.
    """
    options = {"columnNameOfCorruptRecord": CORRUPT}
    event = F.from_json(F.col(value).cast("string"), _JSON_SCHEMA, options)
    kept = [name for name in records.columns if name not in (value, *_JSON_SCHEMA.fieldNames())]
    typed = [F.col(f"_event.{field.name}").try_cast(field.dataType).alias(field.name) for field in RAW_SCHEMA]
    return records.withColumn("_event", event).select(*kept, *typed, f"_event.{CORRUPT}")


def dead_letters(parsed: DataFrame) -> DataFrame:
    """Records whose text was no event at all."""
    return parsed.where(F.col(CORRUPT).isNotNull())


def to_topic_records(events: DataFrame) -> DataFrame:
    """Key each event by its customer and encode the whole row as JSON, ready for a topic sink."""
    return events.select(F.col("customer_id").alias("key"), F.to_json(F.struct(*events.columns)).alias("value"))


def write_topic(events: DataFrame, bootstrap_servers: str, topic: str) -> None:
    """Publish events. Needs the Kafka connector package."""
    (
        to_topic_records(events)
        .write.format("kafka")
        .option("kafka.bootstrap.servers", bootstrap_servers)
        .option("topic", topic)
        .save()
    )
