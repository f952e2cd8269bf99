"""Raw transactions derived from the given tables.

``events_raw`` turns the event stream into dense card traffic (every velocity threshold is
reached); ``lineitem_raw`` turns order lines into wide traffic (many customers and merchants,
repeated transaction ids, amounts over the limit).
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions.calendar import iso_utc
from cardflux.model import RAW_SCHEMA

NOW = dt.datetime(2026, 1, 1, tzinfo=dt.timezone.utc)
LOAD_TS = dt.datetime(2024, 1, 31, tzinfo=dt.timezone.utc)

EVENTS_DATES = (dt.date(2024, 1, 1), dt.date(2024, 12, 31))
EVENTS_AS_OF = dt.date(2024, 1, 31)
EVENTS_LAST_DAY = dt.date(2024, 1, 30)
LINES_DATES = (dt.date(1995, 1, 1), dt.date(2001, 12, 31))
LINES_AS_OF = dt.date(2001, 11, 5)

USERS_PER_CUSTOMER = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(value) for value in values]), (F.pmod(index, F.lit(len(values))) + 1).cast("int"))


def uuid_text(text: Column) -> Column:
    """Empty for NULL. The digest is named once, as a filter computes each of its mentions."""
    return F.coalesce(F.regexp_replace(F.md5(text), "^(.{8})(.{4})(.{4})(.{4})", "$1-$2-$3-$4-"), F.lit(""))


def events_as_raw(events: DataFrame) -> DataFrame:
    """Neighbouring users share a customer, so that each has dense traffic and no row depends on others."""
    customer = F.floor(F.col("user_id") / USERS_PER_CUSTOMER)
    merchant = F.pmod("event_id", F.lit(37))
    arrival = F.expr("timestampadd(SECOND, CAST(event_id % 300 AS INT), ts)")
    kind = (
        F.when(F.col("event_type") == "purchase", "purchase")
        .when(F.col("event_type") == "signup", "refund")
        .when(F.col("event_type") == "view", "chargeback")
        .when(F.col("event_type") == "click", "atm_withdrawal")
        .otherwise(F.col("event_type"))
    )
    columns = {
        "transaction_id": uuid_text(F.col("event_id").cast("string")),
        "customer_id": F.concat(F.lit("CUST_"), customer),
        "merchant_id": F.concat(F.lit("MER_"), merchant),
        "merchant_name": F.concat(F.lit("Merchant "), merchant),
        "merchant_category": pick([*model.MERCHANT_CATEGORIES, "pawn_shop"], merchant),
        "city": F.concat(F.lit("Town "), F.pmod(merchant, F.lit(5))),
        "state": F.concat(F.lit("S"), F.pmod(merchant, F.lit(5))),
        "amount_usd": F.col("value"),
        "currency": F.lit("USD"),
        "account_type": pick(model.ACCOUNT_TYPES, customer),
        "transaction_type": kind,
        "channel": pick(model.CHANNELS, F.col("event_id")),
        "event_time": iso_utc(F.col("ts")),
        "kafka_ingest_time": iso_utc(arrival),
        "is_international": F.when(F.pmod("event_id", F.lit(97)) != 0, F.pmod("event_id", F.lit(5)) == 0),
        "zip_code": F.lpad(merchant.cast("string"), 5, "0"),
    }
    return events.select(*[columns[name].alias(name) for name in RAW_SCHEMA.fieldNames()])


def events_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_raw(table(spark, sf_dir, "events"))


def lineitem_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice", "l_shipdate")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Customers go to the orders, of which there are fewer than lines. Lines and orders grow together, so neither side of their
    # join is ever broadcast. Suppliers come as they are read, as Spark knows the size of a table but not that of a join:
    # where they are small the lines are shuffled for their orders only.
    placed = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).hint("merge")
    joined = (
        lines.join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
        .join(nations, F.col("s_nationkey") == F.col("n_nationkey"))
    )
    columns = {
        "transaction_id": uuid_text(F.concat_ws("-", "l_orderkey", "l_linenumber")),
        "customer_id": F.concat(F.lit("CUST_"), "o_custkey"),
        "merchant_id": F.concat(F.lit("MER_"), "l_suppkey"),
        "merchant_name": F.col("s_name"),
        "merchant_category": pick(model.MERCHANT_CATEGORIES, F.col("l_suppkey")),
        "city": F.col("n_name"),
        "state": F.upper(F.substring("n_name", 1, 2)),
        "amount_usd": F.col("l_extendedprice"),
        "currency": F.lit("USD"),
        "account_type": pick(model.ACCOUNT_TYPES, F.col("o_custkey")),
        "transaction_type": pick(model.TRANSACTION_TYPES, F.col("o_orderkey")),
        "channel": pick(model.CHANNELS, F.col("l_linenumber")),
        "event_time": iso_utc(F.col("l_shipdate")),
        "kafka_ingest_time": iso_utc(F.col("l_shipdate")),
        "is_international": F.col("s_nationkey") != F.col("c_nationkey"),
        "zip_code": F.lit(None).cast("string"),
    }
    return joined.select(*[columns[name].alias(name) for name in RAW_SCHEMA.fieldNames()])


# -- damage to stored files, one bounded stream or name at a time ------------


def _paths(spark: SparkSession, root: str, files: DataFrame):
    """File system and path of each named file; as many names as the damaged days have files."""
    hadoop = spark._jvm.org.apache.hadoop
    for row in files.select("file").toLocalIterator():
        path = hadoop.fs.Path(f"{root}/{row['file']}")
        yield path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def break_off(spark: SparkSession, root: str, files: DataFrame) -> None:
    """Keep the first half of each file."""
    hadoop = spark._jvm.org.apache.hadoop
    for system, path in _paths(spark, root, files):
        half = hadoop.fs.Path(f"{path.toString()}.half")
        source, target = system.open(path), system.create(half)
        spark._jvm.org.apache.commons.io.IOUtils.copyLarge(source, target, 0, system.getFileStatus(path).getLen() // 2)
        source.close()
        target.close()
        system.delete(path, False)
        system.rename(half, path)


def remove(spark: SparkSession, root: str, files: DataFrame) -> None:
    for system, path in _paths(spark, root, files):
        system.delete(path, False)


def rename_texts(spark: SparkSession, folder: str) -> None:
    """Give the text files of a folder names as tables have them."""
    hadoop = spark._jvm.org.apache.hadoop
    path = hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in system.globStatus(hadoop.fs.Path(f"{folder}/*.txt")):
        system.rename(status.getPath(), status.getPath().suffix(".parquet"))
