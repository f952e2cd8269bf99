"""A narrow index of the transaction ids a fact holds, bucketed by id.

A load must know which of its ids are there already. The index holds id and day of every fact row, in buckets by the id's hash,
so the join reads it where it lies: only the batch is shuffled, into as many partitions as there are buckets. Each load appends its own ids before it
is committed; those of loads that never were are left out.

The files lie beside the fact (``_ids``); the session's catalog only holds their description, which is made anew where it is missing.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FOLDER = "_ids"


def _qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, as a table's location is not taken from the working directory."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(folder).toString()


def _described(spark: SparkSession, fact_path: str, buckets: int) -> str:
    location = _qualified(spark, f"{fact_path}/{FOLDER}")
    name = f"cardflux_ids_{hashlib.md5(location.encode()).hexdigest()}"
    spark.sql(f"DROP TABLE IF EXISTS {name}")  # of the description; the files are external
    spark.sql(
        f"CREATE TABLE {name} (transaction_id STRING, ingest_date DATE, load_id STRING) USING parquet "
        f"CLUSTERED BY (transaction_id) INTO {buckets} BUCKETS LOCATION '{location}'"
    )
    return name


def indexed_ids(spark: SparkSession, fact_path: str, buckets: int, hidden: list[str]) -> DataFrame:
    """``transaction_id, ingest_date`` of the fact's rows, except those of the loads ``hidden``."""
    known = spark.table(_described(spark, fact_path, buckets))
    if hidden:
        known = known.where(~F.col("load_id").isin(hidden))
    return known.select("transaction_id", "ingest_date")


def append_ids(fact: DataFrame, fact_path: str, buckets: int, load_id: str) -> None:
    """One file per bucket and load."""
    spark = fact.sparkSession
    ids = fact.select("transaction_id", "ingest_date", F.lit(load_id).alias("load_id"))
    ids.repartition(buckets, "transaction_id").write.insertInto(_described(spark, fact_path, buckets))
