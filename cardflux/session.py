"""Session factory: the same settings locally and on a cluster, except for the master."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
    # A load compiles more stages than the default 100 entries hold.
    "spark.sql.codegen.cache.maxEntries": "1000",
}


def get_spark(app_name: str = "cardflux", extra: dict[str, str] | None = None) -> SparkSession:
    """Build (or reuse) a session.

    With ``SPARK_ENV=local`` (the default) it runs on every local core; any other value leaves
    master, memory and shuffle width to the cluster. There, start from many shuffle partitions
    and let adaptive execution merge them; ``extra`` carries deployment settings such as catalogs.
    """
    builder = SparkSession.builder.appName(app_name)
    if os.getenv("SPARK_ENV", "local") == "local":
        builder = (
            builder.master("local[*]")
            .config("spark.driver.memory", "4g")
            .config("spark.sql.shuffle.partitions", "8")
            .config("spark.ui.enabled", "false")
        )
    else:
        builder = builder.config("spark.sql.adaptive.coalescePartitions.initialPartitionNum", "20000")
    for name, value in {**SETTINGS, **(extra or {})}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def use_utc(spark: SparkSession) -> SparkSession:
    """Calendar features and dates are defined in UTC, whatever the session came with."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark
