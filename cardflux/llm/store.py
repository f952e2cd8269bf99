"""Intermediate tables in the cluster's shared folder, each written once and read back."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession

from cardflux.sources.scratch import scratch_folder

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _cleanup(spark: SparkSession) -> Iterator[None]:
    """Queries that are made in here delete their shuffle files as they end."""
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)


def collected(df: DataFrame) -> list[Row]:
    """The rows of a frame of bounded size; the shuffle files behind them are deleted at once, as many passes may follow each other."""
    with _cleanup(df.sparkSession):
        return df.select("*").collect()


def stored(df: DataFrame, purpose: str, compression: str | None = None) -> DataFrame:
    """``df`` written to a fresh folder and read back.

    This cuts the lineage, so that a lost executor costs a re-read and not a recomputation, and lets
    Spark delete the shuffle files of the finished step at once.
    """
    spark = df.sparkSession
    folder = scratch_folder(spark, purpose)
    with _cleanup(spark):
        df.write.parquet(folder, compression=compression)
    frame = spark.read.schema(df.schema).parquet(folder)
    frame._stored_in = folder
    return frame


def discard(*frames: DataFrame) -> None:
    """Delete stored steps that the next stored step has replaced.

    Only steps that no frame still to be run reads may be given: what is stored later does not lead back to them.
    """
    for frame in frames:
        hadoop = frame.sparkSession._jvm.org.apache.hadoop.fs
        path = hadoop.Path(frame._stored_in)
        path.getFileSystem(frame.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def require(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Only ``columns`` of ``df``, found without regard to what else it carries."""
    return df.select(*[df[name] for name in columns])
