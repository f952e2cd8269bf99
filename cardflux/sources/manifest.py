"""What each append put into a folder, file by file, so that a reader can tell what it did not get.

An append writes into a folder of its own, ``<root>/<key>=<id>/``, which partition discovery reads as one more
partition column. Afterwards its files are recorded below ``<root>/_manifest/``, which readers of the folder skip, with the rows and bytes
that each holds as written. A read reports rows per file; against the manifest that shows files that are missing, that broke off, that
lost rows in the middle, and files that nobody recorded.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FILES = "file string, rows long, bytes long"
FOLDER = "_manifest"


@dataclass(frozen=True)
class Appended:
    """What one append recorded."""

    append_id: str
    rows: int
    files: int
    bytes: int


def read_if_there(spark: SparkSession, schema: StructType | str, path: str, **options: str) -> DataFrame | None:
    """A Parquet folder, or None where there is none."""
    try:
        return spark.read.schema(schema).options(**options).parquet(path)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def new_id() -> str:
    return uuid.uuid4().hex


def file_name(path: Column, key: str) -> Column:
    """A file's name from its append's folder on; the bare name of a file outside of any."""
    plain = F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    inside = F.regexp_extract(plain, f"({key}=[^/]+/.*)$", 1)
    return F.when(inside != "", inside).otherwise(F.regexp_extract(plain, "([^/]*)$", 1))


def record(spark: SparkSession, schema: StructType, root: str, key: str, append_id: str) -> Appended:
    """Record the files of an append. Counting rows takes the files' footers, not their data."""
    name = F.col("_metadata.file_path")
    found = spark.read.schema(schema).parquet(f"{root}/{key}={append_id}")
    lines = found.groupBy(file_name(name, key).alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.max("_metadata.file_size").alias("bytes"))
    folder = f"{root}/{FOLDER}/{key}={append_id}"
    lines.coalesce(1).write.mode("overwrite").parquet(folder)
    total = spark.read.schema(FILES).parquet(folder).agg(F.sum("rows"), F.count(F.lit(1)), F.sum("bytes")).first()
    return Appended(append_id, total[0] or 0, total[1], total[2] or 0)


def recorded(spark: SparkSession, root: str) -> DataFrame:
    """Every recorded file of a folder; empty if none ever was."""
    found = read_if_there(spark, FILES, f"{root}/{FOLDER}", recursiveFileLookup="true")
    return spark.createDataFrame([], FILES) if found is None else found


def with_file(rows: DataFrame, key: str) -> DataFrame:
    """Rows of a folder with the name of the file each was read from."""
    return rows.withColumn("file", file_name(F.col("_metadata.file_path"), key))


def file_report(spark: SparkSession, root: str, key: str, read: DataFrame) -> DataFrame:
    """Per file what was promised, what is there and what was read; ``read`` holds the rows that were, with their ``file``.

    ``whole``: all rows were read; ``damaged``: fewer rows than recorded; ``missing``: recorded, but gone;
    ``unrecorded``: read, but not recorded; ``unreadable``: neither recorded nor read. All sides have one row per file.
    """
    listed = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(root)
    there = listed.select(file_name(F.col("path"), key).alias("file"), F.col("length").alias("found_bytes")).where(~F.col("path").contains(f"/{FOLDER}/"))
    got = read.groupBy("file").agg(F.count(F.lit(1)).alias("read_rows"))
    promised = recorded(spark, root).select("file", F.col("rows").alias("promised_rows"), F.col("bytes").alias("promised_bytes"))
    files = promised.join(there, "file", "full").join(got, "file", "full").withColumn("read_rows", F.coalesce("read_rows", F.lit(0)))
    state = (
        F.when(F.col("promised_rows").isNull(), F.when(F.col("read_rows") > 0, "unrecorded").otherwise("unreadable"))
        .when(F.col("found_bytes").isNull(), "missing")
        .when(F.col("read_rows") < F.col("promised_rows"), "damaged")
        .otherwise("whole")
    )
    lost = F.greatest(F.col("promised_rows") - F.col("read_rows"), F.lit(0))
    return files.select("file", state.alias("state"), "promised_rows", "read_rows", lost.alias("lost_rows"), "promised_bytes", "found_bytes")
