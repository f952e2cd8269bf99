"""The log of loads of a stored fact. Only what it calls committed exists for readers.

A load first enters that it begins. Its files go to a folder of its own, and one last entry commits it, with what the next load
starts from: the greatest row key and the folder of the dimensions. So a load that breaks off anywhere leaves nothing behind
that a reader sees, and running it again is a new load. Entries are single small files that are only ever added.

One load at a time may run on a fact. Two that overlap would commit under the same number; the second one fails.
"""

from __future__ import annotations

import datetime as dt

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cardflux.sources.manifest import Appended, new_id, read_if_there

BEGUN = "load_id string, begun_at timestamp"
COMMITTED = (
    "seq int, load_id string, dw_loaded_at timestamp_ntz, committed_at timestamp, rows long, greatest_key long, files long, bytes long, "
    "version string, base string, id_buckets int"
)
FOLDER = "_ledger"


class OverlappingLoad(RuntimeError):
    """Another load was committed after this one began."""


def _add(spark: SparkSession, entry: dict[str, Column], schema: str, path: str) -> None:
    kinds = dict(field.split(" ") for field in schema.split(", "))
    spark.range(0, 1, 1, 1).select(*[entry[name].cast(kind).alias(name) for name, kind in kinds.items()]).write.mode("errorifexists").parquet(path)


def begin(spark: SparkSession, fact_path: str) -> str:
    """Enter a new load and return its id."""
    load_id = new_id()
    _add(spark, {"load_id": F.lit(load_id), "begun_at": F.current_timestamp()}, BEGUN, f"{fact_path}/{FOLDER}/begun/{load_id}")
    return load_id


def commit(
    spark: SparkSession, fact_path: str, appended: Appended, after: Row | None, load_ts: dt.datetime, version: str, base: str | None, id_buckets: int
) -> None:
    """Make the load visible; ``after`` is the entry that was the last when it began."""
    seq = after["seq"] + 1 if after else 1
    entry = {
        "seq": F.lit(seq),
        "load_id": F.lit(appended.append_id),
        "dw_loaded_at": F.lit(load_ts).cast("timestamp_ntz"),
        "committed_at": F.current_timestamp(),
        "rows": F.lit(appended.rows),
        "greatest_key": F.lit((after["greatest_key"] if after else 0) + appended.rows),
        "files": F.lit(appended.files),
        "bytes": F.lit(appended.bytes),
        "version": F.lit(version),
        "base": F.lit(base),
        "id_buckets": F.lit(id_buckets),
    }
    try:
        _add(spark, entry, COMMITTED, f"{fact_path}/{FOLDER}/committed/{seq:08d}")
    except AnalysisException as error:
        if error.getCondition() == "PATH_ALREADY_EXISTS":
            raise OverlappingLoad(f"load {seq} of {fact_path} was committed by another run") from error
        raise


def loads(spark: SparkSession, fact_path: str) -> DataFrame | None:
    """One row per committed load, or None where there never was one."""
    return read_if_there(spark, COMMITTED, f"{fact_path}/{FOLDER}/committed", recursiveFileLookup="true")


def last_load(spark: SparkSession, fact_path: str) -> Row | None:
    known = loads(spark, fact_path)
    return None if known is None else known.orderBy(F.desc("seq")).first()


def uncommitted(spark: SparkSession, fact_path: str) -> list[str] | None:
    """Ids of the loads that broke off or still run, one per such load; None where no load ever began."""
    begun = read_if_there(spark, BEGUN, f"{fact_path}/{FOLDER}/begun", recursiveFileLookup="true")
    if begun is None:
        return None
    known = loads(spark, fact_path)
    rest = begun if known is None else begun.join(known, "load_id", "left_anti")
    return sorted(row["load_id"] for row in rest.select("load_id").collect())
