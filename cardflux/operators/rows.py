"""One row per key, surrogate keys and key checks. Groups are reduced before they are shuffled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY_BUCKETS = 4096


def first_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The smallest row of each key by ``order``, further columns breaking ties.

    It is an aggregate of a struct, not a ranked window, so each task sends at most one row per
    key: many copies of one key never meet in one place.
    """
    return _pick(df, key, order, F.min)


def latest_per_key(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The greatest row of each key by ``order``, further columns breaking ties."""
    return _pick(df, key, order, F.max)


def _pick(df: DataFrame, key: str, order: list[str], extreme) -> DataFrame:
    others = [name for name in df.columns if name != key and name not in order]
    row = F.struct(*order, *others)
    return df.groupBy(key).agg(extreme(row).alias("_row")).select(key, "_row.*").select(*df.columns)


def assign_surrogate_keys(
    df: DataFrame,
    natural_key: str,
    surrogate_key: str,
    existing: DataFrame | None = None,
    after: int | None = None,
    buckets: int = KEY_BUCKETS,
) -> DataFrame:
    """Number the (distinct) natural keys densely, after the greatest key in ``existing`` or ``after`` a known one.

    Keys are hashed into buckets and ranked inside each; a bucket starts where the sizes of the
    earlier ones end. Only the ``buckets`` sizes pass through one task. The numbers depend on the set of
    keys alone, so a recomputed partition numbers its rows as before.
    """
    bucketed = df.withColumn("_bucket", F.pmod(F.xxhash64(natural_key), F.lit(buckets)).cast("int"))
    earlier = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        bucketed.groupBy("_bucket")
        .agg(F.count(F.lit(1)).alias("_size"))
        .select("_bucket", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    )
    rank = F.row_number().over(Window.partitionBy("_bucket").orderBy(natural_key))
    start = F.lit(after or 0) if existing is None else F.coalesce(existing.agg(F.max(surrogate_key)).scalar(), F.lit(0))
    return (
        bucketed.withColumn("_rank", rank)
        .join(F.broadcast(offsets), "_bucket")  # at most `buckets` rows
        .select((start + F.col("_offset") + F.col("_rank")).cast("long").alias(surrogate_key), *df.columns)
    )


def duplicated_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Key values that occur more than once, with their number of rows."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows with NULL per column that must not hold any."""
    counted = df.agg(*[F.count_if(F.col(name).isNull()).alias(name) for name in columns])
    return counted.unpivot([], columns, "column", "nulls")


def _held(df: DataFrame, columns: dict[str, list[str]], marks: dict[str, int]) -> DataFrame:
    """``name, value, rows, held``: the values of named columns, unfolded; several columns make one value."""

    def value(sources: list[str]):
        return F.col(sources[0]).cast("string") if len(sources) == 1 else F.to_json(F.struct(*sources))

    lines = F.array(*[F.struct(F.lit(name).alias("name"), value(sources).alias("value")) for name, sources in columns.items()])
    return df.select(F.explode(lines).alias("_line")).select("_line.*", *[F.lit(mark).cast("long").alias(name) for name, mark in marks.items()])


def column_checks(
    df: DataFrame, unique: list[list[str]] = (), required: list[str] = (), references: dict[str, DataFrame] | None = None
) -> DataFrame:
    """All declared checks of a table from one scan of it: per column its repeated values and their rows, its NULLs, and its orphans.

    Rows are unfolded into (column, value) and counted, in the map tasks first, so a hot value is one line per task. The
    values of a referenced table are lines of their own that mark a value as held. A check that was not asked for is NULL.
    """
    references = references or {}
    columns = {",".join(keys): list(keys) for keys in [*unique, *[[name] for name in [*required, *references]]]}
    lines = _held(df, columns, {"rows": 1, "held": 0})
    for name, dimension in references.items():
        lines = lines.unionByName(_held(dimension, {name: [name]}, {"rows": 0, "held": 1}))
    values = lines.groupBy("name", "value").agg(F.sum("rows").alias("rows"), F.max("held").alias("held"))
    there = F.col("value").isNotNull()
    found = {
        "repeated_values": (F.count_if(there & (F.col("rows") > 1)), [",".join(keys) for keys in unique]),
        "nulls": (F.coalesce(F.sum(F.when(~there, F.col("rows"))), F.lit(0)), list(required)),
        "orphan_keys": (F.count_if(there & (F.col("rows") > 0) & (F.col("held") == 0)), list(references)),
        "orphan_rows": (F.coalesce(F.sum(F.when(there & (F.col("held") == 0), F.col("rows"))), F.lit(0)), list(references)),
    }
    checked = values.groupBy(F.col("name").alias("column")).agg(*[measure.alias(name) for name, (measure, _) in found.items()])
    asked = {name: F.when(F.col("column").isin(list(of)), F.col(name)) if of else F.lit(None).cast("long") for name, (_, of) in found.items()}
    # A table without rows has no lines; its columns are still reported.
    named = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(name) for name in columns])).alias("column"))
    return named.join(checked, "column", "left").na.fill(0, list(found)).withColumns(asked)


def orphan_counts(fact: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """Per foreign key: the values without a dimension row, and the fact rows that hold them, from one scan of the fact."""
    checked = column_checks(fact, references=references)
    found = checked.select(F.col("column").alias("foreign_key"), "orphan_keys", "orphan_rows")
    return found.orderBy(F.array_position(F.array(*[F.lit(name) for name in references]), F.col("foreign_key")))
