"""Rolling per-customer features over event time.

For a row of customer c at second t (both frame ends included, rows of the same second see each
other):

* ``txn_count_last_1h``      transactions of c in [t-3600, t]
* ``distinct_merchants_1h``  different merchants of c in [t-3600, t]
* ``spend_velocity_24h``     amount spent by c in [t-86400, t]

A window over the raw rows would put a customer with much of the traffic into a single task and
re-read the frame for every row. All rows of one (customer, second) share their values, so the
features are computed on aggregates instead:

1. visits: transactions and spend per (customer, merchant, second), combined before the shuffle;
2. time is cut into blocks. A visit also enters the next block if it can still matter there, so
   blocks are independent. A task gets the visits of a customer in a block and its lookback, one
   row for all transactions of a merchant and second, and does the next three steps with them;
3. visits to a merchant without a gap of more than an hour form a stretch. A stretch adds one
   merchant from its first second until an hour after its last, so the stretches begun until now
   less those that ended before the hour are the exact distinct count, with no sets;
4. begun and ended stretches, transactions and spend per (customer, second), so running totals pass
   at most one row per second; no row is added for the end of a stretch;
5. running totals at t minus running totals just before the frame. Amounts are summed as decimals,
   which makes the difference exact and the outcome independent of task order.

The result goes back to the rows by (customer, second); adaptive execution splits a key that is
hot on the row side, and the feature side has one row for it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cardflux.model import DAY, HOUR, LIMITS, Limits

BLOCK = 7 * DAY
EXACT_MONEY = "decimal(28,10)"
ACTIVITY_COLUMNS = ["customer_id", "_second", "merchant_id", "transaction_id", "amount_usd"]
SKETCH_LOG_BUCKETS = 12


def add_velocity_features(
    batch: DataFrame, history: DataFrame | None = None, limits: Limits = LIMITS, approx: bool = False
) -> DataFrame:
    """Append the rolling features to validated rows.

    ``history`` holds earlier curated rows (not those of the batch) for lookbacks that reach over
    the batch start; without it the features see the batch alone. ``approx`` counts merchants with
    mergeable sketches, of a size that does not depend on their number, instead of exactly.
    """
    rows = batch.withColumn("_second", F.unix_timestamp("event_time_ts"))
    activity = rows.select(*ACTIVITY_COLUMNS)
    if history is not None:
        activity = activity.unionByName(recent_activity(history, batch))
    features = rolling_features(activity, approx)
    cross_merchant = F.col("distinct_merchants_1h") >= limits.cross_merchant_at_least
    return rows.join(features, ["customer_id", "_second"], "left").select(
        *batch.columns,
        "txn_count_last_1h",
        "distinct_merchants_1h",
        "spend_velocity_24h",
        cross_merchant.alias("cross_merchant_flag"),
    )


def recent_activity(history: DataFrame, batch: DataFrame) -> DataFrame:
    """What the batch can look back on: the last day before it, for the batch's customers only.

    The bounds come from one scalar subquery, so the day filter prunes the history's partitions.
    """
    earliest = F.min("event_time_ts") - F.expr("INTERVAL 1 DAY")
    bounds = batch.agg(F.struct(earliest.alias("day_before"), F.max("event_time_ts").alias("last"))).scalar()
    day_before, last = bounds.getField("day_before"), bounds.getField("last")
    in_reach = (
        (F.col("ingest_date") >= F.to_date(day_before))
        & (F.col("ingest_date") <= F.to_date(last))
        & (F.unix_timestamp("event_time_ts") >= F.unix_timestamp(day_before))
        & (F.col("event_time_ts") <= last)
    )
    return (
        history.where(in_reach)
        .withColumn("_second", F.unix_timestamp("event_time_ts"))
        .select(*ACTIVITY_COLUMNS)
        .join(batch.select("customer_id").distinct(), "customer_id", "left_semi")
    )


def rolling_features(activity: DataFrame, approx: bool = False) -> DataFrame:
    """One row per (customer, second) with the three features."""
    dated = activity.where(F.col("customer_id").isNotNull() & F.col("_second").isNotNull())
    txns = F.count("transaction_id").alias("_txns")
    spend = F.sum(F.col("amount_usd").cast(EXACT_MONEY)).alias("_spend")
    in_time = Window.partitionBy("customer_id", "_block").orderBy("_second")
    if approx:
        timeline = _reaching_blocks(dated.groupBy("customer_id", "_second").agg(txns, spend))
        merchants = F.lit(None).cast("long")
    else:
        visits = _reaching_blocks(dated.groupBy("customer_id", "_second", "merchant_id").agg(txns, spend))
        # Stretches, seconds and running totals of a block all stay where this puts them: one more shuffle instead of three.
        timeline = _stretches_in_time(visits.repartition("customer_id", "_block"))
        begun, ended_before = _running_totals("_opens", in_time)[0], _running_totals("_closes", in_time, HOUR)[1]
        merchants = begun - ended_before

    own_second = (F.col("_txns") > 0) & (_block_of(F.col("_second")) == F.col("_block"))
    features = (
        timeline.select(
            "customer_id",
            "_block",
            "_second",
            "_txns",
            _trailing_sum("_txns", in_time, HOUR).alias("txn_count_last_1h"),
            merchants.alias("distinct_merchants_1h"),
            _trailing_sum("_spend", in_time, DAY).cast("double").alias("spend_velocity_24h"),
        )
        .where(own_second)
        .drop("_block", "_txns")
    )
    if not approx:
        return features
    return features.drop("distinct_merchants_1h").join(_sketched_merchants(dated), ["customer_id", "_second"])


def _sketched_merchants(dated: DataFrame) -> DataFrame:
    """Per (customer, second) the merchants of the last hour, estimated from two running unions of sketches.

    Time is cut into panes as long as the frame. A frame then is the end of one pane and the beginning of the next: the
    sketches of a pane are united from its start up to each second, and from its end down to each second at which
    a frame begins. Both runs take every sketch once, so the cost is linear in the rows however many there are in an hour.
    """
    second, pane = F.col("_second"), F.lit(HOUR + 1)
    sketch = F.hll_sketch_agg("merchant_id", SKETCH_LOG_BUCKETS).alias("_sketch")
    seconds = dated.groupBy("customer_id", "_second").agg(sketch)
    here = F.floor(second / pane)
    own = F.struct(here.alias("_pane"), second.alias("_at"), F.col("_sketch"), F.lit(True).alias("_own"))
    begins = F.struct((here - 1).alias("_pane"), (second - HOUR).alias("_at"), F.lit(None).cast("binary").alias("_sketch"), F.lit(False).alias("_own"))
    points = seconds.select("customer_id", "_second", F.explode(F.array(own, begins)).alias("_point")).select("customer_id", "_second", "_point.*")
    in_pane = Window.partitionBy("customer_id", "_pane")
    until_now = in_pane.orderBy("_at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    from_now = in_pane.orderBy(F.desc("_at")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.when(F.col("_own"), F.hll_union_agg("_sketch").over(until_now)).otherwise(F.hll_union_agg("_sketch").over(from_now))
    both = points.select("customer_id", "_second", run.alias("_run")).groupBy("customer_id", "_second")
    return both.agg(F.hll_sketch_estimate(F.hll_union_agg("_run")).alias("distinct_merchants_1h"))


def _block_of(second: Column) -> Column:
    """First second of the block that a second lies in."""
    return second - F.pmod(second, F.lit(BLOCK))


def _reaching_blocks(df: DataFrame) -> DataFrame:
    """Repeat each row for every block in which the longest lookback can still reach it."""
    second = F.col("_second")
    return df.withColumn("_block", F.explode(F.sequence(_block_of(second), _block_of(second + DAY), F.lit(BLOCK).cast("long"))))


def _stretches_in_time(visits: DataFrame) -> DataFrame:
    """Per (customer, block, second): transactions, spend, and how many stretches of visits to a merchant begin and end.

    A visit without a merchant belongs to no stretch.
    """
    in_time = Window.partitionBy("customer_id", "merchant_id", "_block").orderBy("_second")
    second, named = F.col("_second"), F.col("merchant_id").isNotNull()
    neighbours = visits.withColumns({"_before": F.lag(second).over(in_time), "_after": F.lead(second).over(in_time)})
    opens = named & (F.col("_before").isNull() | (second - F.col("_before") > HOUR))
    closes = named & (F.col("_after").isNull() | (F.col("_after") - second > HOUR))
    return neighbours.groupBy("customer_id", "_block", "_second").agg(
        F.sum("_txns").alias("_txns"), F.sum("_spend").alias("_spend"), F.count_if(opens).alias("_opens"), F.count_if(closes).alias("_closes")
    )


def _running_totals(column: str, in_time, reach: int = 0) -> tuple[Column, Column]:
    """The sum until now, and that until before the frame [t-reach, t]."""
    until_now = F.sum(column).over(in_time.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    before_frame = F.sum(column).over(in_time.rangeBetween(Window.unboundedPreceding, -(reach + 1)))
    return until_now, F.coalesce(before_frame, F.lit(0))


def _trailing_sum(column: str, in_time, reach: int) -> Column:
    """Sum over [t-reach, t] as a difference of two running totals, linear in the rows."""
    until_now, before_frame = _running_totals(column, in_time, reach)
    return until_now - before_frame
