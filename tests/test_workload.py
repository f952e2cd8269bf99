import datetime as dt
import hashlib
import uuid

from pyspark.sql import functions as F

from cardflux.workload import fixtures as fx, queries

LINE = "l_orderkey long, l_linenumber int, l_suppkey long, l_extendedprice double, l_shipdate timestamp"
AT = dt.datetime(1996, 3, 4, tzinfo=dt.timezone.utc)


def test_order_lines_are_shuffled_for_their_orders_alone(spark, tmp_path):
    """Suppliers and customers small enough to broadcast cost the lines no shuffle; keys may repeat and be NULL."""
    tables = {
        "lineitem": ([(1, 1, 5, 10.0, AT), (1, 1, 5, 10.0, AT), (2, 1, 6, 20.0, AT), (3, 1, None, 1.0, AT), (None, 1, 5, 1.0, AT)], LINE),
        "orders": ([(1, 7), (2, 8), (2, 8), (3, 7), (4, None)], "o_orderkey long, o_custkey long"),
        "customer": ([(7, 1), (8, 2), (None, 1)], "c_custkey long, c_nationkey int"),
        "supplier": ([(5, "S5", 1), (6, "S6", 1), (None, "S", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU"), (2, "CHAD")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    raw = fx.lineitem_raw(spark, str(tmp_path))
    got = sorted((r["customer_id"], r["merchant_id"], r["city"], r["is_international"]) for r in raw.collect())
    assert got == [("CUST_7", "MER_5", "PERU", False)] * 2 + [("CUST_8", "MER_6", "PERU", True)] * 2
    # Between the size of a table here and that of the product of two, which is what Spark takes a join for.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "100000")
    try:
        plan = fx.lineitem_raw(spark, str(tmp_path))._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 3


def test_rejected_lines_are_not_stored(spark, tmp_path, monkeypatch):
    """Lines are judged on their way into the landing files, of which features and rows are then read."""
    tables = {
        "lineitem": ([(1, 1, 5, 10.0, AT), (1, 1, 5, 10.0, AT), (1, 2, 5, 50000.01, AT), (1, 3, 5, None, AT), (1, 4, 5, 10.0, None), (2, 1, 5, 20.0, AT)], LINE),
        "orders": ([(1, 7), (2, None)], "o_orderkey long, o_custkey long"),
        "customer": ([(7, 1)], "c_custkey long, c_nationkey int"),
        "supplier": ([(5, "S5", 1)], "s_suppkey long, s_name string, s_nationkey int"),
        "nation": ([(1, "PERU")], "n_nationkey int, n_name string"),
    }
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")
    monkeypatch.setattr(queries, "scratch_folder", lambda spark, purpose: f"{tmp_path}/{purpose}")
    valid = queries._lines_valid(spark, str(tmp_path))
    stored = spark.read.parquet(f"{tmp_path}/lines-landing")
    assert stored.count() == valid.count() == 2
    flagged = queries._flag(fx.lineitem_raw(spark, str(tmp_path)))
    expected = queries.split_flagged(flagged)[0]
    assert valid.columns == expected.columns and valid.collect() == expected.collect()


def test_ids_from_digests(spark):
    got = spark.createDataFrame([("1-1",), (None,)], "t string").select(fx.uuid_text(F.col("t")).alias("u")).collect()
    assert [row["u"] for row in got] == [str(uuid.UUID(hashlib.md5(b"1-1").hexdigest())), ""]

