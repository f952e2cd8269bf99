import os
import re
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry_point

TABLES = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(TABLES), reason="test tables are not here")


def test_every_query_has_sql_unless_rows_only():
    # Only operators for text corpora, where they are present, go without.
    assert not {name for name in set(entry_point.queries()) - set(entry_point.oracle_sql()) if not re.match(r"op\d+_|pipeline$", name)}
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())


def test_entry(spark):
    result = entry_point.entry(spark)
    assert result.count() == 760
    assert "spend_velocity_24h" in result.columns


@pytest.mark.parametrize("name", ["velocity_with_history", "warehouse_load_twice", "customer_spend_profile"])
def test_sql_gives_the_same_rows(spark, name):
    connection = duckdb.connect()
    for file in Path(TABLES).glob("*.parquet"):
        connection.sql(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    got = entry_point.queries()[name](spark, TABLES)
    want = connection.sql(entry_point.oracle_sql()[name])
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    got_rows = sorted(map(repr, (tuple(row) for row in got.select(columns).collect())))
    assert got_rows == sorted(map(repr, want.select(*columns).fetchall()))
