"""Loads through the ledger: what breaks off does not count, and what is known is found without reading the fact."""

import datetime as dt
import shutil

import pytest
from pyspark.sql import functions as F
from pyspark.sql.readwriter import DataFrameWriter

from cardflux.operators import dimensions as dims
from cardflux.operators import rows
from cardflux.operators import star as ops
from cardflux.operators.enrichment import enrich
from cardflux.operators.validation import enforce_schema
from cardflux.plans import jobs
from cardflux.sources import ids, ledger, tables
from tests.conftest import LOAD, record, uuid

DATES = (dt.date(2025, 4, 1), dt.date(2025, 4, 30))
LATER = dt.datetime(2025, 5, 2, tzinfo=dt.timezone.utc)


@pytest.fixture
def batch(raw):
    def build(numbers, **changes):
        events = [record(transaction_id=uuid(n), event_time=f"2025-04-{1 + n % 5:02d}T12:00:00+00:00", merchant_id=f"M{n % 3}", **changes) for n in numbers]
        return enrich(enforce_schema(raw(*events)))

    return build


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


class Broken(RuntimeError):
    pass


def break_at(monkeypatch, number, after):
    """Let the ``number``th table write of the process fail, before or after it is done."""
    counted = iter(range(1, 10**6))
    for name in ("parquet", "insertInto"):
        real = getattr(DataFrameWriter, name)

        def write(self, *args, real=real, **options):
            now = next(counted) == number
            if now and not after:
                raise Broken
            real(self, *args, **options)
            if now:
                raise Broken

        monkeypatch.setattr(DataFrameWriter, name, write)
    return counted


def test_a_crash_between_any_two_writes_and_a_second_run_equal_one_load(spark, batch, tmp_path, monkeypatch):
    batch(range(14)).write.parquet(str(tmp_path / "curated"))
    events = spark.read.parquet(str(tmp_path / "curated"))
    number = F.conv(F.substring("transaction_id", -2, 2), 16, 10).cast("int")
    first, second = events.where(number < 8), events.where(number >= 5)
    jobs.load_warehouse(spark, first, str(tmp_path / "first"), str(tmp_path / "v1"), None, LOAD, first_date=DATES[0], last_date=DATES[1], id_buckets=2)

    def load(root):
        if not (tmp_path / root).exists():
            shutil.copytree(tmp_path / "first", tmp_path / root / "fact")
        return jobs.load_warehouse(spark, second, str(tmp_path / root / "fact"), str(tmp_path / root / "v2"), None, LATER, first_date=DATES[0], last_date=DATES[1])

    with monkeypatch.context() as patch:
        counted = break_at(patch, 0, False)
        want = sorted(load("whole").fact.collect())
        writes = next(counted) - 1
    assert writes >= 9 and len(want) == 14
    # Before the first write and after each one; the last one is the commit.
    for number, after in [(1, False), *[(n, True) for n in range(1, writes + 1)]]:
        root = f"{number}-{after}"
        with monkeypatch.context() as patch:
            break_at(patch, number, after)
            with pytest.raises(Broken):
                load(root)
        if number < writes:
            assert tables.read_fact(spark, str(tmp_path / root / "fact")).count() == 8
        assert sorted(load(root).fact.collect()) == want, (number, after)


def test_a_first_load_that_broke_off_leaves_no_fact(spark, batch, tmp_path, monkeypatch):
    path = str(tmp_path / "fact")
    assert tables.read_fact(spark, path) is None
    with monkeypatch.context() as patch, pytest.raises(Broken):
        patch.setattr(ledger, "commit", lambda *args: (_ for _ in ()).throw(Broken()))
        jobs.load_warehouse(spark, batch(range(6)), path, str(tmp_path / "v1"), None, LOAD)
    assert tables.read_fact(spark, path) is None and len(ledger.uncommitted(spark, path)) == 1
    assert jobs.load_warehouse(spark, batch(range(6)), path, str(tmp_path / "v1"), None, LOAD).fact.count() == 6


def test_of_two_loads_at_a_time_the_second_fails(spark, batch, tmp_path, monkeypatch):
    path, real = str(tmp_path / "fact"), ledger.begin

    def begin_twice(session, fact_path):
        load_id = real(session, fact_path)
        monkeypatch.setattr(ledger, "begin", real)
        jobs.load_warehouse(session, batch(range(4)), fact_path, str(tmp_path / "w"), None, LOAD)
        return load_id

    monkeypatch.setattr(ledger, "begin", begin_twice)
    with pytest.raises(ledger.OverlappingLoad):
        jobs.load_warehouse(spark, batch(range(4)), path, str(tmp_path / "v"), None, LOAD)
    assert tables.read_fact(spark, path).count() == 4


def test_loads_go_on_from_the_ledger(spark, batch, tmp_path):
    path = str(tmp_path / "fact")
    jobs.load_warehouse(spark, batch(range(10)), path, str(tmp_path / "v1"), None, LOAD, id_buckets=3)
    star = jobs.load_warehouse(spark, batch(range(20)), path, str(tmp_path / "v2"), None, LATER, id_buckets=7)
    log = [row.asDict() for row in star.loads.orderBy("seq").collect()]
    assert [(r["seq"], r["rows"], r["greatest_key"], r["id_buckets"]) for r in log] == [(1, 10, 10, 3), (2, 10, 20, 3)]
    assert [(r["version"], r["base"]) for r in log] == [(str(tmp_path / "v1"), None), (str(tmp_path / "v2"), str(tmp_path / "v1"))]
    assert all(r["files"] > 0 and r["bytes"] > 0 for r in log)
    assert star.fact.agg(F.max("transaction_sk"), F.count_distinct("transaction_sk")).first() == (20, 20)
    # Dimension keys go on from the last committed version.
    old = {r["merchant_id"]: r["merchant_key"] for r in spark.read.parquet(str(tmp_path / "v1/dim_merchant")).collect()}
    assert {r["merchant_id"]: r["merchant_key"] for r in star.merchants.collect()} == old


def test_known_ids_are_found_without_a_shuffle_of_the_index(spark, batch, tmp_path):
    path = str(tmp_path / "fact")
    jobs.load_warehouse(spark, batch(range(10)), path, str(tmp_path / "v1"), None, LOAD, id_buckets=5)
    index = ids.indexed_ids(spark, path, 5, [])
    new = ops.not_indexed(ops.distinct_transactions(tables.to_stage(batch(range(6, 15)))), index, 5)
    new.collect()
    # The join's children: the batch's lines start with ":", the index's lines follow "+-" at the same depth.
    lines = plan(new).split("== Initial Plan ==")[0].splitlines()
    join = next(i for i, line in enumerate(lines) if "SortMergeJoin" in line)
    depth = len(lines[join]) - len(lines[join].lstrip(" :+-*"))
    right = next(i for i, line in enumerate(lines) if i > join and line.lstrip(" ").startswith("+-") and line.index("+-") <= depth)
    side = "\n".join(lines[right:])
    assert "cardflux_ids" in side and "Bucketed: true" in side and "Exchange" not in side and "ShuffleQueryStage" not in side
    assert sorted(row["transaction_id"] for row in new.collect()) == [uuid(n) for n in range(10, 15)]


def test_a_load_reads_neither_the_fact_nor_its_keys(spark, batch, tmp_path, monkeypatch):
    """With the files of the first load gone, a second one still numbers and skips right."""
    path = str(tmp_path / "fact")
    jobs.load_warehouse(spark, batch(range(10)), path, str(tmp_path / "v1"), None, LOAD, id_buckets=2)
    for file in (tmp_path / "fact").glob("load_id=*/*/*.parquet"):
        file.unlink()
    star = jobs.load_warehouse(spark, batch(range(12)), path, str(tmp_path / "v2"), None, LATER)
    assert sorted(row["transaction_sk"] for row in star.fact.collect()) == [11, 12]


@pytest.mark.parametrize("same_days_only", [False, True])
def test_same_days_only_reads_the_ids_of_the_batch_days(spark, batch, tmp_path, same_days_only):
    path = str(tmp_path / "fact")
    jobs.load_warehouse(spark, batch(range(10)), path, str(tmp_path / "v1"), None, LOAD)
    star = jobs.load_warehouse(spark, batch(range(3, 15)), path, str(tmp_path / "v2"), None, LATER, same_days_only=same_days_only)
    assert star.fact.count() == 15


def test_damaged_input_is_loaded_as_far_as_it_goes_and_reported(spark, batch, tmp_path):
    curated = tmp_path / "curated"
    tables.write_curated(batch(range(20)), str(curated))
    lost = next(curated.glob("append_id=*/ingest_date=2025-04-03/*.parquet"))
    lost.write_bytes(lost.read_bytes()[:50])
    for file in curated.glob("append_id=*/*/.*.crc"):
        file.unlink()
    with pytest.raises(Exception, match="parquet"):
        jobs.load_warehouse(spark, str(curated), str(tmp_path / "f"), str(tmp_path / "v"), None, LOAD)
    star = jobs.load_warehouse(spark, str(curated), str(tmp_path / "f"), str(tmp_path / "v"), None, LOAD, skip_unreadable=True)
    assert star.fact.count() == 16
    assert [(row["state"], row["promised_rows"], row["lost_rows"]) for row in star.skipped.collect()] == [("damaged", 4, 4)]


def test_one_scan_of_the_stage_per_dimension(spark, batch, tmp_path):
    tables.write_curated(batch(range(9)), str(tmp_path / "c"))
    stage = tables.read_stage(spark, str(tmp_path / "c"))
    current = dims.upsert_dim_merchant(None, stage, LOAD)
    merged = dims.upsert_dim_merchant(current, stage, LATER)
    # What is left to run reads only what the merge stored.
    assert merged.inputFiles() and all("merged-merchant_key" in file for file in merged.inputFiles())


def test_a_merge_tells_new_updated_and_kept_rows_apart(spark, batch):
    stage = tables.to_stage(batch(range(6)))
    old = dims.upsert_dim_merchant(None, stage.where("merchant_id <> 'M2'"), LOAD)
    changed = stage.where("merchant_id <> 'M0'").withColumn("merchant_name", F.lit("Renamed"))
    rows_by_id = {r["merchant_id"]: r for r in dims.upsert_dim_merchant(old, changed, LATER).collect()}
    keys = {r["merchant_id"]: r["merchant_key"] for r in old.collect()}
    at = lambda moment: moment.replace(tzinfo=None)
    names = {key: row["merchant_name"] for key, row in rows_by_id.items()}
    assert names == {"M0": "Harbour Bakery", "M1": "Renamed", "M2": "Renamed"}
    assert (rows_by_id["M0"]["merchant_key"], rows_by_id["M1"]["merchant_key"], rows_by_id["M2"]["merchant_key"]) == (keys["M0"], keys["M1"], 3)
    assert [rows_by_id[m]["dw_created_at"] for m in ("M0", "M1", "M2")] == [at(LOAD), at(LOAD), at(LATER)]
    assert [rows_by_id[m]["dw_updated_at"] for m in ("M0", "M1", "M2")] == [at(LOAD), at(LATER), at(LATER)]


def test_all_checks_of_a_table_take_one_scan(spark, tmp_path):
    table = [(1, 10, "a"), (1, 11, None), (2, 10, "b"), (3, None, "b"), (None, 12, "c")]
    spark.createDataFrame(table, "id int, ref int, tag string").write.parquet(str(tmp_path / "t"))
    held = spark.createDataFrame([(10,), (13,)], "ref int")
    frame = spark.read.parquet(str(tmp_path / "t"))
    checked = rows.column_checks(frame, [["id"], ["id", "ref"]], ["id", "tag"], {"ref": held})
    got = {row["column"]: tuple(row)[1:] for row in checked.collect()}
    assert got == {"id": (1, 1, None, None), "id,ref": (0, None, None, None), "tag": (None, 1, None, None), "ref": (None, None, 2, 2)}
    assert plan(checked).split("== Initial Plan ==")[-1].count("Scan parquet") == 1
    empty = {row["column"]: tuple(row)[1:] for row in rows.column_checks(frame.limit(0), [["id"]], ["tag"], {"ref": held}).collect()}
    assert empty == {"id": (0, None, None, None), "tag": (None, 0, None, None), "ref": (None, None, 0, 0)}
