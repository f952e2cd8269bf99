import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from cardflux import model
from cardflux.functions.calendar import iso_utc
from cardflux.operators.enrichment import enrich
from cardflux.operators.validation import enforce_schema, flag_rules, split_flagged
from cardflux.plans import jobs, panels
from cardflux.sources import landing, manifest, tables
from cardflux.sources.scratch import scratch_folder
from cardflux.streaming.flows import land_topic, validate_stream
from tests.conftest import LOAD, NOW, PLAIN, record, uuid


def test_landing_has_the_declared_schema(spark, raw, tmp_path):
    raw(record(), record(zip_code=None)).write.parquet(str(tmp_path / "in"))
    assert landing.read_landing(spark, str(tmp_path / "in"), "parquet").schema == model.RAW_SCHEMA


def test_json_lines_keep_what_does_not_parse(spark, tmp_path):
    (tmp_path / "e.json").write_text(json.dumps(PLAIN) + "\n{broken\n" + json.dumps({**PLAIN, "zip_code": None}) + "\n")
    parsed = landing.read_json_events(spark, str(tmp_path))
    assert parsed.where("_corrupt_record IS NULL").count() == 2
    assert [r["_corrupt_record"] for r in landing.dead_letters(parsed).collect()] == ["{broken"]


def test_topic_records_round_trip(spark, raw):
    events = raw(record(), record(is_international=None, amount_usd=0.1))
    records = landing.to_topic_records(events)
    assert records.columns == ["key", "value"]
    assert {r["key"] for r in records.collect()} == {"C-0042"}
    assert json.loads(records.first()["value"]) == PLAIN
    back = landing.parse_topic_values(records.select("value"))
    assert sorted(map(str, back.select(*events.columns).collect())) == sorted(map(str, events.collect()))
    assert landing.dead_letters(back).count() == 0
    broken = landing.parse_topic_values(records.select(F.substring("value", 1, 30).alias("value")))
    assert landing.dead_letters(broken).count() == 2


def test_iso_text(spark):
    row = spark.range(1).select(iso_utc(F.lit(dt.datetime(2025, 4, 12, 14, 30, 5)))).first()
    assert row[0] == "2025-04-12T14:30:05+00:00"


def test_quarantine_appends_by_day(spark, raw, tmp_path):
    bad = raw(record(amount_usd=-1.0), record(event_time="nope"), record(channel="fax", event_time="2025-02-13T00:00:00+00:00"))
    _, invalid = split_flagged(flag_rules(enforce_schema(bad), NOW))
    path = str(tmp_path / "q")
    assert tables.write_quarantine(invalid, path) == 3
    assert tables.write_quarantine(invalid.limit(0), path) == 0
    back = tables.read_quarantine(spark, path, invalid.schema)
    assert back.count() == 3
    assert {str(r[0]) for r in back.select("ingest_date").collect()} == {"2025-02-12", "2025-02-13", "None"}


def test_curated_round_trip_matches_names_in_any_case(spark, raw, tmp_path):
    enriched = enrich(enforce_schema(raw(record(), record(transaction_id=uuid(2)))))
    path = str(tmp_path / "c")
    assert tables.write_curated(enriched, path) == 2
    assert tables.read_curated(spark, path).columns == model.CURATED_COLUMNS
    assert sorted(tables.read_curated(spark, path).collect()) == sorted(enriched.collect())
    upper = str(tmp_path / "u")
    enriched.select(*[F.col(n).alias(n.upper()) for n in reversed(enriched.columns)]).write.parquet(upper)
    assert sorted(tables.read_curated(spark, upper).collect()) == sorted(enriched.collect())


def test_unreadable_files_end_the_read_or_are_reported(spark, raw, tmp_path):
    enrich(enforce_schema(raw(record()))).write.parquet(str(tmp_path / "s"))
    (tmp_path / "s" / "part-broken.parquet").write_bytes(b"not parquet at all")
    with pytest.raises(Exception, match="part-broken"):
        tables.read_stage(spark, str(tmp_path / "s")).count()
    assert tables.read_stage(spark, str(tmp_path / "s"), skip_unreadable=True).count() == 1
    stage, report = tables.keep_stage(spark, str(tmp_path / "s"), str(tmp_path / "kept"))
    assert stage.columns == model.STAGE_COLUMNS and stage.count() == 1
    states = {row["file"]: (row["state"], row["read_rows"], row["found_bytes"]) for row in report.collect()}
    assert states.pop("part-broken.parquet") == ("unreadable", 0, 18)
    assert [state[:2] for state in states.values()] == [("unrecorded", 1)]


def test_every_append_is_recorded_and_lost_rows_are_counted_per_file(spark, raw, tmp_path):
    """Files of one folder: whole, without an end, damaged in the middle, gone, and never recorded."""
    path = tmp_path / "c"
    for day in range(1, 5):
        # Two batches of rows of a reader, so that damage to the second one leaves the first.
        rows = enrich(enforce_schema(raw(record(event_time=f"2025-02-0{day}T08:00:00+00:00")))).withColumn("n", F.explode(F.sequence(F.lit(1), F.lit(9000))))
        numbered = rows.withColumns({"transaction_id": F.concat("transaction_id", F.lit("-"), F.sha2(F.col("n").cast("string"), 256))})
        assert tables.write_curated(numbered.coalesce(1).drop("n"), str(path)) == 9000
    assert tables.write_curated(numbered.limit(0).drop("n"), str(path)) == 0
    recorded = {row["file"]: (row["rows"], row["bytes"]) for row in manifest.recorded(spark, str(path)).collect()}
    files = {day: next(path.glob(f"append_id=*/ingest_date=2025-02-0{day}/*.parquet")) for day in range(1, 5)}
    assert recorded == {str(f.relative_to(path)): (9000, f.stat().st_size) for f in files.values()}
    assert tables.read_curated(spark, str(path)).count() == 36_000

    for file in path.glob("append_id=*/*/.*.crc"):
        file.unlink()
    data = files[2].read_bytes()
    files[2].write_bytes(data[: len(data) // 2])
    data = files[3].read_bytes()
    files[3].write_bytes(data[: len(data) // 2] + b"\0" * 2000 + data[len(data) // 2 + 2000 :])
    files[4].unlink()
    (path / "append_id=x" / "ingest_date=2025-02-07").mkdir(parents=True)
    (path / "append_id=x" / "ingest_date=2025-02-07" / "odd.parquet").write_bytes(b"odd")
    stage, report = tables.keep_stage(spark, str(path), str(tmp_path / "stage"))
    lines = {row["file"][-60:]: row for row in report.collect()}
    by_day = {day: lines[str(file)[-60:]] for day, file in files.items()}
    assert [by_day[day]["state"] for day in range(1, 5)] == ["whole", "damaged", "damaged", "missing"]
    assert [by_day[day]["lost_rows"] for day in (1, 2, 4)] == [0, 9000, 9000]
    assert 0 <= by_day[3]["read_rows"] < 9000 and by_day[3]["lost_rows"] == 9000 - by_day[3]["read_rows"]
    assert [row["state"] for row in report.where("file LIKE '%odd.parquet'").collect()] == ["unreadable"]
    assert stage.count() == 9000 + by_day[3]["read_rows"]


def test_an_append_whose_files_lack_rows_is_not_recorded(spark, raw, tmp_path, monkeypatch):
    monkeypatch.setattr(tables.manifest, "record", lambda *args: manifest.Appended("x", 0, 0, 0))
    with pytest.raises(OSError, match="1 rows were written"):
        tables.write_curated(enrich(enforce_schema(raw(record()))), str(tmp_path / "c"))


def test_a_mistyped_field_is_no_dead_letter(spark):
    records = spark.createDataFrame([('{"transaction_id":"t","amount_usd":"abc","is_international":"maybe"}',), ('{"amount_usd":1.5}',), ("{",)], "value string")
    parsed = landing.parse_topic_values(records).collect()
    assert [(row["amount_usd"], row["is_international"], row["_corrupt_record"]) for row in parsed] == [(None, None, None), (1.5, None, None), (None, None, "{")]


def test_curated_table(spark, raw):
    for _ in range(2):
        tables.create_curated_table(spark, "curated_t")
    tables.append_curated_table(enrich(enforce_schema(raw(record()))), "curated_t")
    tables.append_curated_table(enrich(enforce_schema(raw(record(transaction_id=uuid(2))))), "curated_t")
    stored = spark.table("curated_t")
    assert set(stored.columns) == set(model.CURATED_COLUMNS)
    assert stored.count() == 2
    assert stored.where(F.col("ingest_date") == dt.date(2025, 2, 12)).count() == 2
    spark.sql("DROP TABLE curated_t")


def test_batch_job(spark, raw, tmp_path):
    raw(record(), record(amount_usd=0.0), record(transaction_id=uuid(2))).write.parquet(str(tmp_path / "in"))
    paths = [str(tmp_path / name) for name in ("in", "curated", "quarantine")]
    counts = jobs.run_batch(spark, *paths, fmt="parquet", now=NOW)
    assert counts == {"total": 3, "passed": 2, "quarantined": 1, "written": 2}
    assert tables.read_stage(spark, paths[1]).count() == 2
    rejected = spark.read.json(paths[2]).first()
    assert rejected["_failed_checks"] == "_chk_amount_range" and rejected["_quarantine_ts"]
    assert not set(spark.read.json(paths[2]).columns) & {"is_valid", "_is_valid"}


def test_batch_job_reads_the_landing_files_once(spark, raw, tmp_path):
    """Neither the valid nor the rejected side leads back to them."""
    raw(record(), record(amount_usd=0.0)).write.parquet(str(tmp_path / "landing"))
    valid, _ = jobs.run_validation(landing.read_landing(spark, str(tmp_path / "landing"), "parquet"), str(tmp_path / "q"), NOW)
    assert all("landing" not in file for file in valid.inputFiles())
    assert valid.columns == split_flagged(flag_rules(enforce_schema(raw(record())), NOW))[0].columns


def test_a_batch_without_a_valid_row_raises_and_keeps_its_rejects(spark, raw, tmp_path):
    with pytest.raises(jobs.NothingValid):
        jobs.run_validation(raw(record(amount_usd=0.0)), str(tmp_path / "q"), NOW)
    assert spark.read.json(str(tmp_path / "q")).count() == 1


def test_clustered_fact_splits_a_hot_merchant(spark, tmp_path):
    fact = spark.range(4000).select(
        F.lit(1).alias("merchant_key"), F.col("id").cast("string").alias("transaction_id"), F.lit(dt.date(2025, 4, 1)).alias("ingest_date")
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        tables.write_fact(fact, str(tmp_path / "f"))
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(list((tmp_path / "f" / "ingest_date=2025-04-01").glob("*.parquet"))) > 1
    assert spark.read.parquet(str(tmp_path / "f")).count() == 4000


def test_scratch_is_below_the_shared_folder(spark):
    one, two = scratch_folder(spark, "x"), scratch_folder(spark, "x")
    assert one != two
    assert one.startswith(spark.conf.get("spark.checkpoint.dir"))


def test_stream_equals_batch(spark, raw, tmp_path):
    records = [record(transaction_id=uuid(n), amount_usd=float(n - 3), event_time=f"2025-04-{10 + n % 3}T0{n % 2}:00:00+00:00") for n in range(12)]
    batch = raw(*records)
    batch.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(model.RAW_SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    good, bad, state = (str(tmp_path / name) for name in ("good", "bad", "state"))
    for _ in range(2):  # the second run finds nothing new
        validate_stream(stream, good, bad, state, NOW, flush=None).awaitTermination()
    valid, invalid = split_flagged(flag_rules(enforce_schema(batch), NOW))
    ids = lambda df: sorted(r["transaction_id"] for r in df.select("transaction_id").collect())
    assert ids(spark.read.parquet(good)) == ids(valid)
    assert ids(spark.read.json(bad)) == ids(invalid)


def test_stream_landing(spark, raw, tmp_path):
    landing.to_topic_records(raw(record(), record(event_time="2025-02-12T15:00:00+00:00"), record(event_time="?"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, value string").parquet(str(tmp_path / "in"))
    out = str(tmp_path / "out")
    land_topic(stream, out, str(tmp_path / "state"), "parquet", None).awaitTermination()
    assert landing.read_landing(spark, out, "parquet").count() == 3
    assert (tmp_path / "out" / "event_date=2025-02-12" / "event_hour=15").is_dir()


def test_a_topic_delivered_twice_lands_once(spark, raw, tmp_path):
    """Over triggers and a restart; records that do not parse, and those alike in id alone, all land."""
    events = raw(*[record(transaction_id=uuid(n), event_time=f"2025-02-12T0{n % 2}:00:00+00:00") for n in range(10)], record(transaction_id=uuid(1), amount_usd=5.0))
    broken = spark.createDataFrame([("k", "{one"), ("k", "{two")], "key string, value string")
    records = landing.to_topic_records(events).unionByName(broken).coalesce(1)
    out = str(tmp_path / "out")
    for run in range(2):
        records.write.mode("append").parquet(str(tmp_path / "in"))
        records.write.mode("append").parquet(str(tmp_path / "in"))
        stream = spark.readStream.schema("key string, value string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        land_topic(stream, out, str(tmp_path / "state"), "parquet", None).awaitTermination()
        landed = landing.read_landing(spark, out, "parquet")
        assert landed.count() == 13
        assert landed.where(F.col("transaction_id") == uuid(1)).count() == 2
    folders = list((tmp_path / "out" / "event_date=2025-02-12").iterdir())
    assert len(folders) == 3 and all(len(list(folder.glob("*.parquet"))) == 1 for folder in folders)


def test_health_panel(spark, raw):
    events = raw(record(transaction_id=uuid(1)), record(transaction_id=uuid(2), channel="fax"), record(transaction_id=uuid(3), amount_usd=None),
                 record(transaction_id=uuid(4), event_time="?"))
    flagged = flag_rules(enforce_schema(events), NOW)
    fact = spark.createDataFrame(
        [(dt.datetime(2025, 2, 12, 15), dt.datetime(2025, 2, 12, 14, 59), dt.date(2025, 2, 12)),
         (dt.datetime(2025, 2, 12, 16), dt.datetime(2025, 2, 12, 15, 58), dt.date(2025, 2, 12)),
         (dt.datetime(2025, 2, 12, 16), dt.datetime(2025, 2, 12, 15, 58), dt.date(2025, 2, 12)),
         (dt.datetime(2025, 2, 13, 16), dt.datetime(2025, 2, 13, 1), dt.date(2025, 2, 13))],
        "dw_loaded_at timestamp_ntz, event_time timestamp_ntz, ingest_date date",
    )
    topic = spark.createDataFrame([("{", NOW.replace(year=2025, month=2, day=12)), ("{", NOW)], "value string, timestamp timestamp")
    health = panels.health_report(fact, flagged, landing.parse_topic_values(topic), dt.date(2025, 2, 12))
    assert health.first().asDict() == {
        "last_flush": dt.datetime(2025, 2, 12, 16), "records_last_batch": 2, "total_loaded_today": 3, "load_latency_s": 100.0,
        "quarantine_rate_pct": 75.0, "schema_violations_today": 4, "dlq_count_today": 1,
    }
    card = {r["check_name"]: r["status"] for r in panels.quality_scorecard(health).collect()}
    assert card == {"Failed rule checks": "OK", "Records that do not parse": "OK", "Share of rejected records in percent": "WARN"}
    quiet = panels.health_report(fact, flagged, landing.parse_topic_values(topic), dt.date(2030, 1, 1)).first()
    assert (quiet["total_loaded_today"], quiet["quarantine_rate_pct"], quiet["dlq_count_today"]) == (0, 0.0, 0)
