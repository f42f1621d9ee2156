"""Sources, sinks, gates and the daily job."""

from __future__ import annotations

import datetime as dt
import json
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadbook.contract import SILVER
from roadbook.operators import health, quality, serving
from roadbook.plans import daily
from roadbook.functions.clock import length_seconds
from roadbook.sinks import compact, tables
from roadbook.sinks.alerts import alert_messages, publish_alerts, with_defaults
from roadbook.sources import expenses as source
from roadbook.sources.telemetry import numbered, on_day, silver_table

DAY = dt.date(2026, 9, 27)
HEADER = "vehicle_id,fuel_cost,maintenance_cost,distance_covered,service_flag"


def expense_folder(tmp_path, text, name="expenses_20260927.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_columns_are_taken_by_name_and_bad_cells_become_zero(spark, tmp_path):
    text = "fuel_cost,note,vehicle_id,service_flag,distance_covered,maintenance_cost\n4200.50,x, V001 ,TRUE,180.4,1500\nabc,,V002,,,\n"
    got = {r.vehicle_id: r for r in source.expenses(spark, expense_folder(tmp_path, text), DAY).collect()}
    assert (float(got["V001"].fuel_cost), float(got["V001"].maintenance_cost), got["V001"].service_flag) == (4200.5, 1500.0, True)
    assert (float(got["V002"].fuel_cost), got["V002"].distance_covered, got["V002"].service_flag) == (0.0, 0.0, False)
    assert got["V001"].report_date == DAY


def test_real_file_is_preferred_to_example(spark, tmp_path):
    expense_folder(tmp_path, f"{HEADER}\nEX,1,1,1,no\n", "expenses_20260927.csv.example")
    assert source.expenses(spark, str(tmp_path), DAY).first().vehicle_id == "EX"
    expense_folder(tmp_path, f"{HEADER}\nREAL,1,1,1,no\n")
    assert source.expenses(spark, str(tmp_path), DAY).first().vehicle_id == "REAL"


def test_expense_gates(spark, tmp_path):
    with pytest.raises(FileNotFoundError, match="2026-09-27"):
        source.expenses(spark, str(tmp_path), DAY)
    with pytest.raises(ValueError, match="fuel_cost"):
        source.expenses(spark, expense_folder(tmp_path, "vehicle_id,maintenance_cost,distance_covered,service_flag\nV,1,1,no\n"), DAY)
    with pytest.raises(ValueError, match="follows the header"):
        source.expenses(spark, expense_folder(tmp_path, f"{HEADER}\n"), DAY)
    with pytest.raises(ValueError, match="names no column"):
        source.expenses(spark, expense_folder(tmp_path, ""), DAY)


def test_history_takes_the_date_from_the_file_name(spark, tmp_path):
    expense_folder(tmp_path, f"{HEADER}\nV1,1,1,1,no\n")
    expense_folder(tmp_path, "note,service_flag,distance_covered,maintenance_cost,fuel_cost,vehicle_id\n,no,1,1,2,V1\n", "expenses_20260928.csv")
    expense_folder(tmp_path, f"{HEADER}\nV1,3,1,1,no\n", "expenses_20260929.csv.example")
    got = {(str(r.report_date), float(r.fuel_cost)) for r in source.expense_history(spark, str(tmp_path)).collect()}
    assert got == {("2026-09-27", 1.0), ("2026-09-28", 2.0), ("2026-09-29", 3.0)}


def test_run_options_override_the_scheduled_date():
    assert source.business_date(DAY) == DAY
    assert source.business_date(DAY, {"report_date": "2026-09-29"}) == dt.date(2026, 9, 29)


def silver(spark):
    rows = [
        ("T1", "V001", 100.0, dt.datetime(2026, 9, 27, 8)),
        ("T1", "V001", 300.0, dt.datetime(2026, 9, 27, 9)),
        ("T2", "V001", 50.0, dt.datetime(2026, 9, 28, 0)),
        ("T3", "V009", 10.0, dt.datetime(2026, 9, 27, 23, 59, 59)),
    ]
    return spark.createDataFrame(rows, "trip_id string, vehicle_id string, fare double, event_ts timestamp")


def test_daily_job_is_repeatable_and_leaves_other_dates(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    expense_folder(root, f"{HEADER}\nV001,100.25,50,10,yes\nV002,5,0,1,no\n")
    expense_folder(root, f"{HEADER}\nV001,1,0,1,no\n", "expenses_20260928.csv")
    for day in (DAY, DAY, dt.date(2026, 9, 28)):
        daily.run_day(spark, silver(spark), str(root), out, day)
    table = spark.read.parquet(out)
    assert {r.report_date: r.row_count for r in quality.rows_per_date(table).collect()} == {DAY: 2, dt.date(2026, 9, 28): 1}
    row = serving.vehicle_profit_on(table, "V001", DAY).first()
    assert (row.trip_count, float(row.earnings), float(row.profit), row.unprofitable) == (1, 300.0, 149.75, False)
    assert float(serving.vehicle_profit_latest(table, "V001").first().profit) == 49.0
    assert [r.vehicle_id for r in serving.profit_by_date(table, DAY).collect()] == ["V001", "V002"]
    assert [r.vehicle_id for r in serving.profit_latest(table).collect()] == ["V001"]
    assert serving.vehicle_profit_latest(table, "V404").isEmpty()
    expense_folder(root, f"{HEADER}\nV001,1,0,1,no\n")
    daily.run_day(spark, silver(spark), str(root), out, DAY)
    assert spark.read.parquet(out).count() == 2


def test_duplicate_expense_rows_fail_or_add_up(spark, tmp_path):
    root = expense_folder(tmp_path, f"{HEADER}\nV001,1,2,3,no\nV001,10,20,30,yes\n")
    costs = source.expenses(spark, root, DAY)
    with pytest.raises(PySparkException, match="duplicate expense rows for vehicle V001"):
        daily.profitability_of(silver(spark), costs, DAY).collect()
    row = daily.profitability_of(silver(spark), costs, DAY, "sum").first()
    assert (float(row.fuel_cost), float(row.maintenance_cost), row.service_flag) == (11.0, 22.0, True)


def test_empty_output_is_refused(spark, tmp_path):
    table = spark.createDataFrame([(DAY,)], "report_date date")
    quality.require_rows(table, DAY)
    with pytest.raises(ValueError, match="2026-09-28"):
        quality.require_rows(table, dt.date(2026, 9, 28))


def test_rules_gate_the_daily_job(spark, tmp_path):
    good = silver(spark).withColumn("fare", F.lit(1.0))
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    expense_folder(root, f"{HEADER}\nV001,-5,50,10,yes\n")
    with pytest.raises(ValueError, match="fuel_cost >= 0"):
        daily.run_day(spark, good, str(root), out, DAY)
    assert not (tmp_path / "out").exists()


def test_jdbc_reads_are_bounded(spark):
    with pytest.raises(ValueError, match="numPartitions"):
        silver_table(spark, url="jdbc:none", dbtable="t")
    with pytest.raises(ValueError, match="numPartitions"):
        silver_table(spark, report_date=DAY, url="jdbc:none", dbtable="t", partitionColumn="id")
    times = [dt.datetime(2026, 9, 27), dt.datetime(2026, 9, 27, 23, 59, 59, 999999), dt.datetime(2026, 9, 28), None]
    frame = spark.createDataFrame([(t,) for t in times], "event_ts timestamp")
    assert frame.where(on_day("event_ts", DAY)).count() == 2


def test_one_wrong_time_does_not_enlarge_the_health_grid(spark):
    schema = "vehicle_id string, driver_id string, status string, lat double, lon double, speed double, fare double, event_ts timestamp"
    times = [dt.datetime(2024, 1, 1, 5), dt.datetime(2024, 1, 2, 5), dt.datetime(9999, 1, 1), None]
    feed = spark.createDataFrame([("V", "D", "idle", 1.0, 1.0, 0.0, 0.0, t) for t in times], schema)
    grid = health.batch_health(feed, 3600, 3)
    assert grid.count() == 48 and grid.agg(F.sum("raw_rows")).first()[0] == 2
    assert health.outside(feed).count() == 2
    assert health.outside_counts(feed).first().asDict() == {"raw_rows": 4, "undated_rows": 1, "early_rows": 0, "late_rows": 1}
    later = feed.withColumn("event_ts", F.expr("event_ts + INTERVAL 3 MONTHS")).where("event_ts < '9000-01-01'")
    assert health.batch_health(later, 3600, 3).agg(F.sum("raw_rows"), F.min("interval_id") * 3600).first()[:] == (2, 1711929600)
    assert health.batch_health(feed.where("event_ts IS NULL"), 3600, 3).count() == 0


def test_date_filter_reaches_the_scan(spark, tmp_path):
    path = str(tmp_path / "silver")
    events = silver(spark).withColumns({"lat": F.lit(1.0), "status": F.lit("idle")})
    tables.append_silver(events, path, 0)
    from roadbook.operators import earnings

    plan = earnings.daily_earnings(earnings.on_business_date(spark.read.parquet(path), DAY))
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(event_date" in text
    assert "GreaterThanOrEqual(event_ts" in text
    assert "lat" not in text.split("ReadSchema")[1]


def test_upsert_and_version_reading(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    path = str(tmp_path / "t")
    assert tables.read_version(spark, path, schema).isEmpty()
    tables.replace_version(spark.createDataFrame([("a", 1), ("b", 1)], schema), path, 0)
    for _ in range(2):
        before = tables.read_version(spark, path, schema, before=(tables.FIRST_RUN, 1))
        tables.replace_version(tables.upsert(before, spark.createDataFrame([("b", 2), ("c", 2)], schema), ["k"]), path, 1)
    assert {tuple(r) for r in tables.read_version(spark, path, schema).collect()} == {("a", 1), ("b", 2), ("c", 2)}
    tables.replace_version(spark.createDataFrame([], schema), path, 2)
    assert tables.read_version(spark, path, schema).count() == 3
    reader = tables.read_version(spark, path, schema)
    for version in range(3, 24):
        tables.replace_version(spark.createDataFrame([("z", version)], schema), path, version)
    assert reader.count() == 3  # a reader of long ago still has its version
    assert [tuple(r) for r in tables.read_version(spark, path, schema).collect()] == [("z", 23)]
    tables.replace_version(spark.createDataFrame([("new", 0)], schema), path, 0, run="r1")
    assert [tuple(r) for r in tables.read_version(spark, path, schema).collect()] == [("new", 0)]
    tables.replace_version(spark.createDataFrame([("new", 1)], schema), path, 1, run="r1", keep_seconds=-1.0)
    assert [p.name for p in (tmp_path / "t").iterdir() if p.is_dir()] == ["v-r1-000000000000001"]


def test_a_batch_writes_only_the_buckets_of_its_keys(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
    path = str(tmp_path / "t")

    def batch(number, rows, run=tables.FIRST_RUN):
        new = spark.createDataFrame(rows, schema)
        touched = tables.touched_buckets(new, "k")
        before = tables.read_buckets(spark, path, schema, (run, number), touched)
        tables.replace_buckets(tables.upsert(before, new, ["k"]), path, "k", number, run)
        return touched

    def table():
        return {r.k: r.v for r in tables.read_buckets(spark, path, schema).collect()}

    assert table() == {} and tables.read_buckets(spark, path, schema).schema == schema
    every = [(f"k{i}", 0) for i in range(500)]
    assert len(batch(0, every)) == tables.BUCKETS
    for _ in range(2):  # a batch that is replayed changes nothing more
        touched = batch(1, [("k7", 1), ("k8", 1)])
        assert len(touched) == 2 and table() == {**dict(every), "k7": 1, "k8": 1}
    written = {p.parent.parent.parent.name for p in (tmp_path / "t").glob("bucket=*/run=*/batch_id=1/*.parquet")}
    assert written == {f"bucket={b}" for b in touched}
    batch(2, [("new", 2), ("k7", 2)])
    batch(0, [("k9", 5)], run="r1")
    assert table() == {**dict(every), "k7": 2, "k8": 1, "new": 2, "k9": 5}
    old = tables.read_buckets(spark, path, schema)
    tables.replace_buckets(old.where("k = 'k9'"), path, "k", 1, "r1", keep_seconds=-1.0)
    assert not list((tmp_path / "t").glob(f"bucket={touched[0]}/run=*/batch_id=0/*.parquet"))
    assert table()["k7"] == 2


def test_batch_log_replay_and_current_view(spark, tmp_path):
    path = str(tmp_path / "log")
    for batch_id, rows in ((0, [("a", 1), ("b", 1)]), (1, [("a", 2)]), (1, [("a", 3)])):
        tables.append_batch(spark.createDataFrame(rows, "k string, v long"), path, batch_id)
    assert {tuple(r) for r in tables.current(spark.read.parquet(path), ["k"]).collect()} == {("a", 3), ("b", 1)}


def test_finalise_rounds_fills_nulls_and_refuses_misfits(spark):
    schema = T.StructType(
        [T.StructField("n", T.IntegerType(), False), T.StructField("r", T.DecimalType(8, 4), False), T.StructField("s", T.DecimalType(8, 2))]
    )
    kinds = "n long, r double, s double"
    frame = spark.createDataFrame([(None, 1 / 3, 2.345), (4, None, None)], kinds)
    got = [tuple(None if v is None else float(v) for v in r) for r in tables.finalise(frame, schema).collect()]
    assert got == [(0.0, 0.3333, 2.35), (4.0, 0.0, None)]
    for row in ((2**40, 0.0, 0.0), (1, float("nan"), 0.0), (1, 0.0, 1e30)):
        with pytest.raises(PySparkException, match="does not fit"):
            tables.finalise(spark.createDataFrame([row], kinds), schema).collect()


def test_alert_messages(spark, tmp_path):
    schema = "alert_type string, vehicle_id string, driver_id string, zone_id string, idle_minutes decimal(10,2), severity string, message string, created_at timestamp"
    rows = [("NO_DATA", None, None, None, None, None, "m", dt.datetime(2024, 1, 1)), ("IDLE_VEHICLE", "V1", "D", "Z00", None, "WARNING", "m", None)]
    alerts = with_defaults(spark.createDataFrame(rows, schema))
    got = {r.key: json.loads(r.value) for r in alert_messages(alerts).collect()}
    assert set(got) == {"pipeline", "V1"}
    assert got["pipeline"]["severity"] == "WARNING"
    assert got["pipeline"]["created_at"] == "2024-01-01T00:00:00.000000+00:00"
    assert got["V1"]["created_at"] is not None
    publish_alerts(alerts, "json", path=str(tmp_path / "topic"))
    assert spark.read.json(str(tmp_path / "topic")).count() == 2


def test_feed_health_from_the_batch_log(spark):
    start = dt.datetime(2024, 1, 1)
    rows = [(5, 4, start, start, 0), (3, 0, None, start + dt.timedelta(seconds=10), 1)]
    log = spark.createDataFrame(rows, "raw_rows long, valid_rows long, last_event_ts timestamp, processed_at timestamp, batch_id long")
    view = health.health_of_log(log, 10, 3, start + dt.timedelta(seconds=45))
    got = [(r.status, r.empty_streak) for r in view.orderBy("interval_id").collect()]
    assert got == [("HEALTHY", 0), ("PARSE_EMPTY", 0), ("WAITING", 1), ("WAITING", 2), ("NO_DATA", 3)]
    assert health.health_now(view).first().status == "NO_DATA"
    assert health.no_data_alerts(view, 3).first().message == "no telemetry for 3 consecutive batches"
    nothing = health.health_now(view.limit(0)).first()
    assert (nothing.status, nothing.message) == ("STARTING", "waiting for first streaming batch")


def test_daily_job_from_the_command_line(spark, tmp_path, capsys):
    root, table, out = tmp_path / "in", str(tmp_path / "silver"), str(tmp_path / "out")
    root.mkdir()
    expense_folder(root, f"{HEADER}\nV001,100.25,50,10,yes\n")
    columns = {c: F.lit(None).cast("string") for c in ("driver_id", "status", "zone_id", "time_of_day")}
    columns |= {c: F.lit(0.0) for c in ("lat", "lon", "speed")}
    tables.append_silver(silver(spark).withColumns(columns), table, 0)
    args = ["--silver", table, "--expenses", str(root), "--output", out, "--report-date", "2026-09-27"]
    daily.main(args)
    assert "V001" in capsys.readouterr().out
    assert float(spark.read.parquet(out).first().profit) == 149.75


def stored_silver(spark):
    columns = {c: F.lit(None).cast("string") for c in ("driver_id", "status", "zone_id", "time_of_day")}
    columns |= {c: F.lit(0.0) for c in ("lat", "lon", "speed")} | {"event_id": F.lit(1).cast("bigint")}
    return silver(spark).withColumns(columns)


def test_daily_job_is_the_same_before_between_and_after_merges(spark, tmp_path):
    root, table = tmp_path / "in", str(tmp_path / "silver")
    root.mkdir()
    expense_folder(root, f"{HEADER}\nV001,100.25,50,10,yes\nV009,1,0,1,no\n")
    expense_folder(root, f"{HEADER}\nV001,1,0,1,no\n", "expenses_20260928.csv")
    events = stored_silver(spark)
    first, later = events.where("fare < 200"), events.where("fare >= 200")

    def figures():
        got = {}
        for day in (DAY, DAY + dt.timedelta(days=1)):
            out = str(tmp_path / f"out-{uuid.uuid4().hex}")
            written = daily.run_day(spark, silver_table(spark, table, day), str(root), out, day)
            got |= {(day, r.vehicle_id): (r.trip_count, float(r.earnings), float(r.profit)) for r in written.collect()}
        return got

    def merge(keep_seconds=-1.0):
        return compact.merge_dates(spark, table, SILVER, "event_date", dt.date(2026, 10, 1), ("vehicle_id",), keep_seconds)

    tables.append_silver(first, table, 0)
    tables.append_silver(later, table, 1)
    want = {(DAY, "V001"): (1, 300.0, 149.75), (DAY, "V009"): (1, 10.0, 9.0), (dt.date(2026, 9, 28), "V001"): (1, 50.0, 49.0)}
    assert figures() == want
    assert merge() == ["2026-09-27", "2026-09-28"]
    assert figures() == want  # both sides still hold the rows
    tables.append_silver(later.withColumns({"trip_id": F.lit("T9"), "fare": F.lit(7.0)}), table, 2)
    want[DAY, "V001"] = (2, 307.0, 156.75)
    assert figures() == want  # one batch came after the merge
    assert merge() == ["2026-09-27"]
    assert merge() == [] and not list((tmp_path / "silver").glob("**/*.parquet"))
    assert figures() == want  # only merged rows are left
    assert silver_table(spark, table).count() == 5


def test_a_day_of_merged_silver_reads_that_day_alone(spark, tmp_path):
    table = str(tmp_path / "silver")
    for batch in (0, 1):
        tables.append_silver(stored_silver(spark), table, batch)
    compact.merge_dates(spark, table, SILVER, "event_date", DAY + dt.timedelta(days=1))
    compact.merge_dates(spark, table, SILVER, "event_date", dt.date(2026, 10, 1))
    tables.append_silver(stored_silver(spark), table, 2)
    files = silver_table(spark, table, DAY).inputFiles()
    assert len(files) <= 3 and all("event_date=2026-09-27" in f for f in files)
    every = silver_table(spark, table)
    assert every.count() == 12
    plan = every.where(F.col("event_date") == DAY)._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert len(scans) == 2 and all("PartitionFilters: [isnotnull(event_date" in line for line in scans)


def test_costs_without_any_telemetry_stop_the_daily_job(spark, tmp_path):
    root, out = tmp_path / "in", str(tmp_path / "out")
    root.mkdir()
    expense_folder(root, f"{HEADER}\nV001,5,50,10,yes\n", "expenses_20261001.csv")
    day = dt.date(2026, 10, 1)
    with pytest.raises(ValueError, match="no event of that date"):
        daily.run_day(spark, silver(spark), str(root), out, day)
    assert not (tmp_path / "out").exists()
    row = daily.run_day(spark, silver(spark), str(root), out, day, events_required=False).first()
    assert (row.trip_count, float(row.profit)) == (0, -55.0)


def test_kafka_messages_get_an_id_that_rises_along_a_partition(spark):
    rows = [(bytearray(b"x"), dt.datetime(2024, 1, 1), p, o) for p, o in ((0, 5), (1, 5), (1, 6))]
    frame = spark.createDataFrame(rows, "value binary, timestamp timestamp, partition int, offset long")
    ids = [r.event_id for r in numbered(frame).collect()]
    assert len(set(ids)) == 3 and ids == sorted(ids)


def test_trigger_text():
    assert [length_seconds(t) for t in ("10 seconds", "1 minute", "2 hours")] == [10, 60, 7200]
