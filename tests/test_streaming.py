"""Streaming forms give the same rows as their batch twins, however the input is cut."""

from __future__ import annotations

import datetime as dt
import json
import random
import subprocess
import sys
import time

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from roadbook import contract
from roadbook.operators import clean, earnings, idle, sketches, windows
from roadbook.plans import incremental
from roadbook.plans import live as live_plan
from roadbook.sinks import compact, dead_letters, tables
from roadbook.sinks.alerts import publish_alerts
from roadbook.sources import given_tables as given
from roadbook.sources import logs
from roadbook.streaming import idle as live_idle
from roadbook.streaming import windows as live_windows
from roadbook.streaming.events import EventBatch, LiveTables, append_alerts, start_events
from roadbook.streaming.partials import WindowPartials, start_partials
from roadbook.streaming.progress import NoDataAlerts, ProgressTable, SilenceWatch

SF = "/root/testdata/sf0.001"
AVAILABLE = {"availableNow": True}


def rows(df):
    return sorted(tuple(str(v) for v in r) for r in df.select(*sorted(df.columns)).collect())


def split_feed(spark, folder, parts):
    """The events as ``parts`` files in time order; the stream takes one file per batch."""
    events = given.events(spark, SF)
    total = events.count()
    for part in range(parts):
        low, high = part * total // parts, (part + 1) * total // parts
        chunk = events.where((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1)
        chunk.write.mode("append").parquet(str(folder))
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def passed(alerts, silver, delay=dt.timedelta(minutes=2)):
    """Alerts of events that the watermark has passed."""
    newest = silver.agg(F.max("event_ts")).first()[0]
    newest = newest.replace(microsecond=newest.microsecond // 1000 * 1000)
    return alerts.where(F.col("created_at") < F.lit(newest - delay))


def no_load_time(df):
    return df.drop("updated_at", "computed_at", "ingested_at")


def live_silver(feed):
    return clean.silver(clean.parse_telemetry(given.envelopes_of(feed)))


def batch_silver(spark):
    events = given.telemetry(spark, SF)
    return clean.silver(events.withColumn("event_ts", F.col("event_ts").cast("timestamp")))


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_idle_alert_stream_equals_batch(spark, tmp_path, parts):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_idle.STATE_PROVIDER)
    feed = split_feed(spark, tmp_path / "in", parts)
    query = (
        live_idle.live_idle_alerts(live_silver(feed), 720.0)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(**AVAILABLE)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    silver = batch_silver(spark)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(passed(idle.idle_alerts(silver, 720.0), silver))


@pytest.mark.parametrize("parts", [1, 3])
def test_micro_batches_fill_all_tables(spark, tmp_path, parts):
    feed = given.envelopes_of(split_feed(spark, tmp_path / "in", parts))
    queries = live_plan.start_live(
        feed, f"{tmp_path}/live",
        trigger=AVAILABLE,
        window="6 hours",
        threshold_minutes=720.0,
        checkpoints=f"{tmp_path}/checkpoints",
    )
    for query in queries:
        query.awaitTermination()
    stored = LiveTables(f"{tmp_path}/live")
    silver = batch_silver(spark)
    assert rows(stored.silver(spark).drop("event_date")) == rows(silver)
    assert rows(no_load_time(stored.states(spark))) == rows(idle.vehicle_states(silver, 720.0))
    assert rows(stored.alerts(spark)) == rows(idle.idle_alerts(silver, 720.0))
    fleet = stored.fleet(spark)
    assert fleet.count() == 1 and fleet.first().updated_at is not None
    log = stored.health_log(spark)
    assert log.agg(F.sum("raw_rows"), F.sum("valid_rows"), F.sum("stale_rows")).first() == (1000, silver.count(), 0)
    metrics = live_windows.read_windows(spark, stored.path("zone_windows"))
    exact = windows.zone_windows(silver, "6 hours")
    keys = live_windows.WINDOW_KEYS
    same = ["event_count", "active_vehicles", "idle_vehicles", "trips_in_window"]
    assert rows(metrics.select(*keys, *same)) == rows(exact.select(*keys, *same))


def test_rows_older_than_the_state_are_skipped_and_counted(spark, tmp_path):
    """The second batch brings rows from before the first one."""
    schema = "value string, timestamp timestamp, event_id long"
    start = dt.datetime(2024, 1, 1)

    def send(*events):
        rows = [
            (
                json.dumps({"vehicle_id": "V1", "driver_id": "D1", "status": s, "timestamp": (start + dt.timedelta(minutes=m)).isoformat()}),
                start,
                number,
            )
            for number, (s, m) in enumerate(events)
        ]
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    live = LiveTables(str(tmp_path / "live"))

    def run():
        feed = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
        handler = EventBatch(live, publish=lambda alerts: publish_alerts(alerts, "json", path=str(tmp_path / "topic")))
        start_events(feed, handler, str(tmp_path / "c1"), AVAILABLE).awaitTermination()

    send(("idle", 10), ("idle", 12))
    run()
    send(("on_trip", 11), ("idle", 2), ("idle", 14), ("idle", 16))
    run()
    send(("on_trip", 17), ("idle", 18), ("idle", 30))
    run()
    expected = [start + dt.timedelta(minutes=m) for m in (16, 30)]
    assert sorted(r.created_at for r in live.alerts(spark).collect()) == expected
    assert spark.read.json(str(tmp_path / "topic")).where("key = 'V1'").count() == 2
    log = live.health_log(spark)
    assert [r.stale_rows for r in log.orderBy("batch_id").collect()] == [0, 2, 0]
    state = live.states(spark).first()
    assert (state.idle_since, state.idle_alert_sent) == (start + dt.timedelta(minutes=18), True)


@pytest.mark.parametrize("parts", [1, 2, 5])
def test_idle_alert_stream_takes_rows_in_any_order(spark, tmp_path, parts):
    """Rows arrive up to 50 minutes late, dealt over 1, 2 or 5 micro-batches."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_idle.STATE_PROVIDER)
    rng, start = random.Random(7), dt.datetime(2024, 1, 1)
    schema = "event_id long, vehicle_id string, driver_id string, zone_id string, status string, event_ts timestamp"
    events = [
        (i, f"V{rng.randrange(3)}", "D", "Z", "idle" if rng.random() < 0.85 else "enroute", start + dt.timedelta(seconds=37 * i))
        for i in range(600)
    ]
    late = sorted(events, key=lambda e: e[5] + dt.timedelta(minutes=rng.random() * 50))
    late.append((1000, "V9", "D", "Z", "enroute", start + dt.timedelta(days=1)))
    for part in range(parts):
        some = late[part * len(late) // parts : (part + 1) * len(late) // parts]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by age
    feed = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    query = (
        live_idle.live_idle_alerts(feed, 5.0, "1 hour")
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(**AVAILABLE)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    expected = idle.idle_alerts(spark.createDataFrame(late, schema), 5.0)
    assert expected.count() > 20
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(expected)


def test_a_new_checkpoint_adds_and_replaces_nothing(spark, tmp_path):
    live, schema = LiveTables(str(tmp_path / "live")), "value string, timestamp timestamp"
    at = dt.datetime(2024, 1, 1, 8)

    def run(checkpoint, vehicle, minute):
        text = json.dumps({"vehicle_id": vehicle, "status": "idle", "timestamp": (at + dt.timedelta(minutes=minute)).isoformat()})
        source = str(tmp_path / f"in-{checkpoint}")
        spark.createDataFrame([(text, at)], schema).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(schema).parquet(source)
        start_events(feed, EventBatch(live), str(tmp_path / checkpoint), AVAILABLE).awaitTermination()

    for minute in range(3):
        run("first", "V1", minute)
    run("second", "V2", 10)
    assert live.silver(spark).count() == 4
    assert {r.vehicle_id for r in live.states(spark).collect()} == {"V1", "V2"}
    assert {(r.vehicle_id, r.last_event_ts.minute) for r in live.states(spark).collect()} == {("V1", 2), ("V2", 10)}
    assert live.health_log(spark).count() == 4
    assert live.fleet(spark).first().window_end == at + dt.timedelta(minutes=10)


def test_merging_keeps_every_row_once_beside_new_batches(spark, tmp_path):
    live, schema = LiveTables(str(tmp_path / "live")), "value string, timestamp timestamp"
    at = dt.datetime(2024, 1, 1, 8)

    def text(number):
        time = at + dt.timedelta(minutes=number)
        return json.dumps({"vehicle_id": f"V{number % 3}", "status": "idle", "timestamp": time.isoformat()})

    def batch(number):
        EventBatch(live)(spark.createDataFrame([(text(number), at)], schema), number)

    def seen():
        return [rows(d.drop("processed_at")) for d in (live.silver(spark), live.alerts(spark), live.health_log(spark))]

    def stored(name):
        return len([p for p in (tmp_path / "live").glob(f"{name}/**/*.parquet")])

    for number in range(8):
        batch(number)
    before, small = seen(), stored("silver")
    tomorrow = dt.datetime.now(dt.timezone.utc).date() + dt.timedelta(days=1)
    assert live.compact(spark, dt.date(2024, 1, 1))["silver"] == []
    assert live.compact(spark, tomorrow)["silver"] == ["2024-01-01"]
    assert seen() == before
    batch(8)
    after = seen()
    assert len(after[0]) == len(before[0]) + 1
    assert live.compact(spark, tomorrow)["silver"] == ["2024-01-01"]
    assert seen() == after
    assert live.compact(spark, tomorrow, keep_seconds=-1.0)["silver"] == []  # removes what is merged
    assert seen() == after
    assert small == 8 and stored("silver") == 0 and stored("silver_merged") <= 2
    batch(9)
    assert len(live.silver(spark).collect()) == 10


def test_many_batches_and_amounts_of_any_size(spark, tmp_path):
    live, schema = LiveTables(str(tmp_path / "live")), "value string, timestamp timestamp"
    at = dt.datetime(2024, 1, 1, 8)

    def text(trip, fare):
        return json.dumps({"vehicle_id": trip, "status": "on_trip", "trip_id": trip, "fare": fare, "timestamp": at.isoformat()})

    handler = EventBatch(live)
    for batch_id in range(20):
        big = [9e9, 9e9, 9e9, 2e10, 5.0, 1e30]  # the last is no fare
        handler(spark.createDataFrame([(text(f"T{i}", fare), at) for i, fare in enumerate(big)], schema), batch_id)
    row = live.fleet(spark).first()
    assert (row.trips_in_window, float(row.live_fare_exposure)) == (5, 47_000_000_005.0)
    log = live.health_log(spark).agg(F.sum("raw_rows"), F.sum("valid_rows")).first()
    assert tuple(log) == (120, 100)


def test_batch_without_valid_rows_leaves_snapshots_alone(spark, tmp_path):
    live = LiveTables(str(tmp_path / "live"))
    handler = EventBatch(live)
    schema = "value string, timestamp timestamp"
    at = dt.datetime(2024, 1, 1, 8)
    good = json.dumps({"vehicle_id": "V1", "status": "on_trip", "trip_id": "T", "fare": 5.0, "timestamp": at.isoformat()})
    for batch_id, values in enumerate((["{"], [good], ["{", "[]"], [])):
        handler(spark.createDataFrame([(v, at) for v in values], schema), batch_id)
    assert (live.fleet(spark).first().total_vehicles, live.zones(spark).count(), live.states(spark).count()) == (1, 1, 1)
    log = live.health_log(spark).orderBy("batch_id").collect()
    assert [(r.raw_rows, r.valid_rows) for r in log] == [(1, 0), (1, 1), (2, 0), (0, 0)]
    handler(spark.createDataFrame([(good, at)], schema), 1)
    assert live.silver(spark).count() == 1


def test_final_windows_match_exact_windows_that_closed(spark, tmp_path):
    feed = split_feed(spark, tmp_path / "in", 3)
    query = (
        live_windows.final_zone_windows(live_silver(feed), "2 minutes", "6 hours")
        .writeStream.outputMode("append")
        .format("parquet")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .trigger(**AVAILABLE)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    silver = batch_silver(spark)
    newest = silver.agg(F.max("event_ts")).first()[0]
    closed = windows.zone_windows(silver, "6 hours").where(
        F.col("window_end") <= F.lit(newest - dt.timedelta(minutes=2))
    )
    columns = [c for c in closed.columns if c != "avg_speed"]
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0
    assert rows(out.select(*columns)) == rows(closed.select(*columns))


def test_restart_continues_from_checkpoint(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", live_idle.STATE_PROVIDER)
    events = given.events(spark, SF)
    source = str(tmp_path / "in")
    for half in ("event_id < 500", "event_id >= 500"):
        events.where(half).coalesce(1).write.mode("append").parquet(source)
        feed = spark.readStream.schema(events.schema).parquet(source)
        (
            live_idle.live_idle_alerts(live_silver(feed), 720.0)
            .writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .trigger(**AVAILABLE)
            .start(str(tmp_path / "out"))
            .awaitTermination()
        )
    silver = batch_silver(spark)
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(passed(idle.idle_alerts(silver, 720.0), silver))


def test_watermark_drops_rows_behind_it(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "vehicle_id string, trip_id string, status string, speed double, fare double, zone_id string, time_of_day string, event_ts timestamp"

    def send(*times):
        data = [("V1", "T1", "on_trip", 1.0, 1.0, "Z00", "night", dt.datetime.fromisoformat(t)) for t in times]
        spark.createDataFrame(data, schema).coalesce(1).write.mode("append").parquet(source)

    def run():
        feed = spark.readStream.schema(schema).parquet(source)
        query = live_windows.start_windows(
            live_windows.live_zone_windows(feed), str(tmp_path / "out"), str(tmp_path / "checkpoint"), AVAILABLE
        )
        query.awaitTermination()
        return sum(p["stateOperators"][0]["numRowsDroppedByWatermark"] for p in query.recentProgress if p["stateOperators"])

    send("2024-01-01 00:10:00")
    assert run() == 0
    send("2024-01-01 00:07:30", "2024-01-01 00:09:30", "2024-01-01 00:20:00")
    assert run() == 1
    starts = {str(r[0]) for r in live_windows.read_windows(spark, str(tmp_path / "out")).select("window_start").collect()}
    assert starts == {"2024-01-01 00:10:00", "2024-01-01 00:09:00", "2024-01-01 00:20:00"}


def test_silence_is_told_once_and_rearmed_by_data():
    at = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
    watch = SilenceWatch(10, 12)
    watch.data(at)
    assert watch.idle(at + dt.timedelta(seconds=119)) is None
    assert watch.idle(at + dt.timedelta(seconds=120)) == 12
    assert watch.idle(at + dt.timedelta(seconds=500)) is None
    watch.data(at + dt.timedelta(seconds=600))
    assert watch.idle(at + dt.timedelta(seconds=720)) == 12


def test_no_data_alerts_are_stored_published_and_never_replaced(spark, tmp_path):
    live, topic = LiveTables(str(tmp_path)), str(tmp_path / "topic")
    for run in range(2):  # a listener knows nothing of the one before it
        listener = NoDataAlerts(spark, live, 10, publish=lambda alerts: publish_alerts(alerts, "json", path=topic))
        listener.write_alert(12, dt.datetime(2024, 1, 1, run, tzinfo=dt.timezone.utc))
    found = live.alerts(spark).collect()
    assert len(found) == 2
    assert {(r.alert_type, r.severity, r.message) for r in found} == {("NO_DATA", "CRITICAL", "no telemetry for 12 consecutive batches")}
    assert spark.read.json(topic).where("key = 'pipeline'").count() == 2


def test_silent_feed_raises_one_alert(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.noDataProgressEventInterval", "300")
    live = LiveTables(str(tmp_path / "live"))
    listener = NoDataAlerts(spark, live, 0.5, 2)
    spark.streams.addListener(listener)
    feed = split_feed(spark, tmp_path / "in", 1)
    query = (
        feed.writeStream.format("noop")
        .option("checkpointLocation", str(tmp_path / "checkpoint"))
        .queryName("telemetry_events")
        .trigger(processingTime="200 milliseconds")
        .start()
    )
    try:
        deadline = time.time() + 60
        while time.time() < deadline and live.alerts(spark).isEmpty():
            time.sleep(0.5)
        time.sleep(3)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
        spark.conf.unset("spark.sql.streaming.noDataProgressEventInterval")
    assert [(r.alert_type, r.severity) for r in live.alerts(spark).collect()] == [("NO_DATA", "CRITICAL")]


def test_state_processor_travels_without_the_package(tmp_path):
    (tmp_path / "processor").write_bytes(cloudpickle.dumps(live_idle.IdleWatch(5.0)))
    code = "import pickle; pickle.load(open('processor', 'rb')); import sys; assert 'roadbook' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)


def test_progress_rows_are_written(spark, tmp_path):
    listener = ProgressTable(spark, str(tmp_path / "progress"), flush_rows=100)
    spark.streams.addListener(listener)
    try:
        feed = split_feed(spark, tmp_path / "in", 1)
        query = (
            feed.writeStream.format("noop")
            .option("checkpointLocation", str(tmp_path / "checkpoint"))
            .queryName("watched")
            .trigger(**AVAILABLE)
            .start()
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    listener.flush()
    assert len(list((tmp_path / "progress").glob("**/*.parquet"))) <= 2  # rows are written together, not one by one
    progress = LiveTables(str(tmp_path)).progress(spark)
    assert progress.where("event = 'progress'").agg(F.sum("input_rows")).first()[0] == 1000
    assert {r.event for r in progress.select("event").distinct().collect()} >= {"started", "progress"}


def test_a_batch_is_what_it_accepted_and_what_it_rejected(spark, tmp_path, monkeypatch):
    live, schema = LiveTables(str(tmp_path / "live")), "value string, timestamp timestamp"
    at = dt.datetime(2024, 1, 1, 8)

    def text(status, vehicle="V1", time=None):
        return json.dumps({"vehicle_id": vehicle, "status": status, "timestamp": time or at.isoformat()})

    batches = [[text("idle"), text("offline"), text("idle", " ")], [text("offline", "V2"), "{", text("idle", time="later")], [text("parked", "V3")]]
    for batch_id, values in enumerate(batches):
        EventBatch(live)(spark.createDataFrame([(v, at) for v in values], schema), batch_id)
    EventBatch(live)(spark.createDataFrame([(v, at) for v in batches[1]], schema), 1)  # a replayed batch
    assert (live.silver(spark).count(), live.rejected(spark).count()) == (1, 6)
    reasons = {(r.batch_id, r.reject_reason) for r in live.rejected(spark).collect()}
    assert (0, "unknown_status") in reasons and (1, "bad_event_time") in reasons
    assert {r.timestamp for r in live.rejected(spark).where("reject_reason = 'bad_event_time'").collect()} >= {"later"}

    def lenient(rows):
        return rows.withColumn("status", F.when(F.lower("status") == "offline", "idle").otherwise(F.col("status")))

    def replay():
        return dead_letters.replay(
            spark, live.path("rejected"), live.path("silver"), lambda r: clean.silver(lenient(r)), lambda r: clean.with_reject_reason(lenient(r))
        )

    assert live.replay_rejected(spark) == 0  # the rules are as they were
    broken = tables.write_partitions
    monkeypatch.setattr(tables, "write_partitions", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        replay()
    assert live.silver(spark).count() == 3
    monkeypatch.setattr(tables, "write_partitions", broken)
    EventBatch(live)(spark.createDataFrame([(text("offline", "V4"), at)], schema), 3)
    assert replay() == 2  # what broke off is finished
    assert (live.silver(spark).count(), live.rejected(spark).count()) == (3, 5)
    assert replay() == 1 and replay() == 0
    assert sorted(r.vehicle_id for r in live.silver(spark).collect()) == ["V1", "V1", "V2", "V4"]
    assert {r.reject_reason for r in live.rejected(spark).collect()} == {"blank_vehicle", "bad_event_time", "unknown_status"}
    assert live.rejected(spark).count() == 4


def test_late_rows_correct_closed_windows(spark, tmp_path):
    events = batch_silver(spark)
    late = F.col("event_id") % 7 == 0
    partials = WindowPartials(str(tmp_path / "w"), "6 hours")
    day = F.col("event_ts") < F.lit("2024-01-16").cast("timestamp")
    batches = [events.where(day & ~late), events.where(day & late), events.where(~day), events.limit(0)]
    for batch_id, batch in enumerate(batches):
        partials(batch, batch_id)
    partials(batches[1], 1)  # replayed
    exact = windows.zone_windows(events, "6 hours")
    columns = exact.columns
    plain = lambda df: rows(df.select(*columns).withColumn("avg_speed", F.round("avg_speed", 6)))
    assert plain(partials.windows(spark)) == plain(exact)
    newest = events.agg(F.max("event_ts")).first()[0]
    closed = F.col("window_end") <= F.lit(newest - dt.timedelta(minutes=2))
    assert plain(partials.corrected(spark)) == plain(exact.where(closed))
    final, corrections = partials.final(spark), partials.corrections(spark)
    assert 0 < corrections.count() < exact.count()
    assert final.agg(F.sum("event_count")).first()[0] < exact.where(closed).agg(F.sum("event_count")).first()[0]
    started = spark.readStream.schema(events.schema).parquet(str(split_silver(events, tmp_path / "in")))
    handler = WindowPartials(str(tmp_path / "s"), "6 hours")
    start_partials(started, handler, str(tmp_path / "c"), AVAILABLE).awaitTermination()
    assert plain(handler.windows(spark)) == plain(exact)


def split_silver(events, folder):
    events.repartition(3).write.parquet(str(folder))
    return folder


def test_newest_alerts_read_the_newest_dates_alone(spark, tmp_path):
    live = LiveTables(str(tmp_path / "live"))
    start = dt.datetime(2024, 1, 1)
    for day in range(40):
        at = start + dt.timedelta(days=day)
        rows_ = [("IDLE_VEHICLE", f"V{n}", None, None, None, "WARNING", "m", at + dt.timedelta(minutes=n)) for n in range(2 if day < 39 else 1)]
        kinds = "alert_type string, vehicle_id string, driver_id string, zone_id string, idle_minutes decimal(10,2), severity string, message string, created_at timestamp"
        append_alerts(tables.finalise(spark.createDataFrame(rows_, kinds), contract.ALERTS), live.path("alerts"), day)
    live.compact(spark, dt.date(2024, 1, 20))
    newest = live.recent_alerts(spark, 5)
    assert [(r.created_at - start).days for r in newest.collect()] == [39, 38, 38, 37, 37]
    read = {f.split("alert_date=")[1][:10] for f in logs.newest_rows(spark, [live.path("alerts")], contract.ALERTS, "alert_date", 5).inputFiles()}
    assert len(read) <= 4 and max(read) == "2024-02-09"
    assert live.recent_alerts(spark, 500).count() == 79
    assert LiveTables(str(tmp_path / "none")).recent_alerts(spark).count() == 0


def test_a_refresh_redoes_only_dates_with_new_batches(spark, tmp_path):
    silver, out = str(tmp_path / "silver"), str(tmp_path / "out")
    events = batch_silver(spark)
    first_days = F.col("event_ts") < F.lit("2024-01-05").cast("timestamp")
    tables.append_silver(events.where(first_days & (F.col("event_id") % 5 != 0)), silver, 0)
    days = incremental.refresh(spark, silver, out)
    assert [d.day for d in days] == [1, 2, 3, 4] and incremental.refresh(spark, silver, out) == []
    tables.append_silver(events.where(~first_days), silver, 1)
    compact.merge_dates(spark, silver, contract.SILVER, "event_date", dt.date(2024, 1, 3))
    assert [d.day for d in incremental.refresh(spark, silver, out)] == list(range(5, 31))
    written = {p: p.stat().st_mtime_ns for p in (tmp_path / "out").glob("report_date=2024-01-0[1-4]/*.parquet")}
    late = events.where(first_days & (F.col("event_id") % 5 == 0) & (F.col("event_ts") >= F.lit("2024-01-02").cast("timestamp")) & (F.col("event_ts") < F.lit("2024-01-03").cast("timestamp")))
    tables.append_silver(late, silver, 2)
    assert incremental.refresh(spark, silver, out) == [dt.date(2024, 1, 2)]
    kept = {p for p, at in written.items() if p.exists() and p.stat().st_mtime_ns == at}
    assert {p.parent.name[-2:] for p in kept} == {"01", "03", "04"}
    rest = (F.col("event_id") % 5 == 0) & (F.dayofmonth("event_ts") != 2)
    tables.append_silver(events.where(first_days & rest), silver, 3)
    assert [d.day for d in incremental.refresh(spark, silver, out)] == [1, 3, 4]
    assert rows(spark.read.parquet(out)) == rows(earnings.daily_earnings(events))


def test_minutes_unite_to_hours(spark):
    events = batch_silver(spark)
    minutes = sketches.window_sketches(events)
    hours = sketches.united_windows(minutes, "6 hours")
    halves = sketches.window_sketches(events.where("event_id % 2 = 0")).unionByName(sketches.window_sketches(events.where("event_id % 2 = 1")))
    exact = windows.zone_windows(events, "6 hours")
    checked = windows.sketch_check(hours, exact, deviation=sketches.UNION_DEVIATION)
    assert checked.count() == exact.count()
    assert checked.where("NOT (active_vehicles_near AND idle_vehicles_near AND trips_in_window_near)").count() == 0
    same = ["window_start", "zone_id", "time_of_day", "event_count", "live_fare_exposure", "active_vehicles", "trips_in_window"]
    assert rows(hours.select(*same)) == rows(sketches.united_windows(halves, "6 hours").select(*same))
    assert rows(hours.select(*same[:5])) == rows(exact.select(*same[:5]))
    with pytest.raises(ValueError):
        sketches.united_windows(minutes, "90 seconds")
