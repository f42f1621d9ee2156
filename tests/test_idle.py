"""Idle streaks against a plain walk through the rows, and under skew."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from roadbook.operators import idle, lateness
from roadbook.operators.running import with_running_max

SCHEMA = "event_id long, vehicle_id string, driver_id string, zone_id string, lat double, lon double, status string, event_ts timestamp"
START = dt.datetime(2024, 1, 1)


def make(spark, rows):
    data = [(i, v, "D", "Z00", 6.9, 79.9, s, START + dt.timedelta(seconds=t)) for i, (v, s, t) in enumerate(rows)]
    return spark.createDataFrame(data, SCHEMA)


def walk(rows, threshold):
    """Alerts, streaks and final states by reading the rows one by one."""
    alerts, streaks, states = [], [], {}
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], rows[i][2], i))
    for i in order:
        vehicle, status, t = rows[i]
        status_before, since, sent = states.get(vehicle, (None, None, False))
        if status != "idle":
            since, sent = None, False
        elif status_before != "idle":
            since, sent = t, False
            streaks.append([vehicle, t, t, 0])
        if status == "idle":
            mine = [s for s in streaks if s[0] == vehicle][-1]
            mine[2], mine[3] = t, mine[3] + 1
            if not sent and t - since >= threshold:
                alerts.append((vehicle, t, t - since))
                sent = True
        states[vehicle] = (status, since, sent)
    return alerts, [tuple(s) for s in streaks], states


def random_rows(seed, n=400):
    """Half of the rows belong to one vehicle; times collide and go backwards."""
    rng = random.Random(seed)
    vehicles = ["HOT"] * 3 + ["A", "B", "C"]
    return [
        (rng.choice(vehicles), rng.choice(["idle", "idle", "idle", "on_trip"]), rng.randrange(0, 5000)) for _ in range(n)
    ]


def seconds(ts):
    return int((ts - START).total_seconds())


@pytest.mark.parametrize("seed, ranges", [(1, None), (2, 1), (3, 7), (4, 200)])
def test_streaks_and_alerts_match_a_plain_walk(spark, seed, ranges):
    rows = random_rows(seed)
    frame = make(spark, rows)
    alerts, streaks, states = walk(rows, 300)
    got = idle.idle_alerts(frame, 5.0, ranges).collect()
    assert sorted((r.vehicle_id, seconds(r.created_at)) for r in got) == sorted(a[:2] for a in alerts)
    got = idle.idle_episodes(frame, ranges).collect()
    assert sorted((r.vehicle_id, seconds(r.idle_since), seconds(r.last_idle_ts), r.event_count) for r in got) == sorted(streaks)
    got = idle.vehicle_states(frame, 5.0, ranges).collect()
    assert {
        r.vehicle_id: (r.status, r.idle_since and seconds(r.idle_since), r.idle_alert_sent) for r in got
    } == states


@pytest.mark.parametrize("ranges", [1, 7, 60])
def test_stored_state_continues_streaks(spark, ranges):
    rows = sorted(random_rows(9), key=lambda r: r[2])
    turn = rows[200][2]
    frame = make(spark, rows).withColumn("s", F.unix_seconds("event_ts") - int(START.timestamp()))
    border = START + dt.timedelta(seconds=turn)
    first, second = frame.where(F.col("event_ts") < border).drop("s"), frame.where(F.col("event_ts") >= border).drop("s")
    state = idle.vehicle_states(first, 5.0, ranges)
    runs = idle.idle_runs(second, state, ranges)
    both = idle.idle_alerts(first, 5.0, ranges).union(idle.alerts_from_runs(runs, 5.0))
    alerts, _, states = walk(rows, 300)
    assert sorted((r.vehicle_id, seconds(r.created_at)) for r in both.collect()) == sorted(a[:2] for a in alerts)
    got = idle.states_from_runs(runs, 5.0).collect()
    assert all(states[r.vehicle_id] == (r.status, r.idle_since and seconds(r.idle_since), r.idle_alert_sent) for r in got)


@pytest.mark.parametrize("ranges", [1, 7, 200])
def test_one_vehicle_with_all_rows_lies_in_many_ranges(spark, ranges):
    rng = random.Random(8)
    rows = [("HOT", rng.choice(["idle"] * 30 + ["on_trip"]), 3600 + rng.randrange(0, 3600)) for _ in range(2000)]
    frame = make(spark, rows)
    kept = []

    def keep(df):
        kept.append(df.persist())
        return kept[0]

    runs = idle.idle_runs(frame, None, ranges, keep)
    alerts, streaks, _ = walk(rows, 20)
    got = idle.episodes_from_runs(runs).collect()
    assert sorted((r.vehicle_id, seconds(r.idle_since), seconds(r.last_idle_ts), r.event_count) for r in got) == sorted(streaks)
    sizes = [r["count"] for r in kept[0].groupBy("_part").count().collect()]
    assert len(sizes) > 0.6 * ranges and max(sizes) < 3 * 2000 / ranges + 20
    kept[0].unpersist()


def test_a_streak_over_whole_ranges_and_batches(spark):
    rows = [("A", "on_trip", 0), *[("B", "idle", t) for t in range(500)], ("B", "on_trip", 500), ("C", "idle", 3)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        for ranges in (1, 40):
            runs = idle.idle_runs(make(spark, rows), None, ranges).where("vehicle_id = 'B' AND status = 'idle'")
            got = runs.select("streak.ts", "event_ts", "prev_ts", "prev_status").orderBy("event_ts").collect()
            assert {seconds(r.ts) for r in got} == {0}
            assert [r.prev_ts and seconds(r.prev_ts) for r in got] == [None, *range(499)]
            assert [r.prev_status for r in got] == [None, *["idle"] * 499]
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_rows_are_exchanged_once(spark):
    plans = []

    def keep(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return df

    idle.idle_runs(make(spark, random_rows(1)), None, 8, keep)
    assert plans[0].count("Exchange ") == 1 and "rangepartitioning(vehicle_id" in plans[0]
    assert "Window" not in plans[0] and "Join" not in plans[0]


def test_a_stored_idle_state_without_a_start_begins_anew(spark):
    kinds = "vehicle_id string, status string, last_event_ts timestamp, idle_since timestamp, idle_alert_sent boolean"
    state = spark.createDataFrame([("V", "idle", START, None, None), ("X", "idle", START, START, True)], kinds)
    runs = idle.idle_runs(make(spark, [("V", "idle", 5), ("V", "idle", 9)]), state, 3)
    got = [(seconds(r.streak.ts), r.streak.sent, r.prev_status, r.prev_stored) for r in runs.orderBy("event_ts").collect()]
    assert got == [(5, False, "idle", True), (5, False, "idle", False)]


def test_no_events(spark):
    assert idle.idle_episodes(make(spark, [("V", "idle", 0)]).where("false")).count() == 0


def test_alert_fires_once_at_the_threshold_and_rearms(spark):
    rows = [("V", "idle", 0), ("V", "idle", 299), ("V", "idle", 300), ("V", "idle", 900), ("V", "on_trip", 901)]
    rows += [("V", "idle", 1000), ("V", "idle", 1400)]
    got = idle.idle_alerts(make(spark, rows)).orderBy("created_at").collect()
    assert [(seconds(r.created_at), str(r.idle_minutes)) for r in got] == [(300, "5.00"), (1400, "6.67")]
    assert got[1].message == "V idle for 6.7 minutes (threshold 5m)"


def test_rows_older_than_the_state_are_marked(spark):
    state = spark.createDataFrame([("V", START + dt.timedelta(seconds=100))], "vehicle_id string, last_event_ts timestamp")
    marked = idle.split_stale(make(spark, [("V", "idle", 99), ("V", "idle", 100), ("W", "idle", 1)]), state)
    assert {(r.vehicle_id, seconds(r.event_ts)): r.stale for r in marked.collect()} == {
        ("V", 99): True,
        ("V", 100): False,
        ("W", 1): False,
    }


@pytest.mark.parametrize("chunk", [1, 3, 1000])
def test_running_max_does_not_depend_on_chunks(spark, chunk):
    rng = random.Random(5)
    numbers = [rng.choice([None, rng.randrange(1000)]) for _ in range(200)]
    frame = spark.createDataFrame(list(enumerate(numbers)), "i long, v long").repartition(4)
    got = with_running_max(frame, F.col("i"), F.floor(F.col("i") / chunk), {"m": F.col("v")}).orderBy("i").collect()
    best, expected = None, []
    for n in numbers:
        best = n if best is None else best if n is None else max(best, n)
        expected.append(best)
    assert [r.m for r in got] == expected


def test_late_events_do_not_depend_on_chunks(spark):
    rng = random.Random(6)
    rows = [(i, START + dt.timedelta(seconds=10 * i - rng.choice([0, 0, 300]))) for i in range(300)]
    frame = spark.createDataFrame(rows, "event_id long, event_ts timestamp")
    newest, expected = START - dt.timedelta(days=1), []
    for i, ts in rows:
        newest = max(newest, ts)
        if ts < newest - dt.timedelta(minutes=2):
            expected.append(i)
    for chunk in (7, 1_000_000):
        got = lateness.late_events(frame, "2 minutes", chunk).collect()
        assert sorted(r.event_id for r in got) == expected
