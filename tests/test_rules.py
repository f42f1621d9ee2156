"""Column rules on hand-made cases."""

from __future__ import annotations

import datetime as dt
import json
import math

import pytest
from pyspark.sql import functions as F

from roadbook.contract import CITY, Grid
from roadbook.functions import clock, geo, values
from roadbook.operators import clean, earnings, kpi, latest, quality, serving, trips
from roadbook.sources import given_tables


def one(spark, column, **fields):
    """Value of a column expression over one row of literals."""
    row = spark.range(1).select(*[v.alias(k) for k, v in fields.items()])
    return row.select(column).first()[0]


def at(hour, minute=0, second=0, day=1):
    return dt.datetime(2024, 1, day, hour, minute, second)


EVENT = (
    "trip_id string, driver_id string, vehicle_id string, lat double, lon double, speed double,"
    " status string, fare double, event_ts timestamp, event_id long"
)


def event(n, vehicle="V1", status="idle", ts=None, trip=None, fare=0.0, lat=6.9, lon=79.9, speed=0.0):
    return (trip, "D1", vehicle, lat, lon, speed, status, fare, ts or at(10, n), n)


def events(spark, *rows):
    return spark.createDataFrame(list(rows), EVENT)


STEP = (CITY.max_lat - CITY.min_lat) / CITY.cells, (CITY.max_lon - CITY.min_lon) / CITY.cells


def inside(row, column):
    """A point in the middle of a cell."""
    return CITY.min_lat + (row + 0.5) * STEP[0], CITY.min_lon + (column + 0.5) * STEP[1]


@pytest.mark.parametrize(
    "lat, lon, zone",
    [
        *[(*inside(r, c), f"Z{r}{c}") for r in range(CITY.cells) for c in range(CITY.cells)],
        (CITY.min_lat, CITY.min_lon, "Z00"),
        (CITY.max_lat, CITY.max_lon, "Z22"),
        (CITY.min_lat - 5, CITY.min_lon - 5, "Z00"),
        (CITY.max_lat + 5, CITY.max_lon + 5, "Z22"),
        (None, CITY.max_lon, "Z02"),
        (math.nan, CITY.min_lon, "Z20"),
    ],
)
def test_zone(spark, lat, lon, zone):
    fields = {"lat": F.lit(lat).cast("double"), "lon": F.lit(lon).cast("double")}
    assert one(spark, geo.zone_id(F.col("lat"), F.col("lon")), **fields) == zone


def test_zone_may_be_null_and_grid_may_differ(spark):
    null = F.lit(None).cast("double")
    assert one(spark, geo.zone_id(F.col("a"), F.col("b"), null_zone=True), a=null, b=F.lit(79.9)) is None
    fine = Grid(0.0, 10.0, 0.0, 10.0, 5)
    assert one(spark, geo.zone_id(F.col("a"), F.col("b"), fine), a=F.lit(9.9), b=F.lit(4.1)) == "Z42"


@pytest.mark.parametrize("lat, lon, expected",
    [
        (*inside(1, 1), True),
        (None, CITY.min_lon, False),
        (CITY.min_lat, None, False),
        (CITY.min_lat - 0.01, CITY.min_lon, False),
        (CITY.min_lat, CITY.max_lon, True),
    ],
)
def test_in_bounds(spark, lat, lon, expected):
    fields = {"lat": F.lit(lat).cast("double"), "lon": F.lit(lon).cast("double")}
    assert one(spark, geo.in_bounds(F.col("lat"), F.col("lon")), **fields) is expected


def test_time_of_day(spark):
    expected = {4: "night", 5: "morning", 8: "morning", 11: "morning", 12: "afternoon", 13: "afternoon"}
    expected |= {16: "afternoon", 17: "evening", 19: "evening", 20: "evening", 21: "night", 23: "night"}
    hours = spark.createDataFrame([(h, at(h, 59)) for h in expected], "h int, ts timestamp")
    for kind in ("timestamp", "timestamp_ntz"):
        got = hours.select("h", clock.time_of_day(F.col("ts").cast(kind)).alias("part")).collect()
        assert {r.h: r.part for r in got} == expected


def test_time_of_day_in_local_zone(spark):
    column = clock.time_of_day(F.col("ts"), "Asia/Colombo")
    assert one(spark, column, ts=F.lit("2024-01-01 00:00:00").cast("timestamp")) == "morning"


@pytest.mark.parametrize(
    "text, known", [("IDLE", True), (" Enroute ", True), ("on_trip", True), ("offline", False), ("", False), ("\tidle", False)]
)
def test_status(spark, text, known):
    assert one(spark, values.known_status(values.status_text(F.col("s"))), s=F.lit(text)) is known


@pytest.mark.parametrize(
    "money_in, gain, loss",
    [((10.0, 10.25, 3.0), -3.25, True), ((3e11, 1e11, 0.5), 199_999_999_999.5, False), ((7.5, 5.0, 2.5), 0.0, False)],
)
def test_profit(spark, money_in, gain, loss):
    e, f, m = (F.lit(v) for v in money_in)
    assert float(one(spark, values.profit(F.col("e"), F.col("f"), F.col("m")), e=e, f=f, m=m)) == gain
    assert one(spark, values.profit(F.col("e"), F.col("f"), F.col("m")) < 0, e=e, f=f, m=m) is loss


def test_idle_minutes(spark):
    assert str(one(spark, clock.minutes_decimal(F.col("s"), 2), s=F.lit(299_700_000).cast("bigint"))) == "5.00"
    assert str(one(spark, clock.minutes_decimal(F.col("s"), 1), s=F.lit(297_000_000).cast("bigint"))) == "5.0"


def wire(spark, *documents):
    rows = [(bytearray(d if isinstance(d, bytes) else json.dumps(d).encode()), at(12)) for d in documents]
    return spark.createDataFrame(rows, "value binary, timestamp timestamp")


MIDDLE = inside(1, 1)
GOOD = {
    "trip_id": "ride-17",
    "driver_id": " anna",
    "vehicle_id": "bus-1 ",
    "lat": MIDDLE[0],
    "lon": MIDDLE[1],
    "speed": 11.5,
    "status": "ON_TRIP",
    "fare": 3.75,
    "timestamp": "2031-05-06T18:00:00",
}


def test_parse_and_clean_survive_bad_input(spark):
    raw = wire(
        spark,
        GOOD,
        b"{not json",
        {**GOOD, "vehicle_id": "bus-2", "speed": "fast"},
        {**GOOD, "vehicle_id": "bus-3", "timestamp": "yesterday"},
        {**GOOD, "vehicle_id": "bus-4", "timestamp": "2031-05-06T18:00:00.123456+05:30", "lat": 9.0},
        {**GOOD, "vehicle_id": "bus-5", "status": "\ton_trip"},
        {**GOOD, "vehicle_id": "  "},
        {**GOOD, "vehicle_id": "bus-6", "fare": 1e13},
        {**GOOD, "vehicle_id": "bus-7", "speed": -1e40},
    )
    rows = {r.vehicle_id: r for r in clean.silver(clean.parse_telemetry(raw)).collect()}
    assert set(rows) == {"bus-1", "bus-2", "bus-4"}
    assert (rows["bus-1"].driver_id, rows["bus-1"].status, rows["bus-1"].zone_id) == ("anna", "on_trip", "Z11")
    assert rows["bus-1"].time_of_day == "evening"
    assert rows["bus-2"].speed == 0.0
    assert rows["bus-4"].event_ts == dt.datetime(2031, 5, 6, 12, 30, 0, 123456)
    assert rows["bus-4"].lat == CITY.max_lat
    reasons = {r.reason: r.row_count for r in clean.reject_reasons(clean.parse_telemetry(raw)).collect()}
    assert reasons == {"accepted": 3, "blank_vehicle": 2, "bad_event_time": 1, "unknown_status": 1, "bad_fare": 1, "bad_speed": 1}


def test_latest_breaks_ties_by_id(spark):
    rows = events(spark, event(1, ts=at(10)), event(3, ts=at(10), status="on_trip"), event(2, ts=at(9)))
    assert [r.event_id for r in latest.latest_per_vehicle(rows).collect()] == [3]


def test_fleet_snapshot(spark):
    rows = events(
        spark,
        event(1, "V1", "on_trip", trip="T1", fare=10.0, speed=30.0),
        event(2, "V1", "idle", trip="T1", fare=15.5, speed=0.0),
        event(3, "V2", "on_trip", trip="T2", fare=7.25, speed=40.0),
        event(4, "V3", "enroute", trip="T3", speed=20.0),
    )
    row = kpi.fleet_snapshot(rows, 10).first()
    assert (row.total_vehicles, row.active_vehicles, row.idle_vehicles, row.event_count) == (3, 2, 1, 3)
    assert (row.trips_in_window, row.trips_per_hour, float(row.live_fare_exposure)) == (2, 720.0, 22.75)
    assert (row.idle_ratio, row.avg_speed) == (1 / 3, 20.0)
    assert (row.window_start, row.window_end) == (at(10, 2), at(10, 4))


def test_fleet_snapshot_of_nothing(spark):
    row = kpi.fleet_snapshot(events(spark).limit(0)).first()
    assert (row.total_vehicles, row.idle_ratio, row.trips_in_window, float(row.live_fare_exposure)) == (0, 0.0, 0, 0.0)


def test_trip_over_two_zones_counts_in_each_and_zone_without_newest_row_vanishes(spark):
    rows = clean.assign_zone(
        events(
            spark,
            event(1, "V1", "on_trip", trip="T1", fare=10.0, lat=6.85, lon=79.80),
            event(2, "V1", "on_trip", trip="T1", fare=14.0, lat=7.00, lon=79.95),
            event(3, "V2", "idle", lat=6.85, lon=79.80),
            event(4, "V3", "on_trip", trip="T2", fare=1.0, lat=6.925, lon=79.80),
            event(5, "V3", "idle", lat=7.00, lon=79.95),
        )
    )
    zones = {r.zone_id: (r.active_vehicles, r.trips_in_window, float(r.live_fare_exposure)) for r in kpi.zone_snapshot(rows).collect()}
    assert zones == {"Z00": (0, 1, 10.0), "Z22": (1, 1, 14.0)}
    assert [r.zone_id for r in kpi.zone_ranking(kpi.zone_snapshot(rows)).collect()] == ["Z22", "Z00"]


def test_earnings_keep_the_final_idle_row_of_a_trip(spark):
    rows = events(
        spark,
        event(1, "V1", "on_trip", trip="T1", fare=10.0),
        event(2, "V1", "idle", trip="T1", fare=210.0),
        event(3, "V1", "on_trip", trip="T2", fare=5.0),
        event(4, "V1", "enroute", trip="T3", fare=0.0),
        event(5, "V1", "on_trip", trip="", fare=99.0),
    )
    row = earnings.daily_earnings(rows).first()
    assert (float(row.earnings), row.trip_count) == (215.0, 2)


def test_unreconciled_vehicles_send_no_side_whole(spark):
    day = dt.date(2024, 1, 1)
    earned = spark.createDataFrame(
        [(day, "V1", 5.0), (day, "V2", 6.0), (day, None, 7.0), (dt.date(2024, 2, 1), "V1", 8.0)],
        "report_date date, vehicle_id string, earnings double",
    )
    filed = given_tables.each_day(spark.createDataFrame([("V1",), ("V1",), (None,)], "vehicle_id string"))
    missing = earnings.unreconciled_vehicles(filed, earned)
    assert {tuple(r) for r in missing.collect()} == {(day, "V2", 6.0), (day, None, 7.0), (dt.date(2024, 2, 1), "V1", 8.0)}
    plan = missing._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan


def test_trip_ends_when_its_newest_row_is_idle(spark):
    rows = events(
        spark,
        event(1, trip="T1", status="enroute", speed=20.0),
        event(2, trip="T1", status="on_trip", speed=40.0, fare=9.0),
        event(3, trip="T1", status="idle", fare=12.0),
        event(4, trip="T2", status="on_trip", speed=10.0),
    )
    got = {r.trip_id: r for r in trips.trip_analytics(rows).collect()}
    assert (got["T1"].trip_status, got["T1"].end_time, got["T1"].avg_speed) == ("completed", at(10, 3), 30.0)
    assert (got["T2"].trip_status, got["T2"].end_time, got["T2"].final_fare) == ("on_trip", None, 0.0)


def test_rule_violations(spark):
    rows = events(spark, event(1, speed=-1.0), event(1, status="offline"), event(2, lat=None))
    found = {r.rule: r.violations for r in quality.rule_violations(rows, quality.telemetry_rules(), ["event_id"]).collect()}
    broken = {rule: n for rule, n in found.items() if n}
    assert broken == {"speed >= 0": 1, "status in idle|enroute|on_trip": 1, "lat not null": 1, "event_id unique": 1}


def test_alert_limit_is_checked(spark):
    for bad in (0, 501):
        with pytest.raises(ValueError):
            serving.recent_alerts(spark.range(1), bad)
