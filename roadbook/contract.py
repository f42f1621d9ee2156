"""Schemas, value domains and defaults that every operator shares."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class Grid:
    """A latitude/longitude box cut into ``cells`` x ``cells`` zones."""

    min_lat: float
    max_lat: float
    min_lon: float
    max_lon: float
    cells: int


# Stored results depend on them, so they must not drift.
STATUSES = ("idle", "enroute", "on_trip")
CITY = Grid(min_lat=6.85, max_lat=7.00, min_lon=79.80, max_lon=79.95, cells=3)
DAY_PARTS = (("morning", 5, 12), ("afternoon", 12, 17), ("evening", 17, 21))
DAY_PART_DEFAULT = "night"
TRUE_WORDS = ("true", "t", "1", "yes", "y")
EXPENSE_COLUMNS = (
    "vehicle_id",
    "fuel_cost",
    "maintenance_cost",
    "distance_covered",
    "service_flag",
)
WATERMARK = "2 minutes"
METRICS_WINDOW = "1 minute"
TRIGGER_SECONDS = 10
IDLE_THRESHOLD_MINUTES = 5.0
NO_DATA_BATCHES = 12
ALERTS_DEFAULT, ALERTS_MAX = 50, 500

# Texts that readers of the alert and health tables match on.
IDLE_MESSAGE = "%s idle for %s minutes (threshold %.0fm)"
HEALTHY_MESSAGE = "streaming batch processed"
PARSE_EMPTY_MESSAGE = "kafka messages did not parse into valid telemetry"
NO_DATA_MESSAGE = "no telemetry for %d consecutive batches"
WAITING_MESSAGE = "empty batch streak=%d"
STARTING_MESSAGE = "waiting for first streaming batch"

IDLE = "idle"
ON_TRIP = "on_trip"

# Sums of money over any number of trips, and single amounts of any size that cleaning lets pass.
MONEY = T.DecimalType(28, 2)
# Fares and speeds at or beyond this are no measurements; such rows are rejected and counted.
NUMBER_LIMIT = 1e12

_TEXT, _REAL, _TIME, _DAY = T.StringType(), T.DoubleType(), T.TimestampType(), T.DateType()
_COUNT, _FLAG = T.LongType(), T.BooleanType()
_SPEED, _RATIO, _MINUTES = T.DecimalType(18, 2), T.DecimalType(8, 4), T.DecimalType(18, 2)


def _may_be_null(**fields: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind, True) for name, kind in fields.items()]


def _not_null(**fields: T.DataType) -> list[T.StructField]:
    return [T.StructField(name, kind, False) for name, kind in fields.items()]


def _table(*groups: list[T.StructField]) -> T.StructType:
    return T.StructType([field for group in groups for field in group])


# The fields of one telemetry message as it arrives, all of them optional.
TELEMETRY = _table(
    _may_be_null(
        trip_id=_TEXT,
        driver_id=_TEXT,
        vehicle_id=_TEXT,
        lat=_REAL,
        lon=_REAL,
        speed=_REAL,
        status=_TEXT,
        fare=_REAL,
        timestamp=_TEXT,
    )
)

# Column names of the result tables and which of them must hold a value. NOT NULL
# numbers and flags that are missing are stored as 0 and false; all sums and counts are wide
# enough for any number of rows.
SILVER_COLUMNS = (
    "trip_id",
    "driver_id",
    "vehicle_id",
    "lat",
    "lon",
    "speed",
    "status",
    "fare",
    "event_ts",
    "zone_id",
    "time_of_day",
)
SILVER = _table(
    _may_be_null(event_id=_COUNT, trip_id=_TEXT, driver_id=_TEXT, vehicle_id=_TEXT, lat=_REAL, lon=_REAL, speed=_REAL),
    _may_be_null(status=_TEXT, fare=_REAL, event_ts=_TIME, zone_id=_TEXT, time_of_day=_TEXT, ingested_at=_TIME),
)
FLEET_SNAPSHOT = _table(
    _may_be_null(window_start=_TIME, window_end=_TIME),
    _not_null(active_vehicles=_COUNT, idle_vehicles=_COUNT, total_vehicles=_COUNT, idle_ratio=_RATIO),
    _not_null(trips_in_window=_COUNT, trips_per_hour=MONEY),
    _may_be_null(avg_speed=_SPEED),
    _not_null(live_fare_exposure=MONEY, event_count=_COUNT),
    _may_be_null(updated_at=_TIME),
)
ZONE_SNAPSHOT = _table(
    _may_be_null(zone_id=_TEXT, time_of_day=_TEXT, window_start=_TIME, window_end=_TIME),
    _not_null(active_vehicles=_COUNT, trips_in_window=_COUNT),
    _may_be_null(avg_speed=_SPEED),
    _not_null(live_fare_exposure=MONEY, event_count=_COUNT),
    _may_be_null(updated_at=_TIME),
)
ZONE_WINDOWS = _table(
    _may_be_null(window_start=_TIME, window_end=_TIME, zone_id=_TEXT, time_of_day=_TEXT),
    _not_null(active_vehicles=_COUNT, idle_vehicles=_COUNT, idle_ratio=_RATIO),
    _not_null(trips_in_window=_COUNT, trips_per_hour=MONEY),
    _may_be_null(avg_speed=_SPEED),
    _not_null(live_fare_exposure=MONEY, event_count=_COUNT),
    _may_be_null(computed_at=_TIME),
)
VEHICLE_STATE = _table(
    _may_be_null(vehicle_id=_TEXT, driver_id=_TEXT, status=_TEXT, zone_id=_TEXT, lat=_REAL, lon=_REAL),
    _may_be_null(idle_since=_TIME, last_event_ts=_TIME),
    _not_null(idle_alert_sent=_FLAG),
    _may_be_null(updated_at=_TIME),
)
ALERTS = _table(
    _may_be_null(alert_type=_TEXT, vehicle_id=_TEXT, driver_id=_TEXT, zone_id=_TEXT, idle_minutes=_MINUTES),
    _may_be_null(severity=_TEXT, message=_TEXT, created_at=_TIME),
)
HEALTH_LOG = _table(
    _not_null(raw_rows=_COUNT, valid_rows=_COUNT, stale_rows=_COUNT),
    _may_be_null(last_event_ts=_TIME, processed_at=_TIME),
)
PROFITABILITY = _table(
    _may_be_null(report_date=_DAY, vehicle_id=_TEXT),
    _not_null(trip_count=_COUNT, earnings=MONEY, fuel_cost=MONEY, maintenance_cost=MONEY),
    _not_null(distance_covered=MONEY, service_flag=_FLAG, profit=MONEY, unprofitable=_FLAG),
    _may_be_null(computed_at=_TIME),
)
PROGRESS = _table(
    _may_be_null(event=_TEXT, query_id=_TEXT, query_name=_TEXT, trigger_id=_COUNT, input_rows=_COUNT, late_rows=_COUNT),
    _may_be_null(duration_ms=_COUNT, sources=T.ArrayType(_TEXT), exception=_TEXT, at=_TIME),
)
# Partial rows of windows, one per vehicle and per trip, and the newest event time of each batch.
WINDOW_UNITS = _table(
    _may_be_null(window_start=_TIME, window_end=_TIME, zone_id=_TEXT, time_of_day=_TEXT),
    _not_null(by_vehicle=_FLAG),
    _may_be_null(id=_TEXT),
    _not_null(total_vehicles=_FLAG, active_vehicles=_FLAG, idle_vehicles=_FLAG, trips_in_window=_FLAG),
    _may_be_null(speed_sum=_REAL, fare=_REAL),
    _not_null(rows=_COUNT, late=_FLAG),
)
CLOCK = _table(_may_be_null(newest=_TIME))
# Rejected rows as they came, and up to where a date's result goes.
REJECTED = _table(
    TELEMETRY.fields,
    _may_be_null(kafka_ts=_TIME, event_id=_COUNT, reject_reason=_TEXT),
)
MARKS = _table(_may_be_null(date=_TEXT, place=_TEXT))
