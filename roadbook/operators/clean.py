"""Parsing, cleaning and enrichment of telemetry events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadbook.contract import CITY, MONEY, SILVER_COLUMNS, TELEMETRY, Grid
from roadbook.functions import clock, geo, values


def parse_telemetry(raw: DataFrame) -> DataFrame:
    """Message envelope (``value`` bytes, ``timestamp``) to typed columns plus ``kafka_ts``.

    A document that is no JSON gives a row of nulls, a field of the wrong type gives
    a null field; both are rejected or filled later, neither stops the stream. Further
    envelope columns (offsets, ids) are passed on.
    """
    extra = [c for c in raw.columns if c not in ("value", "timestamp")]
    event = F.from_json(F.col("value").cast("string"), TELEMETRY)
    return raw.select(event.alias("event"), F.col("timestamp").alias("kafka_ts"), *extra).select(
        "event.*", "kafka_ts", *extra
    )


def _event_time(events: DataFrame) -> Column:
    """Typed event time if the frame has it, else the text form, null when unreadable."""
    if "event_ts" in events.columns:
        return F.col("event_ts")
    return F.try_to_timestamp(F.col("timestamp"))


def _normalised(events: DataFrame) -> DataFrame:
    """Event columns with trimmed ids, lower-case status and a typed event time."""
    kept = [c for c in events.columns if c not in ("timestamp", "event_ts")]
    rewritten = {
        "vehicle_id": F.trim("vehicle_id"),
        "driver_id": F.trim("driver_id"),
        "status": values.status_text(F.col("status")),
    }
    return events.select(
        *[rewritten[c].alias(c) if c in rewritten else F.col(c) for c in kept],
        _event_time(events).alias("event_ts"),
    )


def _reject_reason() -> Column:
    """First rule a normalised row breaks, null for a good row."""
    return (
        F.when(~values.present(F.col("vehicle_id")), F.lit("blank_vehicle"))
        .when(F.col("event_ts").isNull(), F.lit("bad_event_time"))
        .when(~F.coalesce(values.known_status(F.col("status")), F.lit(False)), F.lit("unknown_status"))
        .when(~values.measurable(F.col("fare").cast("double")), F.lit("bad_fare"))
        .when(~values.measurable(F.col("speed").cast("double")), F.lit("bad_speed"))
    )


def with_reject_reason(events: DataFrame) -> DataFrame:
    """Normalised rows, good and bad, with the first rule broken in ``reject_reason``."""
    return _normalised(events).withColumn("reject_reason", _reject_reason())


def clean_telemetry(events: DataFrame, grid: Grid = CITY) -> DataFrame:
    """Rows with a vehicle, a time, a known status and numbers that can be measurements;
    missing numbers filled, position clamped."""
    good = with_reject_reason(events).where(F.col("reject_reason").isNull()).drop("reject_reason")
    filled = {
        "lat": geo.clamp(F.col("lat").cast("double"), grid.min_lat, grid.max_lat),
        "lon": geo.clamp(F.col("lon").cast("double"), grid.min_lon, grid.max_lon),
        "speed": F.coalesce(F.col("speed").cast("double"), F.lit(0.0)),
        "fare": F.coalesce(F.col("fare").cast("double"), F.lit(0.0)),
    }
    return good.select(*[filled[c].alias(c) if c in filled else F.col(c) for c in good.columns])


def assign_zone(
    cleaned: DataFrame, grid: Grid = CITY, local_zone: str | None = None, null_zone: bool = False
) -> DataFrame:
    """Add ``zone_id`` and ``time_of_day``."""
    return cleaned.select(
        "*",
        geo.zone_id(F.col("lat"), F.col("lon"), grid, null_zone).alias("zone_id"),
        clock.time_of_day(F.col("event_ts"), local_zone).alias("time_of_day"),
    )


def silver(
    events: DataFrame, grid: Grid = CITY, local_zone: str | None = None, null_zone: bool = False
) -> DataFrame:
    """Clean, zone-tagged events in table layout; the id column is kept when there is one."""
    enriched = assign_zone(clean_telemetry(events, grid), grid, local_zone, null_zone)
    ids = [c for c in ("event_id",) if c in enriched.columns]
    return enriched.select(*ids, *SILVER_COLUMNS)


def reject_reasons(events: DataFrame) -> DataFrame:
    """Rows per outcome: ``accepted`` or the first rule broken."""
    return (
        with_reject_reason(events)
        .select(F.coalesce("reject_reason", F.lit("accepted")).alias("reason"))
        .groupBy("reason")
        .agg(F.count(F.lit(1)).alias("row_count"))
    )


def out_of_bounds_counts(events: DataFrame, grid: Grid = CITY) -> DataFrame:
    """Positions inside and outside the box per status, before clamping."""
    inside = geo.in_bounds(F.col("lat"), F.col("lon"), grid)
    return (
        events.select(values.status_text(F.col("status")).alias("status"), inside.alias("inside"))
        .groupBy("status")
        .agg(
            F.count(F.lit(1)).alias("row_count"),
            F.count_if("inside").alias("inside_rows"),
            F.count_if(~F.col("inside")).alias("outside_rows"),
        )
    )


def clean_expenses(expenses: DataFrame) -> DataFrame:
    """Trimmed id, costs as money with 0 for missing ones, text flag as boolean."""
    cleaned = {
        "vehicle_id": F.trim("vehicle_id"),
        "fuel_cost": F.coalesce(values.money(F.col("fuel_cost")), F.lit(0)).cast(MONEY),
        "maintenance_cost": F.coalesce(values.money(F.col("maintenance_cost")), F.lit(0)).cast(MONEY),
        "distance_covered": F.coalesce(F.col("distance_covered").try_cast("double"), F.lit(0.0)),
        "service_flag": F.coalesce(values.truthy(F.col("service_flag")), F.lit(False)),
    }
    return expenses.select(*[cleaned[c].alias(c) if c in cleaned else F.col(c) for c in expenses.columns])
