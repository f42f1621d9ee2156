"""Trip and day summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadbook.contract import IDLE, MONEY
from roadbook.functions import clock, values
from roadbook.operators.latest import sequence


def _moving_speed() -> Column:
    return F.when(F.col("status") != F.lit(IDLE), F.col("speed"))


def _of_each_ending(silver: DataFrame, *keys: Column) -> DataFrame:
    """Figures per trip and per driver, vehicle and status seen on it, with the newest row as one number.

    All aggregates are numbers, so rows are hashed and combined before the shuffle, not sorted; a
    trip leaves a few rows. Time and id make one decimal, time first.
    """
    place = clock.micros(F.col("event_ts")).cast("decimal(38,0)") * F.lit(2**62).cast("decimal(19,0)") + sequence(silver)
    return (
        silver.where(values.present(F.col("trip_id")))
        .select(*keys, "trip_id", "driver_id", "vehicle_id", "status", "fare", "event_ts", _moving_speed().alias("moving"), place.cast("decimal(38,0)").alias("place"))
        .groupBy(*_names(keys), "trip_id", "driver_id", "vehicle_id", "status")
        .agg(
            F.max("place").alias("place"),
            F.max("event_ts").alias("last_time"),
            F.min("event_ts").alias("start_time"),
            F.max("fare").alias("fare"),
            F.sum("moving").alias("speed_sum"),
            F.count("moving").alias("speed_rows"),
            F.max("moving").alias("max_speed"),
        )
    )


def _newest(column: str) -> Column:
    return F.max_by(column, "place").alias(column)


def _names(keys: tuple[Column, ...]) -> list[str]:
    return ["summary_date"] if keys else []


def trip_analytics(silver: DataFrame) -> DataFrame:
    """One row per trip.

    Driver, vehicle and status come from the trip's newest row; a trip that ends idle is
    completed and has an end time. Speeds are taken over moving rows.
    """
    trips = (
        _of_each_ending(silver)
        .groupBy("trip_id")
        .agg(
            *[_newest(c) for c in ("driver_id", "vehicle_id", "status", "last_time")],
            (F.sum("speed_sum") / F.sum("speed_rows")).alias("avg_speed"),
            F.max("max_speed").alias("max_speed"),
            F.max("fare").alias("final_fare"),
            F.min("start_time").alias("start_time"),
        )
    )
    done = F.col("status") == F.lit(IDLE)
    return trips.select(
        "trip_id",
        "driver_id",
        "vehicle_id",
        F.coalesce("avg_speed", F.lit(0.0)).alias("avg_speed"),
        F.coalesce("max_speed", F.lit(0.0)).alias("max_speed"),
        "final_fare",
        F.when(done, F.lit("completed")).otherwise(F.col("status")).alias("trip_status"),
        "start_time",
        F.when(done, F.col("last_time")).alias("end_time"),
    )


def daily_summary(silver: DataFrame, expenses: DataFrame) -> DataFrame:
    """Trips, speed, revenue, costs and net per date that has trips or expenses."""
    trips = (
        _of_each_ending(silver, F.to_date("event_ts").alias("summary_date"))
        .groupBy("summary_date", "trip_id")
        .agg(
            _newest("status"),
            F.max("fare").alias("fare"),
            F.sum("speed_sum").alias("speed_sum"),
            F.sum("speed_rows").alias("speed_rows"),
        )
    )
    zero = F.lit(0).cast(MONEY)
    revenue = trips.groupBy("summary_date").agg(
        F.count(F.lit(1)).alias("total_trips"),
        F.count_if(F.col("status") == F.lit(IDLE)).alias("completed_trips"),
        values.ratio(F.sum("speed_sum"), F.sum("speed_rows")).alias("average_speed"),
        F.sum(values.money(F.col("fare"))).alias("total_revenue"),
    )
    costs = expenses.groupBy(F.col("report_date").alias("summary_date")).agg(
        F.sum(F.col("fuel_cost") + F.col("maintenance_cost")).alias("total_expenses")
    )
    both = revenue.join(costs, "summary_date", "full_outer")
    return both.select(
        "summary_date",
        F.coalesce("total_trips", F.lit(0)).alias("total_trips"),
        F.coalesce("completed_trips", F.lit(0)).alias("completed_trips"),
        F.coalesce("average_speed", F.lit(0.0)).alias("average_speed"),
        F.coalesce("total_revenue", zero).alias("total_revenue"),
        F.coalesce("total_expenses", zero).alias("total_expenses"),
        (F.coalesce("total_revenue", zero) - F.coalesce("total_expenses", zero)).alias("net_revenue"),
    )
