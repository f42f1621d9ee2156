"""Measures that several figures share: what a row says about its vehicle or trip, and how those are counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadbook.contract import IDLE, MONEY, ON_TRIP
from roadbook.functions import values

def _says() -> dict[str, tuple[str, Column | None]]:
    """What a row says of an id: count name -> (id counted, condition on the row)."""
    idle = F.col("status") == F.lit(IDLE)
    return {
        "total_vehicles": ("vehicle_id", None),
        "active_vehicles": ("vehicle_id", ~idle),
        "idle_vehicles": ("vehicle_id", idle),
        "trips_in_window": ("trip_id", F.col("status") == F.lit(ON_TRIP)),
    }


def counted_ids(of: str | None = None) -> list[str]:
    """Names of the distinct counts, of one id column or of all."""
    return [name for name, (id_column, _) in _says().items() if of in (None, id_column)]


def with_marked_ids(events: DataFrame, *kept: Column | str) -> DataFrame:
    """The kept columns, and per distinct count the id where the row counts for it, else null."""
    marked = [
        (F.col(id_column) if condition is None else F.when(condition, F.col(id_column))).alias(name)
        for name, (id_column, condition) in _says().items()
    ]
    return events.select(*kept, *marked)


def ever(name: str) -> Column:
    """Whether any row of a group counts for ``name``."""
    condition = _says()[name][1]
    return F.lit(True) if condition is None else F.max(condition)


def rows_of_newest() -> list[Column]:
    """Figures of a set of vehicles from one row per vehicle."""
    by_status = [
        (F.count(F.lit(1)) if _says()[name][1] is None else F.count_if(_says()[name][1])).alias(name)
        for name in counted_ids("vehicle_id")
    ]
    span = [F.min("event_ts").alias("window_start"), F.max("event_ts").alias("window_end")]
    return [*by_status, F.avg("speed").alias("avg_speed"), F.count(F.lit(1)).alias("event_count"), *span]


def fare_sum(fare: Column) -> Column:
    return F.coalesce(F.sum(values.money(fare)), F.lit(0)).cast(MONEY)
