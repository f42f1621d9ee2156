"""Newest row per vehicle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sequence(events: DataFrame) -> Column:
    """Tie-break among equal event times: the event id when the frame carries one."""
    return F.col("event_id") if "event_id" in events.columns else F.lit(0).cast("bigint")


def latest_by_key(rows: DataFrame, keys: list[str], *newest_first: Column) -> DataFrame:
    """One row per key, the first in the given order.

    Spark limits each map task to its best row per key before the shuffle, so a key
    that holds a large share of the rows sends one row per task.
    """
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*newest_first))
    return rows.withColumn("_place", place).where("_place = 1").drop("_place")


def latest_per_vehicle(events: DataFrame) -> DataFrame:
    return latest_by_key(events, ["vehicle_id"], F.col("event_ts").desc(), sequence(events).desc())
