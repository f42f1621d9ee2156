"""Read queries over the result tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.contract import ALERTS_DEFAULT, ALERTS_MAX


def profit_by_date(profitability: DataFrame, report_date: dt.date) -> DataFrame:
    """All vehicles of one date, best first. The date filter prunes partitions."""
    return profitability.where(F.col("report_date") == F.lit(report_date)).orderBy(
        F.col("profit").desc(), "vehicle_id"
    )


def profit_latest(profitability: DataFrame) -> DataFrame:
    """All vehicles of the newest date, best first."""
    newest = profitability.select(F.max("report_date")).scalar()
    return profitability.where(F.col("report_date") == newest).orderBy(F.col("profit").desc(), "vehicle_id")


def vehicle_profit_on(profitability: DataFrame, vehicle_id: str, report_date: dt.date) -> DataFrame:
    return profitability.where(
        (F.col("vehicle_id") == F.lit(vehicle_id)) & (F.col("report_date") == F.lit(report_date))
    )


def vehicle_profit_latest(profitability: DataFrame, vehicle_id: str | None = None) -> DataFrame:
    """Newest row of one vehicle, or of every vehicle when none is named."""
    if vehicle_id is not None:
        rows = profitability.where(F.col("vehicle_id") == F.lit(vehicle_id))
        return rows.orderBy(F.col("report_date").desc()).limit(1)
    columns = profitability.columns
    row = F.max_by(F.struct(*columns), "report_date").alias("row")
    return profitability.groupBy("vehicle_id").agg(row).select("row.*")


def loss_leaders(profitability: DataFrame, limit: int | None = None) -> DataFrame:
    """Report by profit, worst first; the first ``limit`` rows when one is given."""
    ordered = profitability.orderBy("profit", "report_date", "vehicle_id")
    return ordered if limit is None else ordered.limit(limit)


def zones_by_exposure(zones: DataFrame) -> DataFrame:
    return zones.orderBy(F.col("live_fare_exposure").desc(), "zone_id", "time_of_day")


def vehicle_status(states: DataFrame) -> DataFrame:
    return states.orderBy("vehicle_id")


def recent_alerts(alerts: DataFrame, limit: int = ALERTS_DEFAULT) -> DataFrame:
    """The newest ``limit`` alerts."""
    if not 1 <= limit <= ALERTS_MAX:
        raise ValueError(f"limit must lie between 1 and {ALERTS_MAX}")
    return alerts.orderBy(F.col("created_at").desc(), F.col("vehicle_id").asc_nulls_first()).limit(limit)
