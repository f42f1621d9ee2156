"""Idle streaks per vehicle and the alerts they raise.

A streak is a run of consecutive ``idle`` events of one vehicle in event order. Events are dealt into ranges of
(vehicle, time), scanned range by range and put together by one row per range (``operators/segments.py``), so a
vehicle that holds most rows lies in many ranges and no task orders more than its own. The result is the same for
every number of ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadbook.contract import IDLE, IDLE_MESSAGE, IDLE_THRESHOLD_MINUTES
from roadbook.functions import clock
from roadbook.operators.latest import latest_by_key, sequence
from roadbook.operators.segments import idle_scan
from roadbook.session import written_once

def _threshold_micros(minutes: float) -> Column:
    return F.lit(int(round(minutes * clock.MICROS_PER_MINUTE))).cast("bigint")


def _stored_rows(state: DataFrame, events: DataFrame) -> DataFrame:
    """Stored vehicle states as rows that come before all events of their vehicle."""
    time = events.schema["event_ts"].dataType
    has = {"vehicle_id": F.col("vehicle_id"), "status": F.col("status"), "event_ts": F.col("last_event_ts").cast(time)}
    return state.select(
        *[has.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name) for f in events.schema.fields],
        F.lit(0).cast("bigint").alias("_seq"),
        F.lit(True).alias("_known"),
        F.col("idle_since").cast(time).alias("_since"),
        F.coalesce("idle_alert_sent", F.lit(False)).alias("_sent"),
    )


def idle_runs(
    events: DataFrame,
    state: DataFrame | None = None,
    ranges: int | None = None,
    keep: Callable[[DataFrame], DataFrame] | None = None,
) -> DataFrame:
    """Events plus ``streak`` (start of the idle streak the row belongs to, null while
    moving), ``prev_status``, ``prev_ts`` and ``prev_stored``.

    ``state`` holds vehicle states of earlier runs; rows older than a vehicle's stored
    newest event must have been removed with ``split_stale``. ``keep`` says where the scanned rows are stored, by
    default a table in the shared folder; ``ranges`` is left to Spark unless given.
    """
    rows = events.select(
        *events.columns,
        F.coalesce(sequence(events), F.lit(0)).cast("bigint").alias("_seq"),
        F.lit(False).alias("_known"),
        F.lit(None).cast(events.schema["event_ts"].dataType).alias("_since"),
        F.lit(False).alias("_sent"),
    )
    if state is not None:
        rows = rows.union(_stored_rows(state, events))
    return idle_scan(rows, keep or (lambda df: written_once(df, "idle-scan")), ranges)


def split_stale(events: DataFrame, state: DataFrame) -> DataFrame:
    """Mark rows older than the vehicle's stored newest event in ``stale``."""
    newest = state.select("vehicle_id", F.col("last_event_ts").alias("_newest"))
    late = F.coalesce(F.col("event_ts") < F.col("_newest"), F.lit(False))
    return events.join(newest, "vehicle_id", "left").withColumn("stale", late).drop("_newest")


def _idle_span() -> Column:
    return clock.elapsed_micros(F.col("streak.ts"), F.col("event_ts"))


def idle_episodes(events: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per idle streak: start, last event seen in it, events and whole micros."""
    return episodes_from_runs(idle_runs(events, None, ranges))


def episodes_from_runs(runs: DataFrame) -> DataFrame:
    return (
        runs.where(F.col("streak").isNotNull())
        .groupBy("vehicle_id", F.col("streak.ts").alias("idle_since"), F.col("streak.seq").alias("_seq"))
        .agg(F.max("event_ts").alias("last_idle_ts"), F.count(F.lit(1)).alias("event_count"))
        .select(
            "vehicle_id",
            "idle_since",
            "last_idle_ts",
            "event_count",
            clock.elapsed_micros(F.col("idle_since"), F.col("last_idle_ts")).alias("idle_micros"),
        )
    )


def _reached(threshold_minutes: float) -> Column:
    return F.col("streak").isNotNull() & (_idle_span() >= _threshold_micros(threshold_minutes))


def alerts_from_runs(runs: DataFrame, threshold_minutes: float = IDLE_THRESHOLD_MINUTES) -> DataFrame:
    """The first row of each streak at or past the threshold, as an alert."""
    before = clock.elapsed_micros(F.col("streak.ts"), F.col("prev_ts"))
    fired_before = F.col("streak.sent") | (
        F.coalesce(F.col("prev_status") == F.lit(IDLE), F.lit(False))
        & ~F.col("prev_stored")
        & (before >= _threshold_micros(threshold_minutes))
    )
    fired = runs.where(_reached(threshold_minutes)).where(~fired_before)
    return idle_alert_rows(fired.withColumn("idle_micros", _idle_span()), threshold_minutes)


def idle_alert_rows(fired: DataFrame, threshold_minutes: float) -> DataFrame:
    """Rows with ``idle_micros`` in alert layout; an alert is dated by the event that raised it."""
    text = F.format_string(
        IDLE_MESSAGE,
        F.col("vehicle_id"),
        clock.minutes_decimal(F.col("idle_micros"), 1).cast("string"),
        F.lit(float(threshold_minutes)),
    )
    return fired.select(
        F.lit("IDLE_VEHICLE").alias("alert_type"),
        "vehicle_id",
        "driver_id",
        "zone_id",
        clock.minutes_decimal(F.col("idle_micros"), 2).alias("idle_minutes"),
        F.lit("WARNING").alias("severity"),
        text.alias("message"),
        F.col("event_ts").alias("created_at"),
    )


def idle_alerts(
    events: DataFrame, threshold_minutes: float = IDLE_THRESHOLD_MINUTES, ranges: int | None = None
) -> DataFrame:
    """One alert per idle streak, raised by its first event at or past the threshold."""
    return alerts_from_runs(idle_runs(events, None, ranges), threshold_minutes)


def states_from_runs(runs: DataFrame, threshold_minutes: float = IDLE_THRESHOLD_MINUTES) -> DataFrame:
    """Newest state per vehicle."""
    sent = F.coalesce(F.col("streak.sent"), F.lit(False)) | _reached(threshold_minutes)
    newest = latest_by_key(runs, ["vehicle_id"], F.col("event_ts").desc(), sequence(runs).desc())
    return newest.select(
        "vehicle_id",
        "driver_id",
        "status",
        "zone_id",
        "lat",
        "lon",
        F.col("streak.ts").alias("idle_since"),
        F.col("event_ts").alias("last_event_ts"),
        sent.alias("idle_alert_sent"),
    )


def vehicle_states(
    events: DataFrame, threshold_minutes: float = IDLE_THRESHOLD_MINUTES, ranges: int | None = None
) -> DataFrame:
    return states_from_runs(idle_runs(events, None, ranges), threshold_minutes)
