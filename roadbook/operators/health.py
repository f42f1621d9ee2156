"""Health of the feed per interval."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from roadbook.contract import (
    HEALTHY_MESSAGE,
    NO_DATA_BATCHES,
    NO_DATA_MESSAGE,
    PARSE_EMPTY_MESSAGE,
    STARTING_MESSAGE,
    WAITING_MESSAGE,
)
from roadbook.operators.clean import with_reject_reason
from roadbook.operators.running import with_running_max
from roadbook.session import written_once

INTERVALS_PER_CHUNK = 100_000
FIRST_DAY = dt.date(2000, 1, 1)  # no telemetry is older


def _interval(arrival: str, interval_seconds: int) -> Column:
    return F.floor(F.unix_seconds(F.col(arrival).cast("timestamp")) / F.lit(interval_seconds))


def _counts() -> list[Column]:
    valid = F.col("reject_reason").isNull()
    return [
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(valid).alias("valid_rows"),
        F.max(F.when(valid, F.col("event_ts"))).alias("last_event_ts"),
    ]


def batch_counts(events: DataFrame) -> DataFrame:
    """Raw rows, valid rows and newest valid event of one batch, as one row."""
    return with_reject_reason(events).agg(*_counts())


def interval_counts(events: DataFrame, interval_seconds: int, arrival: str = "event_ts") -> DataFrame:
    """The same figures per interval that has any row; ``arrival`` says when a row came in."""
    interval = _interval(arrival, interval_seconds).alias("interval_id")
    return with_reject_reason(events).groupBy(interval).agg(*_counts())


def _days(bounds: DataFrame) -> DataFrame:
    """Every day from the column ``first`` to the column ``last``, in days since 1970."""
    return bounds.where("first IS NOT NULL").select(F.explode(F.sequence("first", "last")).alias("day"))


def grid_of_days(bounds: DataFrame, interval_seconds: int) -> DataFrame:
    """Every interval of the days between ``first`` and ``last``, whether or not it holds rows.

    The grid is spanned in two steps, days and then the intervals of a day, so that no
    task builds the whole of it.
    """
    if 86_400 % interval_seconds:
        raise ValueError("the interval must divide a day evenly")
    per_day = 86_400 // interval_seconds
    return (
        _days(bounds)
        .repartition("day")
        .select(F.explode(F.sequence(F.lit(0), F.lit(per_day - 1))).alias("slot"), "day")
        .select((F.col("day") * F.lit(per_day) + F.col("slot")).cast("bigint").alias("interval_id"))
    )


def plausible(arrival: str = "event_ts", until: dt.date | None = None) -> Column:
    """Whether a time can be an arrival: neither missing, nor before ``FIRST_DAY``, nor after ``until``, by default tomorrow."""
    last = F.lit(until) if until else F.date_add(F.current_date(), 1)
    return F.coalesce(F.to_date(arrival).between(F.lit(FIRST_DAY), last), F.lit(False))


def outside(events: DataFrame, arrival: str = "event_ts", until: dt.date | None = None) -> DataFrame:
    """Rows without a plausible arrival, which the grid of intervals has no place for."""
    return events.where(~plausible(arrival, until))


def outside_counts(events: DataFrame, arrival: str = "event_ts", until: dt.date | None = None) -> DataFrame:
    """All rows and those without an arrival, before and after the plausible days, as one row."""
    known, inside = F.col(arrival).isNotNull(), plausible(arrival, until)
    early = F.to_date(arrival) < F.lit(FIRST_DAY)
    return events.agg(
        F.count(F.lit(1)).alias("raw_rows"),
        F.count_if(~known).alias("undated_rows"),
        F.count_if(known & ~inside & early).alias("early_rows"),
        F.count_if(known & ~inside & ~early).alias("late_rows"),
    )


def classify_intervals(counts: DataFrame, no_data_after: int = NO_DATA_BATCHES) -> DataFrame:
    """Add the run length of empty intervals, a status and a message.

    ``counts`` holds one row per interval, ``interval_id`` rising by 1, with ``raw_rows``
    and ``valid_rows``. The run of empty intervals is the distance to the last interval
    with rows, or to the place before the first interval.
    """
    current = F.col("interval_id")
    seen = with_running_max(
        counts,
        current,
        F.floor(current / F.lit(INTERVALS_PER_CHUNK)),
        {"_filled": F.when(F.col("raw_rows") > 0, current), "_minus_first": -current},
    )
    streak = current - F.coalesce("_filled", -F.col("_minus_first") - 1)
    status = (
        F.when(F.col("valid_rows") > 0, F.lit("HEALTHY"))
        .when(F.col("raw_rows") > 0, F.lit("PARSE_EMPTY"))
        .when(F.col("empty_streak") >= no_data_after, F.lit("NO_DATA"))
        .otherwise(F.lit("WAITING"))
    )
    message = (
        F.when(F.col("status") == "HEALTHY", F.lit(HEALTHY_MESSAGE))
        .when(F.col("status") == "PARSE_EMPTY", F.lit(PARSE_EMPTY_MESSAGE))
        .when(F.col("status") == "NO_DATA", F.format_string(NO_DATA_MESSAGE, F.col("empty_streak")))
        .otherwise(F.format_string(WAITING_MESSAGE, F.col("empty_streak")))
    )
    return (
        seen.withColumn("empty_streak", streak.cast("int"))
        .withColumn("status", status)
        .withColumn("message", message)
        .select(*counts.columns, "empty_streak", "status", "message")
    )


def batch_health(
    events: DataFrame,
    interval_seconds: int,
    no_data_after: int = NO_DATA_BATCHES,
    arrival: str = "event_ts",
    until: dt.date | None = None,
) -> DataFrame:
    """Health row of every interval of the days from the first to the last plausible arrival.

    The span follows the table. Wrong times cannot enlarge it beyond the plausible days; ``outside`` has their rows. The events
    are read once: they are counted per interval first, and the days are taken from the counts.
    """
    counts = interval_counts(events.where(plausible(arrival, until)), interval_seconds, arrival)
    counts = written_once(counts, "interval-counts")
    day = F.floor(F.col("interval_id") * interval_seconds / 86_400)
    grid = grid_of_days(counts.agg(F.min(day).alias("first"), F.max(day).alias("last")), interval_seconds)
    filled = grid.join(counts, "interval_id", "left").na.fill(0, ["raw_rows", "valid_rows"])
    return classify_intervals(written_once(filled, "intervals"), no_data_after)


def health_of_log(
    log: DataFrame, interval_seconds: int, no_data_after: int, until: dt.datetime
) -> DataFrame:
    """Health per interval from the first logged batch up to ``until``.

    An interval in which no batch ran is an empty one, so the state of a silent feed can be
    read at any time although no batch reports it.
    """
    slot = _interval("processed_at", interval_seconds).alias("interval_id")
    counts = log.groupBy(slot).agg(
        F.sum("raw_rows").alias("raw_rows"),
        F.sum("valid_rows").alias("valid_rows"),
        F.max("last_event_ts").alias("last_event_ts"),
        F.max("batch_id").alias("last_batch_id"),
    )
    ends = log.select("processed_at").union(log.sparkSession.range(1).select(F.lit(until).cast("timestamp")))
    bounds = ends.agg(F.min("processed_at").alias("processed_at")).union(ends.agg(F.max("processed_at")))
    day = _interval("processed_at", 86_400)
    grid = grid_of_days(bounds.agg(F.min(day).alias("first"), F.max(day).alias("last")), interval_seconds)
    span = bounds.agg(
        F.min(_interval("processed_at", interval_seconds)).alias("first_id"),
        F.max(_interval("processed_at", interval_seconds)).alias("last_id"),
    )
    inside = grid.where(
        F.col("interval_id").between(span.select("first_id").scalar(), span.select("last_id").scalar())
    )
    filled = inside.join(counts, "interval_id", "left").na.fill(0, ["raw_rows", "valid_rows"])
    return classify_intervals(filled, no_data_after)


def no_data_alerts(health: DataFrame, no_data_after: int = NO_DATA_BATCHES) -> DataFrame:
    """One CRITICAL alert per run of empty intervals, raised when the run gets long enough."""
    return health.where(F.col("empty_streak") == no_data_after).select(
        F.lit("NO_DATA").alias("alert_type"),
        F.lit(None).cast("string").alias("vehicle_id"),
        F.lit(None).cast("string").alias("driver_id"),
        F.lit(None).cast("string").alias("zone_id"),
        F.lit(None).cast("decimal(10,2)").alias("idle_minutes"),
        F.lit("CRITICAL").alias("severity"),
        "message",
        "interval_id",
    )


def health_latest(health: DataFrame) -> DataFrame:
    """The newest health row."""
    return health.orderBy(F.col("interval_id").desc()).limit(1)


def health_now(health: DataFrame) -> DataFrame:
    """The newest health row, or a STARTING row while there is none."""
    starting = health.sparkSession.range(1).select(
        F.lit("STARTING").alias("status"), F.lit(STARTING_MESSAGE).alias("message"), F.lit(0).alias("empty_streak")
    )
    every = health.unionByName(starting, allowMissingColumns=True)
    return every.orderBy(F.col("interval_id").desc_nulls_last()).limit(1)
