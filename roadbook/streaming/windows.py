"""Event-time window metrics on a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadbook.contract import METRICS_WINDOW, WATERMARK, ZONE_WINDOWS
from roadbook.operators import measures
from roadbook.operators.windows import ZONE_KEYS, counted_units, unit_sums, window_rates, zone_windows_approx
from roadbook.sinks import files, tables
from roadbook.sources import logs

WINDOW_KEYS = ["window_start", *ZONE_KEYS]


def live_zone_windows(silver: DataFrame, watermark: str = WATERMARK, length: str = METRICS_WINDOW) -> DataFrame:
    """Running window figures for update mode; rows behind the watermark are left out."""
    return zone_windows_approx(silver.withWatermark("event_ts", watermark), length)


def final_zone_windows(silver: DataFrame, watermark: str = WATERMARK, length: str = METRICS_WINDOW) -> DataFrame:
    """Exact window figures for append mode, given out once when the window has closed.

    Two stateful steps: one state row per vehicle and per trip of a window, then the count
    of those rows. No state row grows with the number of vehicles.
    """
    units = F.array(
        F.struct(F.lit(True).alias("by_vehicle"), F.col("vehicle_id").alias("id")),
        F.struct(F.lit(False).alias("by_vehicle"), F.col("trip_id").alias("id")),
    )
    unit = (
        silver.withWatermark("event_ts", watermark)
        .select("event_ts", *ZONE_KEYS, "status", "speed", "fare", F.inline(units))
        .where("id IS NOT NULL")
        .groupBy(F.window("event_ts", length), *ZONE_KEYS, "by_vehicle", "id")
        .agg(*[measures.ever(name).alias(name) for name in measures.counted_ids()], *unit_sums())
    )
    again = F.window(F.window_time("window"), length).alias("window")
    return window_rates(counted_units(unit, [again, *ZONE_KEYS], F.lit(True)))


def write_window_batch(batch: DataFrame, batch_id: int, path: str, run: str = tables.FIRST_RUN) -> None:
    """Changed windows of one micro-batch, logged by day and batch."""
    rows = tables.finalise(batch, ZONE_WINDOWS).withColumn("window_date", F.to_date("window_start"))
    tables.append_batch(rows, path, batch_id, "window_date", run=run)


def read_windows(spark, path: str) -> DataFrame:
    """The window table: newest figures per window, zone and part of day."""
    log = logs.read_log(spark, path, ZONE_WINDOWS, "window_date")
    return tables.current(log, WINDOW_KEYS).drop("window_date")


def start_windows(
    windows: DataFrame, path: str, checkpoint: str, trigger: dict, output_mode: str = "update"
) -> StreamingQuery:
    run = files.run_of(windows.sparkSession, checkpoint)
    return (
        windows.writeStream.outputMode(output_mode)
        .foreachBatch(lambda batch, batch_id: write_window_batch(batch, batch_id, path, run))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .queryName("zone_windows")
        .start()
    )
