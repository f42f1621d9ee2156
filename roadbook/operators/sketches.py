"""Window figures that can be added up: short windows with sketches, united to any longer window without the events.

Of each short window the sketches of its distinct ids and plain sums are kept. Sketches of the same ids unite to the sketch
of both, so hours and days come from stored minutes, and partial rows of one window, from several batches or of rows that
came late, are united like any others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.contract import METRICS_WINDOW
from roadbook.functions import clock
from roadbook.operators import measures
from roadbook.operators.windows import FRAME, ZONE_KEYS, window_rates

SKETCH_BITS = 12
# relative standard deviation of a united sketch of 2^12 registers
UNION_DEVIATION = 1.04 / 2 ** (SKETCH_BITS / 2)


def window_sketches(events: DataFrame, length: str = METRICS_WINDOW) -> DataFrame:
    """One row per window, zone and part of day that has events."""
    frame = [F.window("event_ts", length).alias("window"), *ZONE_KEYS]
    marked = measures.with_marked_ids(events, *frame, "speed", "fare")
    sketches = [F.hll_sketch_agg(name, SKETCH_BITS).alias(name) for name in measures.counted_ids()]
    sums = [
        F.sum("speed").alias("speed_sum"),
        F.count("speed").alias("speed_rows"),
        F.max("fare").alias("live_fare_exposure"),
        F.count("window").alias("event_count"),
    ]
    rows = marked.groupBy(*FRAME).agg(*sketches, *sums)
    return rows.select("window.start", "window.end", *[c for c in rows.columns if c != "window"]).withColumnsRenamed(
        {"start": "window_start", "end": "window_end"}
    )


def united_windows(sketches: DataFrame, length: str, parts: str = METRICS_WINDOW) -> DataFrame:
    """Figures of windows of ``length`` from rows of windows of ``parts``, of which it must be a multiple."""
    if clock.length_seconds(length) % clock.length_seconds(parts):
        raise ValueError(f"windows of {length} cannot be put together from windows of {parts}")
    frame = [F.window("window_start", length).alias("window"), *ZONE_KEYS]
    united = [F.hll_sketch_estimate(F.hll_union_agg(name)).alias(name) for name in measures.counted_ids()]
    sums = [
        (F.sum("speed_sum") / F.sum("speed_rows")).alias("avg_speed"),
        F.max("live_fare_exposure").alias("live_fare_exposure"),
        F.sum("event_count").alias("event_count"),
    ]
    return window_rates(sketches.groupBy(*frame).agg(*united, *sums))
