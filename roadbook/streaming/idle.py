"""Idle alerts with per-vehicle state, event by event."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from roadbook.contract import IDLE, IDLE_THRESHOLD_MINUTES, WATERMARK
from roadbook.functions.clock import MICROS_PER_MINUTE, micros
from roadbook.operators.idle import idle_alert_rows
from roadbook.operators.latest import sequence

STATE_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_STREAK = "last_ts BIGINT, last_status_idle BOOLEAN, idle_since BIGINT, sent BOOLEAN"
_ROW = "ts BIGINT, seq BIGINT, idle BOOLEAN, driver_id STRING, zone_id STRING"
_COLUMNS = ["ts", "seq", "idle", "driver_id", "zone_id"]
_OUTPUT = "vehicle_id STRING, driver_id STRING, zone_id STRING, ts BIGINT, idle_micros BIGINT"

# the processor travels with the query, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class IdleWatch(StatefulProcessor):
    """Raises one alert per idle streak and remembers the open streak of each vehicle.

    A vehicle's rows are held until the watermark has passed them and are then applied in event order, so
    neither their order of arrival nor the cut into micro-batches matters. Between batches a
    vehicle keeps its held rows, as many as it sends within the watermark's delay, and five numbers. A batch
    appends its rows; the rows held are read only when some of them are due.
    Rows behind the watermark are dropped by Spark, which counts them in the query's progress.
    """

    def __init__(self, threshold_minutes: float) -> None:
        self._threshold = int(round(threshold_minutes * MICROS_PER_MINUTE))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._state = handle.getValueState("vehicle", _STREAK)
        self._held = handle.getListState("held", _ROW)
        self._earliest = handle.getValueState("earliest", "ts BIGINT")

    def _wake(self, earliest: int) -> None:
        """Be called when the watermark has passed the first row held."""
        self._earliest.update((earliest,))
        for timer in self._handle.listTimers():
            self._handle.deleteTimer(int(timer[0] if isinstance(timer, tuple) else timer))
        self._handle.registerTimer(earliest // 1000 + 1)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = None
        for events in rows:
            if len(events):
                numbers = (events[c].astype("int64").tolist() for c in ("ts", "seq"))
                self._held.appendList(list(zip(*numbers, *(events[c].tolist() for c in _COLUMNS[2:]))))
                here = int(events["ts"].min())
                first = here if first is None else min(first, here)
        if first is not None and (not self._earliest.exists() or first < self._earliest.get()[0]):
            self._wake(first)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = pd.DataFrame([tuple(row) for row in self._held.get()], columns=_COLUMNS)
        due = held["ts"] < passed
        later = held[~due]
        if later.empty:
            self._held.clear()
            self._earliest.clear()
        else:
            self._held.put(list(later.itertuples(index=False, name=None)))
            self._wake(int(later["ts"].min()))
        if due.any():
            yield from self._apply(key, held[due].sort_values(["ts", "seq"], kind="stable"))

    def _apply(self, key, events: pd.DataFrame) -> Iterator[pd.DataFrame]:
        """Rows in event order, all of them later than those applied before."""
        last_ts, was_idle, idle_since, sent = self._state.get() if self._state.exists() else (None, False, None, False)
        ts = events["ts"].to_numpy(dtype=np.int64)
        idle = events["idle"].to_numpy(dtype=bool)
        place = np.arange(len(ts))
        last_move = np.maximum.accumulate(np.where(idle, -1, place))
        carried = (last_move < 0) & bool(was_idle) & (idle_since is not None)
        began = np.where(carried, idle_since if idle_since is not None else 0, ts[np.minimum(last_move + 1, place)])
        reached = idle & (ts - began >= self._threshold)
        reached_before = np.concatenate(([False], reached[:-1]))
        fired = reached & ~reached_before & ~(carried & bool(sent))

        in_open_streak = bool(idle[-1])
        still_carried = in_open_streak and bool(carried[-1])
        self._state.update(
            (
                int(ts[-1]),
                in_open_streak,
                int(began[-1]) if in_open_streak else None,
                in_open_streak and (bool(reached[-1]) or (still_carried and bool(sent))),
            )
        )
        if fired.any():
            out = events.loc[fired, ["driver_id", "zone_id", "ts"]].copy()
            out.insert(0, "vehicle_id", key[0])
            out["idle_micros"] = (ts - began)[fired]
            yield out

    def close(self) -> None:
        pass


def stored_streaks(spark: SparkSession, checkpoint: str) -> DataFrame:
    """What a checkpoint of ``live_idle_alerts`` knows of each vehicle, read from its state store without running the
    query: the newest event that the watermark has passed, the start of the idle streak open there, whether its alert went out."""
    rows = spark.read.format("statestore").option("stateVarName", "vehicle").load(checkpoint)
    value = F.col("value")
    idle = value["last_status_idle"]
    return rows.select(
        F.col("key.vehicle_id").alias("vehicle_id"),
        F.when(idle, F.timestamp_micros(value["idle_since"])).alias("idle_since"),
        F.timestamp_micros(value["last_ts"]).alias("last_event_ts"),
        F.coalesce(idle & value["sent"], F.lit(False)).alias("idle_alert_sent"),
    )


def live_idle_alerts(
    silver: DataFrame, threshold_minutes: float = IDLE_THRESHOLD_MINUTES, watermark: str = WATERMARK
) -> DataFrame:
    """Alert stream. An alert comes out once the watermark has passed its event; the alerts do not depend on
    the order in which rows arrive within the watermark's delay, nor on how they are cut into micro-batches."""
    narrow = silver.withWatermark("event_ts", watermark).select(
        "vehicle_id",
        "driver_id",
        "zone_id",
        "event_ts",
        micros(F.col("event_ts")).alias("ts"),
        sequence(silver).alias("seq"),
        (F.col("status") == F.lit(IDLE)).alias("idle"),
    )
    fired = narrow.groupBy("vehicle_id").transformWithStateInPandas(
        statefulProcessor=IdleWatch(threshold_minutes),
        outputStructType=_OUTPUT,
        outputMode="Append",
        timeMode="EventTime",
    )
    return idle_alert_rows(fired.withColumn("event_ts", F.timestamp_micros("ts")), threshold_minutes)
