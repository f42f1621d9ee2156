"""Listeners: a progress table and the alert for a silent feed."""

from __future__ import annotations

import datetime as dt
import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from roadbook import contract
from roadbook.sinks import files, tables
from roadbook.streaming.events import FEED_ALERTS, LiveTables, append_alerts

FLUSH_ROWS, FLUSH_SECONDS = 500, 60.0


def _instant(text: str | None) -> dt.datetime:
    if not text:
        return dt.datetime.now(dt.timezone.utc)
    return dt.datetime.fromisoformat(text.replace("Z", "+00:00"))


class ProgressTable(StreamingQueryListener):
    """Logs one typed row per query start, trigger with data and end.

    Rows are held and written together, by count, by time or at a query's end, into a log by date that is merged like the
    others. The driver holds at most ``flush_rows`` rows; what it holds when it dies is lost.
    """

    def __init__(
        self, spark: SparkSession, path: str, flush_rows: int = FLUSH_ROWS, flush_seconds: float = FLUSH_SECONDS
    ) -> None:
        self._spark, self._path = spark, path
        self._flush_rows, self._flush_seconds = flush_rows, flush_seconds
        self._held: list[tuple] = []
        self._since = time.monotonic()
        self._run, self._number = files.new_run(), 0
        self._lock = threading.Lock()

    def _append(self, **fields) -> None:
        with self._lock:
            self._held.append(tuple(fields.get(f.name) for f in contract.PROGRESS.fields))
            due = len(self._held) >= self._flush_rows or time.monotonic() - self._since >= self._flush_seconds
        if due or fields["event"] == "terminated":
            self.flush()

    def flush(self) -> None:
        """Write the rows held as one batch of the log."""
        with self._lock:
            rows, number = self._held, self._number
            self._held, self._since = [], time.monotonic()
            self._number += bool(rows)
        if rows:
            frame = self._spark.createDataFrame(rows, contract.PROGRESS).coalesce(1)
            dated = frame.withColumn("progress_date", F.to_date("at"))
            tables.append_batch(dated, self._path, number, "progress_date", run=self._run)

    def onQueryStarted(self, event) -> None:
        self._append(event="started", query_id=str(event.id), query_name=event.name, at=_instant(event.timestamp))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        self._append(
            event="progress",
            query_id=str(progress.id),
            query_name=progress.name,
            trigger_id=progress.batchId,
            input_rows=progress.numInputRows,
            late_rows=sum(step.numRowsDroppedByWatermark for step in progress.stateOperators or []),
            duration_ms=dict(progress.durationMs or {}).get("triggerExecution"),
            sources=[source.description for source in progress.sources or []],
            at=_instant(progress.timestamp),
        )

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._append(event="terminated", query_id=str(event.id), exception=event.exception, at=_instant(None))


class SilenceWatch:
    """When a feed counts as silent: ``limit`` trigger intervals without data, told once."""

    def __init__(self, trigger_seconds: float, limit: int = contract.NO_DATA_BATCHES) -> None:
        self._trigger_seconds, self._limit = trigger_seconds, limit
        self._last_data: dt.datetime | None = None
        self._told = False

    def data(self, at: dt.datetime) -> None:
        self._last_data, self._told = at, False

    def idle(self, at: dt.datetime) -> int | None:
        """Number of empty intervals when the alert is due, else None.

        Idle events are throttled by Spark, so elapsed time is measured, not their number.
        """
        if self._last_data is None:
            self._last_data = at
        streak = int((at - self._last_data).total_seconds() // self._trigger_seconds)
        if self._told or streak < self._limit:
            return None
        self._told = True
        return streak


class NoDataAlerts(StreamingQueryListener):
    """Writes one CRITICAL alert per silence of the events query.

    A stateless query gets no batch while its source is silent, so the rule hangs on idle events.
    """

    def __init__(
        self,
        spark: SparkSession,
        live: LiveTables,
        trigger_seconds: float,
        limit: int = contract.NO_DATA_BATCHES,
        publish: Callable[[DataFrame], None] | None = None,
    ) -> None:
        self._spark, self._live, self._publish = spark, live, publish
        self._watch = SilenceWatch(trigger_seconds, limit)
        self._query_id: str | None = None

    def onQueryStarted(self, event) -> None:
        if event.name == "telemetry_events":
            self._query_id = str(event.id)
            self._watch.data(_instant(event.timestamp))

    def onQueryProgress(self, event) -> None:
        progress = event.progress
        if str(progress.id) == self._query_id and progress.numInputRows:
            self._watch.data(_instant(progress.timestamp))

    def onQueryIdle(self, event) -> None:
        if str(event.id) != self._query_id:
            return
        at = _instant(event.timestamp)
        streak = self._watch.idle(at)
        if streak is not None:
            self.write_alert(streak, at)

    def write_alert(self, streak: int, at: dt.datetime) -> None:
        alert = self._spark.range(1).select(
            F.lit("NO_DATA").alias("alert_type"),
            *[F.lit(None).cast("string").alias(c) for c in ("vehicle_id", "driver_id", "zone_id")],
            F.lit(None).cast("decimal(10,2)").alias("idle_minutes"),
            F.lit("CRITICAL").alias("severity"),
            F.lit(contract.NO_DATA_MESSAGE % streak).alias("message"),
            F.lit(at).cast("timestamp").alias("created_at"),
        )
        # numbered by its time, so no alert of an earlier silence or run is replaced
        rows = tables.finalise(alert, contract.ALERTS)
        append_alerts(rows, self._live.path(FEED_ALERTS), int(at.timestamp() * 1000))
        if self._publish is not None:
            self._publish(alert)

    def onQueryTerminated(self, event) -> None:
        pass
