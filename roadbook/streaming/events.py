"""One micro-batch of telemetry into all live tables."""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, replace

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadbook import contract
from roadbook.operators import clean, health, idle, kpi, serving
from roadbook.session import shared_folder
from roadbook.sinks import compact, dead_letters, files, tables
from roadbook.sinks.alerts import with_defaults
from roadbook.sources import logs

VEHICLE_ALERTS, FEED_ALERTS = "alerts", "feed_alerts"


@dataclass(frozen=True)
class LiveTables:
    """Where the live tables are, under one root folder."""

    root: str

    def path(self, name: str) -> str:
        return f"{self.root.rstrip('/')}/{name}"

    def silver(self, spark: SparkSession) -> DataFrame:
        """Silver rows with their ``event_date``."""
        return logs.read_log(spark, self.path("silver"), contract.SILVER, "event_date").drop("run", "batch_id", "ingested_at")

    def fleet(self, spark: SparkSession) -> DataFrame:
        return tables.read_version(spark, self.path("fleet_snapshot"), contract.FLEET_SNAPSHOT)

    def zones(self, spark: SparkSession) -> DataFrame:
        return tables.read_version(spark, self.path("zone_snapshot"), contract.ZONE_SNAPSHOT)

    def states(
        self, spark: SparkSession, before: tuple[str, int] | None = None, buckets: list[int] | None = None
    ) -> DataFrame:
        return tables.read_buckets(spark, self.path("vehicle_state"), contract.VEHICLE_STATE, before, buckets)

    def progress(self, spark: SparkSession) -> DataFrame:
        return logs.read_log(spark, self.path("progress"), contract.PROGRESS, "progress_date").drop("progress_date", "run", "batch_id")

    def alerts(self, spark: SparkSession) -> DataFrame:
        """Alerts of vehicles and of the feed; the two have logs of their own, as they have writers of their own."""
        both = [logs.read_log(spark, self.path(name), contract.ALERTS, "alert_date") for name in (VEHICLE_ALERTS, FEED_ALERTS)]
        return both[0].unionByName(both[1]).drop("alert_date", "run", "batch_id")

    def recent_alerts(self, spark: SparkSession, limit: int = contract.ALERTS_DEFAULT) -> DataFrame:
        """The newest alerts; only as many dates of the logs are read as it takes."""
        paths = [self.path(name) for name in (VEHICLE_ALERTS, FEED_ALERTS)]
        rows = logs.newest_rows(spark, paths, contract.ALERTS, "alert_date", limit)
        return serving.recent_alerts(rows.drop("alert_date", "run", "batch_id"), limit)

    def rejected(self, spark: SparkSession) -> DataFrame:
        return dead_letters.read_rejected(spark, self.path("rejected"))

    def replay_rejected(self, spark: SparkSession) -> int:
        """Rows of the dead-letter log that the rules accept now go to silver; their number."""
        return dead_letters.replay(spark, self.path("rejected"), self.path("silver"))

    def health_log(self, spark: SparkSession) -> DataFrame:
        return logs.read_log(spark, self.path("health"), contract.HEALTH_LOG, "log_date_utc").drop("log_date_utc")

    def compact(self, spark: SparkSession, before: dt.date, keep_seconds: float = tables.KEEP_SECONDS) -> dict[str, list[str]]:
        """Merge the files of all logs' dates before ``before``; the dates merged, per log."""
        kept = {
            "silver": (contract.SILVER, "event_date", ("vehicle_id", "event_ts")),
            VEHICLE_ALERTS: (contract.ALERTS, "alert_date", ()),
            FEED_ALERTS: (contract.ALERTS, "alert_date", ()),
            "health": (contract.HEALTH_LOG, "log_date_utc", ()),
            "zone_windows": (contract.ZONE_WINDOWS, "window_date", ()),
            "progress": (contract.PROGRESS, "progress_date", ("at",)),
        }
        return {
            name: compact.merge_dates(spark, self.path(name), schema, column, before, order, keep_seconds)
            for name, (schema, column, order) in kept.items()
        }

    def health(self, spark: SparkSession, interval_seconds: int, no_data_after: int, until) -> DataFrame:
        return health.health_of_log(self.health_log(spark), interval_seconds, no_data_after, until)


def append_alerts(rows: DataFrame, path: str, batch_id: int, run: str = tables.FIRST_RUN) -> None:
    tables.append_batch(rows.withColumn("alert_date", F.to_date("created_at")), path, batch_id, "alert_date", run=run)


@dataclass(frozen=True)
class EventBatch:
    """``foreachBatch`` handler: reads the batch once, writes every live table, collects nothing."""

    tables: LiveTables
    window_seconds: float = contract.TRIGGER_SECONDS
    threshold_minutes: float = contract.IDLE_THRESHOLD_MINUTES
    publish: Callable[[DataFrame], None] | None = None
    run: str = tables.FIRST_RUN

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = clean.parse_telemetry(batch).persist(StorageLevel.MEMORY_AND_DISK)
        silver = clean.silver(parsed)
        writes = [
            lambda: self._idle(spark, silver, parsed, batch_id),
            lambda: tables.append_silver(silver, self.tables.path("silver"), batch_id, self.run),
            lambda: self._fleet(silver, batch_id),
            lambda: self._zones(silver, batch_id),
            lambda: dead_letters.append_rejected(parsed, self.tables.path("rejected"), batch_id, self.run),
        ]
        try:
            # independent tables, written side by side; a failed write fails the batch,
            # which is then replayed as a whole
            with ThreadPoolExecutor(len(writes)) as pool:
                for done in [pool.submit(inheritable_thread_target(spark)(write)) for write in writes]:
                    done.result()
        finally:
            parsed.unpersist()

    def _fleet(self, silver: DataFrame, batch_id: int) -> None:
        fleet = kpi.fleet_snapshot(silver, self.window_seconds).where("total_vehicles > 0")
        rows = tables.finalise(fleet, contract.FLEET_SNAPSHOT)
        tables.replace_version(rows, self.tables.path("fleet_snapshot"), batch_id, self.run)

    def _zones(self, silver: DataFrame, batch_id: int) -> None:
        rows = tables.finalise(kpi.zone_snapshot(silver), contract.ZONE_SNAPSHOT)
        tables.replace_version(rows, self.tables.path("zone_snapshot"), batch_id, self.run)

    def _idle(self, spark: SparkSession, silver: DataFrame, parsed: DataFrame, batch_id: int) -> None:
        """Alerts and states of the vehicles in the batch; only the buckets of those vehicles are read and written."""
        touched = tables.touched_buckets(silver, "vehicle_id")
        before = self.tables.states(spark, (self.run, batch_id), touched)
        split = idle.split_stale(silver, before).persist(StorageLevel.MEMORY_AND_DISK)
        scanned = f"{shared_folder(spark)}/idle-scan-{uuid.uuid4().hex}"

        def keep(rows: DataFrame) -> DataFrame:
            rows.write.parquet(scanned)
            return spark.read.schema(rows.schema).parquet(scanned)

        try:
            runs = idle.idle_runs(split.where("NOT stale").drop("stale"), before, keep=keep)
            alerts = with_defaults(idle.alerts_from_runs(runs, self.threshold_minutes))
            rows = tables.finalise(alerts, contract.ALERTS)
            append_alerts(rows, self.tables.path(VEHICLE_ALERTS), batch_id, self.run)
            if self.publish is not None:
                self.publish(alerts)
            seen = tables.finalise(idle.states_from_runs(runs, self.threshold_minutes), contract.VEHICLE_STATE)
            states = tables.upsert(before, seen, ["vehicle_id"])
            tables.replace_buckets(states, self.tables.path("vehicle_state"), "vehicle_id", batch_id, self.run)
            self._health(parsed, split, batch_id)
        finally:
            split.unpersist()
            files.remove(spark, scanned)

    def _health(self, parsed: DataFrame, split: DataFrame, batch_id: int) -> None:
        stale = split.agg(F.count_if("stale").alias("stale_rows"))
        counts = health.batch_counts(parsed)
        stacked = counts.unionByName(stale, allowMissingColumns=True)
        row = stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])
        logged = tables.finalise(row, contract.HEALTH_LOG).withColumn("log_date_utc", F.to_date("processed_at"))
        tables.append_batch(logged, self.tables.path("health"), batch_id, "log_date_utc", run=self.run)


def start_events(
    messages: DataFrame, handler: EventBatch, checkpoint: str, trigger: dict
) -> StreamingQuery:
    """Start the events query; its tables are keyed by the run of the checkpoint."""
    handler = replace(handler, run=files.run_of(messages.sparkSession, checkpoint))
    return (
        messages.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .queryName("telemetry_events")
        .start()
    )
