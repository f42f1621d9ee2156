"""Speed layer: events and window metrics from one feed into the live tables."""

from __future__ import annotations

import argparse
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from roadbook import contract
from roadbook.functions.clock import length_seconds
from roadbook.operators import clean
from roadbook.session import open_session, shared_folder
from roadbook.sinks.alerts import publish_alerts
from roadbook.sources.telemetry import numbered, telemetry_stream
from roadbook.streaming import windows
from roadbook.streaming.events import EventBatch, LiveTables, start_events
from roadbook.streaming.progress import NoDataAlerts, ProgressTable

def start_live(
    messages: DataFrame,
    root: str,
    *,
    trigger: dict,
    watermark: str = contract.WATERMARK,
    window: str = contract.METRICS_WINDOW,
    window_seconds: float = contract.TRIGGER_SECONDS,
    threshold_minutes: float = contract.IDLE_THRESHOLD_MINUTES,
    publish: Callable[[DataFrame], None] | None = None,
    checkpoints: str | None = None,
) -> tuple[StreamingQuery, StreamingQuery]:
    """Start both queries over a message stream.

    Checkpoints go under ``checkpoints``, by default a place in the shared folder.
    """
    checkpoints = checkpoints or f"{shared_folder(messages.sparkSession)}/live"
    live = LiveTables(root)
    handler = EventBatch(live, window_seconds, threshold_minutes, publish)
    events = start_events(messages, handler, f"{checkpoints}/events", trigger)
    silver = clean.silver(clean.parse_telemetry(messages))
    windowed = windows.live_zone_windows(silver, watermark, window)
    metrics = windows.start_windows(windowed, live.path("zone_windows"), f"{checkpoints}/windows", trigger)
    return events, metrics


def watch(
    spark: SparkSession,
    root: str,
    seconds: float,
    limit: int = contract.NO_DATA_BATCHES,
    publish: Callable[[DataFrame], None] | None = None,
) -> None:
    """Register the progress table and the silent-feed alert, which goes out like any other alert."""
    live = LiveTables(root)
    spark.streams.addListener(ProgressTable(spark, live.path("progress")))
    spark.streams.addListener(NoDataAlerts(spark, live, seconds, limit, publish))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(description="Live telemetry tables")
    parser.add_argument("--brokers")
    parser.add_argument("--topic")
    parser.add_argument("--alerts-topic")
    parser.add_argument("--root", required=True, help="folder of the live tables")
    parser.add_argument("--starting-offsets", default="latest")
    parser.add_argument("--max-offsets-per-trigger", default="5000000")
    parser.add_argument("--trigger", default=f"{contract.TRIGGER_SECONDS} seconds")
    parser.add_argument("--watermark", default=contract.WATERMARK)
    parser.add_argument("--window", default=contract.METRICS_WINDOW)
    parser.add_argument("--idle-minutes", type=float, default=contract.IDLE_THRESHOLD_MINUTES)
    parser.add_argument("--no-data-batches", type=int, default=contract.NO_DATA_BATCHES)
    parser.add_argument("--replay-rejected", action="store_true", help="move rejected rows that the rules accept now to silver and end")
    parser.add_argument("--compact-before", type=dt.date.fromisoformat, help="merge the logs' files of earlier dates and end")
    args = parser.parse_args(argv)

    spark = open_session("roadbook-live")
    if args.compact_before:
        print(LiveTables(args.root).compact(spark, args.compact_before))
        return
    if args.replay_rejected:
        print(LiveTables(args.root).replay_rejected(spark))
        return
    brokers = {"kafka.bootstrap.servers": args.brokers}
    seconds = length_seconds(args.trigger)
    messages = telemetry_stream(
        spark,
        "kafka",
        subscribe=args.topic,
        startingOffsets=args.starting_offsets,
        maxOffsetsPerTrigger=args.max_offsets_per_trigger,
        **brokers,
    )
    publish = None
    if args.alerts_topic:
        def publish(alerts):
            publish_alerts(alerts, "kafka", topic=args.alerts_topic, **brokers)

    watch(spark, args.root, seconds, args.no_data_batches, publish)
    start_live(
        numbered(messages),
        args.root,
        trigger={"processingTime": args.trigger},
        watermark=args.watermark,
        window=args.window,
        window_seconds=seconds,
        threshold_minutes=args.idle_minutes,
        publish=publish,
    )
    spark.streams.awaitAnyTermination()


if __name__ == "__main__":
    main()
