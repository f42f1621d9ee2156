"""Registered queries over the given tables.

Results are flattened to plain types: money as double, averages and ratios rounded.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadbook.contract import VEHICLE_STATE
from roadbook.operators import clean, earnings, health, idle, kpi, lateness, latest, quality, serving, sketches, trips, windows
from roadbook.plans import daily, incremental
from roadbook.session import prepare, shared_folder, written_once
from roadbook.sinks import alerts as alert_sinks
from roadbook.sinks import tables
from roadbook.sources import expenses as expense_source
from roadbook.sources import given_tables as given
from roadbook.sources.telemetry import silver_table, telemetry_stream
from roadbook.streaming import idle as live_idle
from roadbook.streaming import windows as live_windows
from roadbook.streaming.events import EventBatch, LiveTables, start_events
from roadbook.streaming.partials import WindowPartials
from roadbook.streaming.progress import ProgressTable

Query = Callable[[SparkSession, str], DataFrame]

REPORT_DATE = dt.date(2024, 1, 15)
MONTH_SECONDS = 30 * 86_400
WINDOW = "6 hours"
IDLE_MINUTES = 720.0
HEALTH_SECONDS = 300
NO_DATA_AFTER = 6
VEHICLE = "V00042"
EXPENSE_DAYS = (dt.date(2024, 1, 14), REPORT_DATE)
_LOAD_TIMES = ("updated_at", "computed_at", "ingested_at")


def _plain(df: DataFrame, rounded: tuple[str, ...] = ()) -> DataFrame:
    """Decimals as double, ints as bigint, dates as text, times without zone,
    named columns rounded to 4 places; load times are left out."""
    out = []
    for name, kind in df.dtypes:
        if name in _LOAD_TIMES:
            continue
        column = F.col(name)
        if kind.startswith("decimal"):
            column = column.cast("double")
        elif kind == "int":
            column = column.cast("bigint")
        elif kind == "date":
            column = column.cast("string")
        elif kind == "timestamp":
            column = column.cast("timestamp_ntz")
        out.append((F.round(column, 4) if name in rounded else column).alias(name))
    return df.select(*out)


def _silver(spark: SparkSession, sf: str) -> DataFrame:
    return clean.silver(given.telemetry(spark, sf))


def _expenses(spark: SparkSession, sf: str) -> DataFrame:
    return given.each_day(clean.clean_expenses(given.raw_expenses(spark, sf)).drop("unfiled"))


def _profitability(spark: SparkSession, sf: str) -> DataFrame:
    return earnings.vehicle_profitability(_expenses(spark, sf), earnings.daily_earnings(_silver(spark, sf)))


def _alerts(spark: SparkSession, sf: str) -> DataFrame:
    return idle.idle_alerts(_silver(spark, sf), IDLE_MINUTES)


def _health(spark: SparkSession, sf: str) -> DataFrame:
    return health.batch_health(given.telemetry(spark, sf), HEALTH_SECONDS, NO_DATA_AFTER)


def _zones(spark: SparkSession, sf: str) -> DataFrame:
    return kpi.zone_snapshot(_silver(spark, sf))


def parse_props(spark: SparkSession, sf: str) -> DataFrame:
    return given.events(spark, sf).select("event_id", F.from_json("props", "k BIGINT").getField("k").alias("k"))


def parse_telemetry(spark: SparkSession, sf: str) -> DataFrame:
    return clean.parse_telemetry(given.envelopes_of(given.events(spark, sf)))


def zone_assign(spark: SparkSession, sf: str) -> DataFrame:
    zoned = clean.assign_zone(clean.clean_telemetry(given.telemetry(spark, sf)))
    return zoned.select("event_id", "lat", "lon", "event_ts", "zone_id", "time_of_day")


def unreconciled_vehicles(spark: SparkSession, sf: str) -> DataFrame:
    filed = clean.clean_expenses(given.raw_expenses(spark, sf)).where("NOT unfiled")
    missing = earnings.unreconciled_vehicles(given.each_day(filed), earnings.daily_earnings(_silver(spark, sf)))
    return _plain(missing)


def rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    return quality.rule_violations(given.telemetry(spark, sf), quality.telemetry_rules(), ["event_id"])


def result_rule_violations(spark: SparkSession, sf: str) -> DataFrame:
    """The rules of all result tables; what several tables need is computed once and stored."""
    silver = written_once(_silver(spark, sf), "silver")
    runs = idle.idle_runs(silver)
    expenses = _expenses(spark, sf)
    profit = earnings.vehicle_profitability(expenses, earnings.daily_earnings(silver))
    return quality.result_violations(
        {
            "silver": silver,
            "fleet_snapshot": kpi.fleet_snapshot(silver, MONTH_SECONDS),
            "zone_snapshot": kpi.zone_snapshot(silver),
            "zone_windows": windows.zone_windows(silver, WINDOW),
            "vehicle_state": idle.states_from_runs(runs, IDLE_MINUTES),
            "alerts": idle.alerts_from_runs(runs, IDLE_MINUTES),
            "health": _health(spark, sf),
            "vehicle_profitability": profit,
            "trip_analytics": trips.trip_analytics(silver),
            "daily_summary": trips.daily_summary(silver, expenses),
        }
    )


def daily_job(spark: SparkSession, sf: str) -> DataFrame:
    """The daily job on stored tables: silver by date, one date's expense file, gates, replaced partition."""
    folder = _run_folder(spark, "daily_job")
    tables.append_silver(_silver(spark, sf), f"{folder}/silver", 0)
    file_name = expense_source.FILE_NAMES[0].format(day=REPORT_DATE)
    given.raw_expenses(spark, sf).drop("unfiled").write.option("header", True).csv(f"{folder}/in/{file_name}")
    silver = silver_table(spark, f"{folder}/silver", REPORT_DATE)
    written = daily.run_day(spark, silver, f"{folder}/in", f"{folder}/out", REPORT_DATE)
    return _plain(written)


def rows_per_date(spark: SparkSession, sf: str) -> DataFrame:
    return _plain(quality.rows_per_date(_profitability(spark, sf)))


def expense_history(spark: SparkSession, sf: str) -> DataFrame:
    """Two dates' files, the second with its columns in another order, read back together."""
    folder, rows = _run_folder(spark, "expense_history"), given.raw_expenses(spark, sf).drop("unfiled")
    for day, columns in zip(EXPENSE_DAYS, (rows.columns, rows.columns[::-1])):
        name = expense_source.FILE_NAMES[0].format(day=day)
        rows.select(*columns).write.option("header", True).csv(f"{folder}/{name}")
    return _plain(expense_source.expense_history(spark, folder))


def _sketches_checked(spark: SparkSession, sf: str, sketched: DataFrame) -> DataFrame:
    return _plain(windows.sketch_check(sketched, windows.zone_windows(_silver(spark, sf), WINDOW)), ("avg_speed",))


def upsert_vehicle_state(spark: SparkSession, sf: str) -> DataFrame:
    """States after the first half of the month, then upserted with what the second half changes."""
    silver, path = _silver(spark, sf), _run_folder(spark, "vehicle_state")
    turn = F.lit("2024-01-16").cast("timestamp_ntz")
    first = idle.vehicle_states(silver.where(F.col("event_ts") < turn), IDLE_MINUTES)
    tables.replace_buckets(tables.finalise(first, VEHICLE_STATE), path, "vehicle_id", 0)
    later = silver.where(F.col("event_ts") >= turn)
    stored = tables.read_buckets(spark, path, VEHICLE_STATE, buckets=tables.touched_buckets(later, "vehicle_id"))
    runs = idle.idle_runs(later, stored)
    changed = tables.finalise(idle.states_from_runs(runs, IDLE_MINUTES), VEHICLE_STATE)
    tables.replace_buckets(tables.upsert(stored, changed, ["vehicle_id"]), path, "vehicle_id", 1)
    return _plain(tables.read_buckets(spark, path, VEHICLE_STATE))


def zone_windows_united(spark: SparkSession, sf: str) -> DataFrame:
    """Six hours put together from stored minutes, without the events."""
    minutes = written_once(sketches.window_sketches(_silver(spark, sf)), "minutes")
    united = sketches.united_windows(minutes, WINDOW)
    exact = windows.zone_windows(_silver(spark, sf), WINDOW)
    return _plain(windows.sketch_check(united, exact, deviation=sketches.UNION_DEVIATION), ("avg_speed",))


def zone_windows_corrected(spark: SparkSession, sf: str) -> DataFrame:
    """The feed in two batches, the second with every 17th row long after its window has closed: final windows and corrections."""
    folder = _run_folder(spark, "window_partials")
    partials = WindowPartials(folder, WINDOW)
    silver = _silver(spark, sf)
    late = F.col("event_id") % 17 == 0
    for batch_id, rows in enumerate((silver.where(~late), silver.where(late))):
        partials(rows, batch_id)
    newest = silver.agg(F.max("event_ts").alias("newest")).select("newest").scalar()
    closed = partials.corrected(spark).where(F.col("window_end").cast("timestamp") <= newest.cast("timestamp") - F.expr("INTERVAL 2 MINUTES"))
    return _plain(closed, ("idle_ratio", "trips_per_hour", "avg_speed"))


def daily_earnings_incremental(spark: SparkSession, sf: str) -> DataFrame:
    """Earnings refreshed after each of three increments of the log; the last one adds to dates that were done."""
    folder, silver = _run_folder(spark, "incremental"), _silver(spark, sf)
    held_back = (F.col("event_id") % 9 == 0) & (F.col("event_ts") < F.lit("2024-01-06").cast("timestamp_ntz"))
    early = F.col("event_ts") < F.lit("2024-01-11").cast("timestamp_ntz")
    for batch_id, rows in enumerate((silver.where(early & ~held_back), silver.where(~early), silver.where(held_back))):
        tables.append_silver(rows, f"{folder}/silver", batch_id)
        incremental.refresh(spark, f"{folder}/silver", f"{folder}/earnings")
    return _plain(spark.read.parquet(f"{folder}/earnings"))


_BATCH: dict[str, Query] = {
    "upsert_vehicle_state": upsert_vehicle_state,
    "parse_props": parse_props,
    "parse_telemetry": parse_telemetry,
    "clean_telemetry": lambda s, sf: clean.clean_telemetry(given.telemetry(s, sf)),
    "zone_assign": zone_assign,
    "silver": _silver,
    "reject_reasons": lambda s, sf: clean.reject_reasons(given.telemetry(s, sf)),
    "out_of_bounds_counts": lambda s, sf: clean.out_of_bounds_counts(given.telemetry(s, sf)),
    "expenses_clean": lambda s, sf: _plain(clean.clean_expenses(given.raw_expenses(s, sf)).drop("unfiled")),
    "latest_per_vehicle": lambda s, sf: latest.latest_per_vehicle(_silver(s, sf)),
    "trip_fares": lambda s, sf: kpi.trip_fares(_silver(s, sf)),
    "fleet_snapshot": lambda s, sf: _plain(
        kpi.fleet_snapshot(_silver(s, sf), MONTH_SECONDS), ("idle_ratio", "trips_per_hour", "avg_speed")
    ),
    "zone_snapshot": lambda s, sf: _plain(_zones(s, sf), ("avg_speed",)),
    "zone_ranking": lambda s, sf: _plain(kpi.zone_ranking(_zones(s, sf)), ("avg_speed",)),
    "daily_earnings": lambda s, sf: _plain(earnings.daily_earnings(_silver(s, sf))),
    "zone_windows": lambda s, sf: _plain(
        windows.zone_windows(_silver(s, sf), WINDOW), ("idle_ratio", "trips_per_hour", "avg_speed")
    ),
    "zone_windows_approx": lambda s, sf: _sketches_checked(s, sf, windows.zone_windows_approx(_silver(s, sf), WINDOW)),
    "zone_windows_united": zone_windows_united,
    "zone_windows_corrected": zone_windows_corrected,
    "daily_earnings_incremental": daily_earnings_incremental,
    "late_events": lambda s, sf: lateness.late_events(given.arrivals(s, sf)),
    "idle_episodes": lambda s, sf: idle.idle_episodes(_silver(s, sf)),
    "idle_alerts": lambda s, sf: _plain(_alerts(s, sf)),
    "alert_messages": lambda s, sf: alert_sinks.alert_messages(_alerts(s, sf)),
    "recent_alerts": lambda s, sf: _plain(serving.recent_alerts(_alerts(s, sf))),
    "batch_health": lambda s, sf: _plain(_health(s, sf)),
    "health_outside": lambda s, sf: health.outside_counts(given.telemetry(s, sf)),
    "health_latest": lambda s, sf: _plain(health.health_latest(_health(s, sf))),
    "no_data_alerts": lambda s, sf: _plain(health.no_data_alerts(_health(s, sf), NO_DATA_AFTER)),
    "vehicle_status": lambda s, sf: serving.vehicle_status(idle.vehicle_states(_silver(s, sf), IDLE_MINUTES)),
    "vehicle_profitability": lambda s, sf: _plain(_profitability(s, sf)),
    "profit_by_date": lambda s, sf: _plain(serving.profit_by_date(_profitability(s, sf), REPORT_DATE)),
    "profit_latest": lambda s, sf: _plain(serving.profit_latest(_profitability(s, sf))),
    "vehicle_profit_on": lambda s, sf: _plain(
        serving.vehicle_profit_on(_profitability(s, sf), VEHICLE, REPORT_DATE)
    ),
    "vehicle_profit_latest": lambda s, sf: _plain(serving.vehicle_profit_latest(_profitability(s, sf))),
    "profit_summary": lambda s, sf: _plain(earnings.profit_summary(_profitability(s, sf))),
    "loss_leaders": lambda s, sf: _plain(serving.loss_leaders(_profitability(s, sf))),
    "unreconciled_vehicles": unreconciled_vehicles,
    "trip_analytics": lambda s, sf: _plain(trips.trip_analytics(_silver(s, sf)), ("avg_speed",)),
    "daily_summary": lambda s, sf: _plain(
        trips.daily_summary(_silver(s, sf), _expenses(s, sf)), ("average_speed",)
    ),
    "rule_violations": rule_violations,
    "result_rule_violations": result_rule_violations,
    "daily_job": daily_job,
    "rows_per_date": rows_per_date,
    "expense_history": expense_history,
}


def _run_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    """The events table as a stream of wire messages."""
    schema = given.events(spark, sf).schema
    return given.envelopes_of(telemetry_stream(spark, "parquet", schema, sf, pathGlobFilter="events.parquet"))


def _feed_silver(spark: SparkSession, sf: str) -> DataFrame:
    return clean.silver(clean.parse_telemetry(_feed(spark, sf)))


def idle_alerts_stream(spark: SparkSession, sf: str) -> DataFrame:
    folder = _run_folder(spark, "idle_alerts_stream")
    query = (
        live_idle.live_idle_alerts(_feed_silver(spark, sf), IDLE_MINUTES)
        .writeStream.format("parquet")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
        .start(f"{folder}/rows")
    )
    query.awaitTermination()
    return _plain(spark.read.parquet(f"{folder}/rows"))


def stored_streaks(spark: SparkSession, sf: str) -> DataFrame:
    """The streaks that the alert stream's own state holds after the whole feed."""
    folder = _run_folder(spark, "stored_streaks")
    alerts = live_idle.live_idle_alerts(_feed_silver(spark, sf), IDLE_MINUTES)
    query = alerts.writeStream.format("noop").option("checkpointLocation", folder).trigger(availableNow=True).start()
    query.awaitTermination()
    return _plain(live_idle.stored_streaks(spark, folder))


def _with_provider(query: Query) -> Query:
    """Streams with timers or several state variables need the RocksDB state store; the caller's
    setting is put back."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        key = "spark.sql.streaming.stateStore.providerClass"
        before = spark.conf.get(key)
        spark.conf.set(key, live_idle.STATE_PROVIDER)
        try:
            return query(spark, sf)
        finally:
            spark.conf.set(key, before)

    return run


def live_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the dead-letter log per reason, after the whole feed has gone through the events query."""
    rows = _live_tables(spark, sf).rejected(spark)
    return rows.groupBy(F.col("reject_reason").alias("reason")).agg(F.count(F.lit(1)).alias("row_count"))


def _windows_from_stream(spark: SparkSession, windowed: DataFrame, output_mode: str) -> DataFrame:
    folder = _run_folder(spark, "zone_windows_stream")
    live_windows.start_windows(
        windowed, f"{folder}/rows", f"{folder}/checkpoint", {"availableNow": True}, output_mode
    ).awaitTermination()
    return live_windows.read_windows(spark, f"{folder}/rows")


def zone_windows_stream(spark: SparkSession, sf: str) -> DataFrame:
    live = live_windows.live_zone_windows(_feed_silver(spark, sf), length=WINDOW)
    stored = _windows_from_stream(spark, live, "update")
    return _sketches_checked(spark, sf, stored)


def zone_windows_final_stream(spark: SparkSession, sf: str) -> DataFrame:
    final = live_windows.final_zone_windows(_feed_silver(spark, sf), length=WINDOW)
    return _plain(_windows_from_stream(spark, final, "append"))


def _live_tables(spark: SparkSession, sf: str) -> LiveTables:
    """All live tables after the whole feed has gone through the events query."""
    folder = _run_folder(spark, "live")
    live = LiveTables(f"{folder}/tables")
    handler = EventBatch(live, MONTH_SECONDS, IDLE_MINUTES)
    start_events(_feed(spark, sf), handler, f"{folder}/checkpoint", {"availableNow": True}).awaitTermination()
    return live


def live_health(spark: SparkSession, sf: str) -> DataFrame:
    """The feed's status after its newest batch with rows."""
    now = dt.datetime.now(dt.timezone.utc)
    every = _live_tables(spark, sf).health(spark, HEALTH_SECONDS, NO_DATA_AFTER, now)
    newest = health.health_now(every.where("raw_rows > 0"))
    return _plain(newest.select("status", "message", "empty_streak", "raw_rows", "valid_rows", "last_event_ts", "last_batch_id"))


def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """What the progress log says about one stream over the whole feed, per kind of event."""
    folder = _run_folder(spark, "stream_progress")
    listener = ProgressTable(spark, f"{folder}/progress")
    spark.streams.addListener(listener)
    try:
        query = (
            _feed(spark, sf)
            .writeStream.format("noop")
            .option("checkpointLocation", f"{folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    finally:
        spark.streams.removeListener(listener)
    listener.flush()
    log = LiveTables(folder).progress(spark).where(F.col("query_id") == F.lit(str(query.id)))
    return log.groupBy("event").agg(
        F.coalesce(F.sum("input_rows"), F.lit(0)).alias("input_rows"),
        F.count_distinct("query_id").alias("queries"),
        F.count_if(F.col("exception").isNotNull()).alias("failures"),
    )


_STREAMS: dict[str, Query] = {
    "stream_progress": stream_progress,
    "idle_alerts_stream": _with_provider(idle_alerts_stream),
    "stored_streaks": _with_provider(stored_streaks),
    "zone_windows_stream": zone_windows_stream,
    "zone_windows_final_stream": zone_windows_final_stream,
    "live_fleet": lambda s, sf: _plain(_live_tables(s, sf).fleet(s)),
    "live_vehicle_status": lambda s, sf: _plain(serving.vehicle_status(_live_tables(s, sf).states(s))),
    "live_recent_alerts": lambda s, sf: _plain(_live_tables(s, sf).recent_alerts(s)),
    "live_zones": lambda s, sf: _plain(serving.zones_by_exposure(_live_tables(s, sf).zones(s))),
    "live_health": live_health,
    "live_rejects": live_rejects,
}


def _prepared(query: Query) -> Query:
    return lambda spark, sf_dir: query(prepare(spark), sf_dir.rstrip("/"))


def queries() -> dict[str, Query]:
    return {name: _prepared(query) for name, query in {**_BATCH, **_STREAMS}.items()}
