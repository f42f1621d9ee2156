"""Independent SQL for the registered queries, to be run on the same parquet tables.

Each statement is put together from named subqueries. Only the projection of the given
tables is shared with the Spark side; all operator logic is written anew in SQL.
"""

from __future__ import annotations

from roadbook.sources.given_tables import EXPENSES_SQL, FIRST_DAY, LAST_DAY, TELEMETRY_SQL


def _d(number: str) -> str:
    return f"CAST({number} AS DOUBLE)"


def _cell(column: str, low: str, high: str) -> str:
    return (
        f"CASE WHEN {column} IS NULL THEN '0' ELSE CAST(CAST(least(floor(({column} - {_d(low)}) / "
        f"(({_d(high)} - {_d(low)}) / 3)), 2) AS BIGINT) AS VARCHAR) END"
    )


def _pulled(column: str, low: str, high: str) -> str:
    return f"CASE WHEN {column} < {_d(low)} THEN {_d(low)} WHEN {column} > {_d(high)} THEN {_d(high)} ELSE {column} END"


_IDLE_MICROS = "CAST(720 AS BIGINT) * 60000000"
_MONEY = "DECIMAL(12, 2)"

_PARTS = {
    "telemetry": TELEMETRY_SQL.format(events="events"),
    "cleaned": f"""
        SELECT event_id, trip_id, trim(driver_id) AS driver_id, trim(vehicle_id) AS vehicle_id,
          {_pulled('lat', '6.85', '7.00')} AS lat, {_pulled('lon', '79.80', '79.95')} AS lon,
          coalesce(speed, {_d('0')}) AS speed, lower(trim(status)) AS status,
          coalesce(fare, {_d('0')}) AS fare, event_ts
        FROM telemetry
        WHERE trim(vehicle_id) <> '' AND lower(trim(status)) IN ('idle', 'enroute', 'on_trip') AND event_ts IS NOT NULL""",
    "silver": f"""
        SELECT *, 'Z' || {_cell('lat', '6.85', '7.00')} || {_cell('lon', '79.80', '79.95')} AS zone_id,
          CASE WHEN extract(hour FROM event_ts) BETWEEN 5 AND 11 THEN 'morning'
               WHEN extract(hour FROM event_ts) BETWEEN 12 AND 16 THEN 'afternoon'
               WHEN extract(hour FROM event_ts) BETWEEN 17 AND 20 THEN 'evening' ELSE 'night' END AS time_of_day
        FROM cleaned""",
    "expense_rows": f"""
        SELECT trim(vehicle_id) AS vehicle_id,
          coalesce(TRY_CAST(fuel_cost AS {_MONEY}), 0) AS fuel_cost,
          coalesce(TRY_CAST(maintenance_cost AS {_MONEY}), 0) AS maintenance_cost,
          coalesce(TRY_CAST(distance_covered AS DOUBLE), 0) AS distance_covered,
          coalesce(lower(trim(service_flag)) IN ('true', 't', '1', 'yes', 'y'), false) AS service_flag, unfiled
        FROM ({EXPENSES_SQL.format(customer='customer')}) x""",
    "expense_days": f"""
        SELECT e.*, CAST(d.day AS DATE) AS report_date
        FROM expense_rows e, generate_series(DATE '{FIRST_DAY}', DATE '{LAST_DAY}', INTERVAL 1 DAY) AS d(day)""",
    "newest": """
        SELECT * FROM silver QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, event_id DESC) = 1""",
    "zones": """
        SELECT n.zone_id, n.time_of_day, n.active_vehicles, n.avg_speed, n.event_count, n.window_start, n.window_end,
          coalesce(t.trips_in_window, 0) AS trips_in_window, coalesce(f.exposure, 0) AS live_fare_exposure
        FROM (SELECT zone_id, time_of_day, count(*) FILTER (WHERE status <> 'idle') AS active_vehicles,
                round(avg(speed), 4) AS avg_speed, count(*) AS event_count,
                min(event_ts) AS window_start, max(event_ts) AS window_end
              FROM newest GROUP BY ALL) n
        LEFT JOIN (SELECT zone_id, time_of_day, count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) AS trips_in_window
                   FROM silver GROUP BY ALL) t USING (zone_id, time_of_day)
        LEFT JOIN (SELECT zone_id, time_of_day, CAST(sum(trip_fare) AS DOUBLE) AS exposure
                   FROM (SELECT trip_id, zone_id, time_of_day, CAST(max(fare) AS DECIMAL(12, 2)) AS trip_fare
                         FROM silver WHERE trip_id IS NOT NULL GROUP BY ALL) GROUP BY ALL) f USING (zone_id, time_of_day)""",
    "earned": """
        SELECT report_date, vehicle_id, sum(fare) AS earnings, count(*) AS trip_count
        FROM (SELECT CAST(event_ts AS DATE) AS report_date, vehicle_id, trip_id, CAST(max(fare) AS DECIMAL(12, 2)) AS fare
              FROM silver WHERE trip_id <> '' GROUP BY ALL) WHERE fare > 0 GROUP BY ALL""",
    "profitability": """
        SELECT e.report_date, e.vehicle_id, coalesce(g.trip_count, 0) AS trip_count,
          CAST(coalesce(g.earnings, 0) AS DOUBLE) AS earnings, CAST(e.fuel_cost AS DOUBLE) AS fuel_cost,
          CAST(e.maintenance_cost AS DOUBLE) AS maintenance_cost, e.distance_covered, e.service_flag,
          CAST(coalesce(g.earnings, 0) - e.fuel_cost - e.maintenance_cost AS DOUBLE) AS profit,
          coalesce(g.earnings, 0) - e.fuel_cost - e.maintenance_cost < 0 AS unprofitable
        FROM expense_days e LEFT JOIN earned g USING (report_date, vehicle_id)""",
    "flagged": """
        SELECT *, CASE WHEN status = lag(status) OVER v THEN 0 ELSE 1 END AS changed
        FROM silver WINDOW v AS (PARTITION BY vehicle_id ORDER BY event_ts, event_id)""",
    "islands": """
        SELECT *, sum(changed) OVER (PARTITION BY vehicle_id ORDER BY event_ts, event_id ROWS UNBOUNDED PRECEDING) AS island
        FROM flagged""",
    "idling": """
        SELECT *, min(event_ts) OVER (PARTITION BY vehicle_id, island) AS idle_since
        FROM islands WHERE status = 'idle'""",
    "alerts": f"""
        SELECT vehicle_id, driver_id, zone_id, event_ts AS created_at, epoch_us(event_ts) - epoch_us(idle_since) AS idle_micros
        FROM idling WHERE epoch_us(event_ts) - epoch_us(idle_since) >= {_IDLE_MICROS}
        QUALIFY row_number() OVER (PARTITION BY vehicle_id, island ORDER BY event_ts, event_id) = 1""",
    "alert_rows": """
        SELECT 'IDLE_VEHICLE' AS alert_type, vehicle_id, driver_id, zone_id,
          CAST(CAST((idle_micros + 300000) // 600000 AS DOUBLE) / 100 AS DOUBLE) AS idle_minutes, 'WARNING' AS severity,
          vehicle_id || ' idle for ' || CAST((idle_micros + 3000000) // 6000000 // 10 AS VARCHAR) || '.' ||
            CAST((idle_micros + 3000000) // 6000000 % 10 AS VARCHAR) || ' minutes (threshold 720m)' AS message, created_at
        FROM alerts""",
    "raw_slots": """
        SELECT CAST(floor(epoch_us(event_ts) / 300000000) AS BIGINT) AS interval_id, count(*) AS raw_rows
        FROM telemetry GROUP BY ALL""",
    "valid_slots": """
        SELECT CAST(floor(epoch_us(event_ts) / 300000000) AS BIGINT) AS interval_id, count(*) AS valid_rows,
          max(event_ts) AS last_event_ts FROM cleaned GROUP BY ALL""",
    "grid": """
        SELECT unnest(generate_series(CAST(floor(epoch_us(lo) / 86400000000) AS BIGINT) * 288,
                                      CAST(floor(epoch_us(hi) / 86400000000) AS BIGINT) * 288 + 287)) AS interval_id
        FROM (SELECT min(event_ts) AS lo, max(event_ts) AS hi FROM telemetry)""",
    "slots": """
        SELECT g.interval_id, coalesce(r.raw_rows, 0) AS raw_rows, coalesce(v.valid_rows, 0) AS valid_rows, v.last_event_ts,
          sum(CASE WHEN r.raw_rows > 0 THEN 1 ELSE 0 END) OVER (ORDER BY g.interval_id ROWS UNBOUNDED PRECEDING) AS run
        FROM grid g LEFT JOIN raw_slots r USING (interval_id) LEFT JOIN valid_slots v USING (interval_id)""",
    "streaks": """
        SELECT interval_id, raw_rows, valid_rows, last_event_ts,
          CAST(sum(CASE WHEN raw_rows = 0 THEN 1 ELSE 0 END)
            OVER (PARTITION BY run ORDER BY interval_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS empty_streak
        FROM slots""",
    "health": """
        SELECT *, CASE status WHEN 'HEALTHY' THEN 'streaming batch processed'
            WHEN 'PARSE_EMPTY' THEN 'kafka messages did not parse into valid telemetry'
            WHEN 'NO_DATA' THEN 'no telemetry for ' || CAST(empty_streak AS VARCHAR) || ' consecutive batches'
            ELSE 'empty batch streak=' || CAST(empty_streak AS VARCHAR) END AS message
        FROM (SELECT *, CASE WHEN valid_rows > 0 THEN 'HEALTHY' WHEN raw_rows > 0 THEN 'PARSE_EMPTY'
                WHEN empty_streak >= 6 THEN 'NO_DATA' ELSE 'WAITING' END AS status FROM streaks)""",
    "trip_ends": """
        SELECT trip_id, driver_id, vehicle_id, status, event_ts FROM silver WHERE trip_id <> ''
        QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY event_ts DESC, event_id DESC) = 1""",
    "trip_figures": """
        SELECT trip_id, avg(CASE WHEN status <> 'idle' THEN speed END) AS avg_speed,
          max(CASE WHEN status <> 'idle' THEN speed END) AS max_speed, max(fare) AS final_fare, min(event_ts) AS start_time
        FROM silver WHERE trip_id <> '' GROUP BY trip_id""",
    "trip_days": """
        SELECT CAST(event_ts AS DATE) AS summary_date, trip_id, CAST(max(fare) AS DECIMAL(12, 2)) AS fare,
          arg_max(status, {'at': event_ts, 'id': event_id}) AS last_status,
          sum(CASE WHEN status <> 'idle' THEN speed END) AS speed_sum,
          count(CASE WHEN status <> 'idle' THEN speed END) AS speed_rows
        FROM silver WHERE trip_id <> '' GROUP BY ALL""",
    "framed": """
        SELECT time_bucket(INTERVAL '6 hours', event_ts, TIMESTAMP '1970-01-01') AS window_start, * FROM silver""",
    "framed_fares": """
        SELECT window_start, zone_id, time_of_day, CAST(sum(fare) AS DOUBLE) AS trip_fare_sum
        FROM (SELECT window_start, zone_id, time_of_day, trip_id, CAST(max(fare) AS DECIMAL(12, 2)) AS fare
              FROM framed WHERE trip_id IS NOT NULL GROUP BY ALL) GROUP BY ALL""",
}

# What each subquery reads, in the order it must be defined.
_NEEDS = {
    "cleaned": ["telemetry"],
    "silver": ["cleaned"],
    "expense_days": ["expense_rows"],
    "newest": ["silver"],
    "zones": ["newest", "silver"],
    "earned": ["silver"],
    "profitability": ["expense_days", "earned"],
    "flagged": ["silver"],
    "islands": ["flagged"],
    "idling": ["islands"],
    "alerts": ["idling"],
    "alert_rows": ["alerts"],
    "raw_slots": ["telemetry"],
    "valid_slots": ["cleaned"],
    "grid": ["telemetry"],
    "slots": ["grid", "raw_slots", "valid_slots"],
    "streaks": ["slots"],
    "health": ["streaks"],
    "trip_ends": ["silver"],
    "trip_figures": ["silver"],
    "trip_days": ["silver"],
    "framed": ["silver"],
    "framed_fares": ["framed"],
    "states": ["newest", "idling"],
    "trip_rows": ["trip_ends", "trip_figures"],
    "day_rows": ["trip_days", "expense_days"],
    "window_rows": ["framed_fares"],
    "fleet_row": ["newest"],
    "zone_parts": ["newest"],
}


def _filled(columns: str) -> dict[str, str]:
    return {f"{c} not null": f"{c} IS NULL" for c in columns.split()}


def _positive(columns: str) -> dict[str, str]:
    return {f"{c} >= 0": f"{c} < 0" for c in columns.split()}


_A_STATUS = {"status in idle|enroute|on_trip": "status NOT IN ('idle', 'enroute', 'on_trip')"}
_ZONE_COUNTS = "active_vehicles trips_in_window live_fare_exposure event_count"
_FLEET_COUNTS = "idle_vehicles idle_ratio trips_per_hour"

# Rows that break a rule of a result table, and the key that must be unique.
_RESULT_RULES = {
    ("silver", "silver", "event_id"): {
        **_filled("driver_id vehicle_id speed status fare event_ts"),
        **_A_STATUS,
        **_positive("speed fare"),
    },
    ("fleet_snapshot", "fleet_row", ""): _filled(f"window_start window_end total_vehicles {_ZONE_COUNTS} {_FLEET_COUNTS}"),
    ("zone_snapshot", "zones", "zone_id, time_of_day"): _filled(f"zone_id time_of_day {_ZONE_COUNTS}"),
    ("zone_windows", "window_rows", "window_start, zone_id, time_of_day"): _filled(
        f"window_start window_end zone_id time_of_day {_ZONE_COUNTS} {_FLEET_COUNTS}"
    ),
    ("vehicle_state", "states", "vehicle_id"): {
        **_filled("vehicle_id status last_event_ts idle_alert_sent"),
        **_A_STATUS,
    },
    ("alerts", "alert_rows", ""): _filled("alert_type severity message created_at"),
    ("health", "health", "interval_id"): _filled("status message empty_streak raw_rows valid_rows"),
    ("vehicle_profitability", "profitability", "report_date, vehicle_id"): {
        **_filled("report_date vehicle_id trip_count earnings fuel_cost maintenance_cost distance_covered profit"),
        **_filled("service_flag unprofitable"),
        **_positive("trip_count earnings fuel_cost maintenance_cost"),
    },
    ("trip_analytics", "trip_rows", "trip_id"): {
        **_filled("driver_id vehicle_id trip_status start_time"),
        **_positive("avg_speed max_speed final_fare"),
        "trip_status in enroute|on_trip|completed": "trip_status NOT IN ('enroute', 'on_trip', 'completed')",
    },
    ("daily_summary", "day_rows", "summary_date"): _positive(
        "total_trips completed_trips average_speed total_revenue total_expenses"
    ),
}


def _result_rule_counts() -> str:
    selects = []
    for (table, part, key), rules in _RESULT_RULES.items():
        for rule, broken in rules.items():
            selects.append(f"SELECT '{table}' AS table_name, '{rule}' AS rule, count(*) AS violations FROM {part} WHERE {broken}")
        if not key:
            continue
        selects.append(
            f"SELECT '{table}', '{key} unique', count(*) - (SELECT count(*) FROM (SELECT DISTINCT {key} FROM {part})) FROM {part}"
        )
    return "\nUNION ALL ".join(selects)


def _statement(final: str, *parts: str) -> str:
    order: list[str] = []

    def add(name: str) -> None:
        for needed in _NEEDS.get(name, []):
            add(needed)
        if name not in order:
            order.append(name)

    for part in parts:
        add(part)
    named = ",\n".join(f"{name} AS ({_PARTS[name].strip()})" for name in order)
    return f"WITH {named}\n{final}" if named else final


def _stored(value: str, scale: int = 2) -> str:
    """A double as a table of that many decimals holds it, rounded half up in its decimal text."""
    return f"CAST(CAST(CAST({value} AS VARCHAR) AS DECIMAL(28, {scale})) AS DOUBLE)"


_ZONE_WINDOWS = """
SELECT window_start, window_start + INTERVAL '6 hours' AS window_end, zone_id, time_of_day,
  count(DISTINCT CASE WHEN status <> 'idle' THEN vehicle_id END) AS active_vehicles,
  count(DISTINCT CASE WHEN status = 'idle' THEN vehicle_id END) AS idle_vehicles,
  round(CAST(count(DISTINCT CASE WHEN status = 'idle' THEN vehicle_id END) AS DOUBLE) / count(DISTINCT vehicle_id), 4) AS idle_ratio,
  count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) AS trips_in_window,
  round(count(DISTINCT CASE WHEN status = 'on_trip' THEN trip_id END) * (CAST(3600 AS DOUBLE) / 21600), 4) AS trips_per_hour,
  round(avg(speed), 4) AS avg_speed, max(fare) AS live_fare_exposure, count(*) AS event_count,
  coalesce(any_value(trip_fare_sum), 0) AS trip_fare_sum
FROM framed LEFT JOIN framed_fares USING (window_start, zone_id, time_of_day)
GROUP BY window_start, zone_id, time_of_day"""

_WINDOW_SPEEDS = f"""
SELECT w.*, r.raw_speed FROM ({_ZONE_WINDOWS}) w
JOIN (SELECT window_start, zone_id, time_of_day, avg(speed) AS raw_speed FROM framed GROUP BY ALL) r
  USING (window_start, zone_id, time_of_day)"""

# A sketched count is compared with the exact one where it is made; here it must simply be near.
_SKETCHED = """
SELECT window_start, window_end, zone_id, time_of_day, {speed} AS avg_speed, live_fare_exposure, event_count,
  true AS active_vehicles_near, true AS idle_vehicles_near, true AS trips_in_window_near
FROM (SELECT w.*, r.raw_speed FROM ({rows}) w
      JOIN (SELECT window_start, zone_id, time_of_day, avg(speed) AS raw_speed FROM framed GROUP BY ALL) r
        USING (window_start, zone_id, time_of_day))"""

_FLEET = """
SELECT v.*, round(CAST(v.idle_vehicles AS DOUBLE) / v.total_vehicles, 4) AS idle_ratio, t.trips_in_window,
  round(t.trips_in_window * (CAST(3600 AS DOUBLE) / 2592000), 4) AS trips_per_hour, f.live_fare_exposure
FROM (SELECT count(DISTINCT vehicle_id) AS total_vehicles, count(*) FILTER (WHERE status <> 'idle') AS active_vehicles,
        count(*) FILTER (WHERE status = 'idle') AS idle_vehicles, round(avg(speed), 4) AS avg_speed,
        count(*) AS event_count, min(event_ts) AS window_start, max(event_ts) AS window_end FROM newest) v,
     (SELECT count(DISTINCT trip_id) AS trips_in_window FROM silver WHERE status = 'on_trip') t,
     (SELECT CAST(sum(trip_fare) AS DOUBLE) AS live_fare_exposure
      FROM (SELECT CAST(max(fare) AS DECIMAL(12, 2)) AS trip_fare FROM silver WHERE trip_id IS NOT NULL GROUP BY trip_id)) f"""

_RULES = {
    "driver_id not null": "driver_id IS NULL",
    "vehicle_id not null": "vehicle_id IS NULL",
    "lat not null": "lat IS NULL",
    "lon not null": "lon IS NULL",
    "speed not null": "speed IS NULL",
    "status not null": "status IS NULL",
    "fare not null": "fare IS NULL",
    "event_ts not null": "event_ts IS NULL",
    "status in idle|enroute|on_trip": "status NOT IN ('idle', 'enroute', 'on_trip')",
    "speed >= 0": "speed < 0",
    "fare >= 0": "fare < 0",
}

_RULE_COUNTS = (
    "\nUNION ALL ".join(
        f"SELECT '{rule}' AS rule, count(*) AS violations FROM telemetry WHERE {broken}" for rule, broken in _RULES.items()
    )
    + "\nUNION ALL SELECT 'event_id unique', count(*) - count(DISTINCT event_id) FROM telemetry"
)

_STATES = """
SELECT n.vehicle_id, n.driver_id, n.status, n.zone_id, n.lat, n.lon, i.idle_since, n.event_ts AS last_event_ts,
  coalesce(epoch_us(n.event_ts) - epoch_us(i.idle_since) >= CAST(720 AS BIGINT) * 60000000, false) AS idle_alert_sent
FROM newest n LEFT JOIN idling i USING (event_id)"""

_TRIPS = """
SELECT e.trip_id, e.driver_id, e.vehicle_id, round(coalesce(f.avg_speed, 0), 4) AS avg_speed,
  coalesce(f.max_speed, 0) AS max_speed, f.final_fare,
  CASE WHEN e.status = 'idle' THEN 'completed' ELSE e.status END AS trip_status,
  f.start_time, CASE WHEN e.status = 'idle' THEN e.event_ts END AS end_time
FROM trip_ends e JOIN trip_figures f USING (trip_id)"""

_DAYS = """
SELECT coalesce(r.summary_date, c.report_date) AS summary_date, coalesce(r.total_trips, 0) AS total_trips,
  coalesce(r.completed_trips, 0) AS completed_trips, round(coalesce(r.average_speed, 0), 4) AS average_speed,
  CAST(coalesce(r.revenue, 0) AS DOUBLE) AS total_revenue, CAST(coalesce(c.costs, 0) AS DOUBLE) AS total_expenses,
  CAST(coalesce(r.revenue, 0) - coalesce(c.costs, 0) AS DOUBLE) AS net_revenue
FROM (SELECT summary_date, count(*) AS total_trips, count(*) FILTER (WHERE last_status = 'idle') AS completed_trips,
        sum(speed_sum) / sum(speed_rows) AS average_speed, sum(fare) AS revenue FROM trip_days GROUP BY summary_date) r
FULL JOIN (SELECT report_date, sum(fuel_cost + maintenance_cost) AS costs FROM expense_days GROUP BY report_date) c
  ON r.summary_date = c.report_date"""

_MESSAGES = """
SELECT vehicle_id AS key,
  '{"alert_type":"' || alert_type || '","vehicle_id":"' || vehicle_id || '","driver_id":"' || driver_id ||
  '","zone_id":"' || zone_id || '","idle_minutes":' || CAST(idle_minutes AS VARCHAR) || ',"severity":"' || severity ||
  '","message":"' || message || '","created_at":"' || strftime(created_at, '%Y-%m-%dT%H:%M:%S.%f') || '+00:00"}' AS value
FROM alert_rows"""


# Dates are compared as text, for the engines hand them to Python as different types.
_DATE_COLUMNS = {
    "report_date": (
        "daily_earnings daily_earnings_incremental vehicle_profitability profit_by_date profit_latest vehicle_profit_on vehicle_profit_latest"
        " profit_summary loss_leaders unreconciled_vehicles daily_job rows_per_date expense_history"
    ).split(),
    "summary_date": ["daily_summary"],
}


def oracle_sql() -> dict[str, str]:
    statements = _statements()
    for column, names in _DATE_COLUMNS.items():
        for name in names:
            statements[name] = f"SELECT * REPLACE (CAST({column} AS VARCHAR) AS {column}) FROM ({statements[name]})"
    return statements


def _statements() -> dict[str, str]:
    s = _statement
    _PARTS.update(fleet_row=_FLEET, window_rows=_ZONE_WINDOWS, states=_STATES, trip_rows=_TRIPS, day_rows=_DAYS)
    return {
        "parse_props": "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events",
        "parse_telemetry": s(
            "SELECT * EXCLUDE (event_ts), strftime(event_ts, '%Y-%m-%dT%H:%M:%S.%f') AS timestamp,"
            " event_ts AS kafka_ts FROM telemetry",
            "telemetry",
        ),
        "clean_telemetry": s("SELECT * FROM cleaned", "cleaned"),
        "zone_assign": s("SELECT event_id, lat, lon, event_ts, zone_id, time_of_day FROM silver", "silver"),
        "silver": s("SELECT * FROM silver", "silver"),
        "reject_reasons": s(
            "SELECT CASE WHEN coalesce(trim(vehicle_id), '') = '' THEN 'blank_vehicle'"
            " WHEN event_ts IS NULL THEN 'bad_event_time'"
            " WHEN coalesce(lower(trim(status)), '') NOT IN ('idle', 'enroute', 'on_trip') THEN 'unknown_status'"
            " ELSE 'accepted' END AS reason, count(*) AS row_count FROM telemetry GROUP BY ALL",
            "telemetry",
        ),
        "out_of_bounds_counts": s(
            "SELECT status, count(*) AS row_count, count(*) FILTER (WHERE inside) AS inside_rows,"
            " count(*) FILTER (WHERE NOT inside) AS outside_rows FROM (SELECT lower(trim(status)) AS status,"
            f" coalesce(lat >= {_d('6.85')} AND lat <= {_d('7.00')} AND lon >= {_d('79.80')} AND lon <= {_d('79.95')},"
            " false) AS inside FROM telemetry) GROUP BY status",
            "telemetry",
        ),
        "expenses_clean": s(
            "SELECT vehicle_id, CAST(fuel_cost AS DOUBLE) AS fuel_cost, CAST(maintenance_cost AS DOUBLE) AS maintenance_cost,"
            " distance_covered, service_flag FROM expense_rows",
            "expense_rows",
        ),
        "latest_per_vehicle": s("SELECT * FROM newest", "newest"),
        "trip_fares": s(
            "SELECT trip_id, max(fare) AS trip_fare FROM silver WHERE trip_id IS NOT NULL GROUP BY trip_id", "silver"
        ),
        "fleet_snapshot": s(_FLEET, "newest"),
        "zone_snapshot": s("SELECT * FROM zones", "zones"),
        "zone_ranking": s(
            "SELECT *, row_number() OVER (ORDER BY live_fare_exposure DESC, zone_id, time_of_day) AS rank FROM zones",
            "zones",
        ),
        "daily_earnings": s("SELECT * REPLACE (CAST(earnings AS DOUBLE) AS earnings) FROM earned", "earned"),
        "zone_windows": s(_ZONE_WINDOWS, "framed_fares"),
        "zone_windows_corrected": s(
            f"SELECT * FROM ({_ZONE_WINDOWS}) WHERE window_end <= (SELECT max(event_ts) - INTERVAL 2 MINUTE FROM silver)", "framed_fares"
        ),
        "zone_windows_united": s(_SKETCHED.format(rows=_ZONE_WINDOWS, speed="avg_speed"), "framed_fares"),
        "daily_earnings_incremental": s("SELECT * REPLACE (CAST(earnings AS DOUBLE) AS earnings) FROM earned", "earned"),
        "live_rejects": s(
            "SELECT * FROM (SELECT CASE WHEN coalesce(trim(vehicle_id), '') = '' THEN 'blank_vehicle'"
            " WHEN event_ts IS NULL THEN 'bad_event_time'"
            " WHEN coalesce(lower(trim(status)), '') NOT IN ('idle', 'enroute', 'on_trip') THEN 'unknown_status' END AS reason,"
            " count(*) AS row_count FROM telemetry GROUP BY ALL) WHERE reason IS NOT NULL",
            "telemetry",
        ),
        "late_events": (
            "SELECT * FROM (SELECT *, max(event_ts) OVER (ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS max_event_ts"
            " FROM (SELECT event_id, user_id, CASE WHEN event_id % 17 = 0 THEN ts - INTERVAL 1 HOUR ELSE ts END AS event_ts"
            " FROM events)) WHERE event_ts < max_event_ts - INTERVAL 2 MINUTE"
        ),
        "idle_episodes": s(
            "SELECT vehicle_id, idle_since, max(event_ts) AS last_idle_ts, count(*) AS event_count,"
            " epoch_us(max(event_ts)) - epoch_us(idle_since) AS idle_micros"
            " FROM idling GROUP BY vehicle_id, island, idle_since",
            "idling",
        ),
        "idle_alerts": s("SELECT * FROM alert_rows", "alert_rows"),
        "alert_messages": s(_MESSAGES, "alert_rows"),
        "recent_alerts": s("SELECT * FROM alert_rows ORDER BY created_at DESC, vehicle_id LIMIT 50", "alert_rows"),
        "batch_health": s("SELECT * FROM health", "health"),
        "health_outside": s(
            "SELECT count(*) AS raw_rows, count(*) FILTER (WHERE event_ts IS NULL) AS undated_rows,"
            " count(*) FILTER (WHERE event_ts < TIMESTAMP '2000-01-01') AS early_rows,"
            " count(*) FILTER (WHERE CAST(event_ts AS DATE) > current_date + 1) AS late_rows FROM telemetry",
            "telemetry",
        ),
        "stream_progress": "SELECT * FROM (SELECT 'progress' AS event, count(*) AS input_rows,"
        " CAST(1 AS BIGINT) AS queries, CAST(0 AS BIGINT) AS failures FROM events"
        " UNION ALL SELECT 'started', 0, 1, 0 UNION ALL SELECT 'terminated', 0, 1, 0)",
        "health_latest": s("SELECT * FROM health ORDER BY interval_id DESC LIMIT 1", "health"),
        "no_data_alerts": s(
            "SELECT 'NO_DATA' AS alert_type, CAST(NULL AS VARCHAR) AS vehicle_id, CAST(NULL AS VARCHAR) AS driver_id,"
            " CAST(NULL AS VARCHAR) AS zone_id, CAST(NULL AS DOUBLE) AS idle_minutes, 'CRITICAL' AS severity, message,"
            " interval_id FROM health WHERE empty_streak = 6",
            "health",
        ),
        "vehicle_status": s(_STATES, "newest", "idling"),
        "upsert_vehicle_state": s(_STATES, "newest", "idling"),
        "live_vehicle_status": s(_STATES, "newest", "idling"),
        # an alert comes out once the watermark has passed its event
        "idle_alerts_stream": s(
            "SELECT * FROM alert_rows WHERE created_at < (SELECT date_trunc('milliseconds', max(event_ts)) - INTERVAL 2 MINUTE FROM silver)",
            "alert_rows",
            "silver",
        ),
        "stored_streaks": s(
            f"SELECT n.vehicle_id, i.idle_since, n.event_ts AS last_event_ts,"
            f" coalesce(epoch_us(n.event_ts) - epoch_us(i.idle_since) >= {_IDLE_MICROS}, false) AS idle_alert_sent"
            " FROM (SELECT * FROM silver"
            "   WHERE event_ts < (SELECT date_trunc('milliseconds', max(event_ts)) - INTERVAL 2 MINUTE FROM silver)"
            "   QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY event_ts DESC, event_id DESC) = 1) n"
            " LEFT JOIN idling i USING (event_id)",
            "idling",
            "silver",
        ),
        "live_recent_alerts": s("SELECT * FROM alert_rows ORDER BY created_at DESC, vehicle_id LIMIT 50", "alert_rows"),
        "live_zones": s(
            f"SELECT * EXCLUDE (avg_speed), (SELECT {_stored('avg(speed)')} FROM newest n"
            " WHERE n.zone_id = z.zone_id AND n.time_of_day = z.time_of_day) AS avg_speed FROM zones z",
            "zones",
            "newest",
        ),
        "live_fleet": s(
            f"SELECT * REPLACE ({_stored('avg_speed')} AS avg_speed, {_stored('trips_per_hour')} AS trips_per_hour) FROM ({_FLEET})",
            "newest",
        ),
        "live_health": s(
            "SELECT 'HEALTHY' AS status, 'streaming batch processed' AS message, CAST(0 AS BIGINT) AS empty_streak,"
            " (SELECT count(*) FROM telemetry) AS raw_rows, count(*) AS valid_rows, max(event_ts) AS last_event_ts,"
            " CAST(0 AS BIGINT) AS last_batch_id FROM cleaned",
            "cleaned",
        ),
        "zone_windows_approx": s(_SKETCHED.format(rows=_ZONE_WINDOWS, speed="avg_speed"), "framed_fares"),
        "zone_windows_stream": s(_SKETCHED.format(rows=_ZONE_WINDOWS, speed=_stored("raw_speed")), "framed_fares"),
        "rows_per_date": s("SELECT report_date, count(*) AS row_count FROM profitability GROUP BY report_date", "profitability"),
        "expense_history": s(
            "SELECT report_date, vehicle_id, CAST(fuel_cost AS DOUBLE) AS fuel_cost, CAST(maintenance_cost AS DOUBLE) AS"
            " maintenance_cost, distance_covered, service_flag FROM expense_days"
            " WHERE report_date IN (DATE '2024-01-14', DATE '2024-01-15')",
            "expense_days",
        ),
        # only windows the watermark has passed are final
        "zone_windows_final_stream": s(
            f"SELECT * EXCLUDE (raw_speed, trip_fare_sum) REPLACE ({_stored('raw_speed')} AS avg_speed,"
            f" {_stored('trips_per_hour')} AS trips_per_hour) FROM ({_WINDOW_SPEEDS}) WHERE window_end <="
            " (SELECT max(event_ts) - INTERVAL 2 MINUTE FROM silver)",
            "framed_fares",
        ),
        "vehicle_profitability": s("SELECT * FROM profitability", "profitability"),
        "profit_by_date": s("SELECT * FROM profitability WHERE report_date = DATE '2024-01-15'", "profitability"),
        "profit_latest": s(
            "SELECT * FROM profitability WHERE report_date = (SELECT max(report_date) FROM profitability)", "profitability"
        ),
        "vehicle_profit_on": s(
            "SELECT * FROM profitability WHERE vehicle_id = 'V00042' AND report_date = DATE '2024-01-15'", "profitability"
        ),
        "vehicle_profit_latest": s(
            "SELECT * FROM profitability QUALIFY row_number() OVER (PARTITION BY vehicle_id ORDER BY report_date DESC) = 1",
            "profitability",
        ),
        "profit_summary": s(
            "SELECT report_date, count(*) AS vehicles, count(*) FILTER (WHERE unprofitable) AS unprofitable_vehicles"
            " FROM profitability GROUP BY report_date",
            "profitability",
        ),
        "loss_leaders": s("SELECT * FROM profitability ORDER BY profit, report_date, vehicle_id", "profitability"),
        "unreconciled_vehicles": s(
            "SELECT report_date, vehicle_id, CAST(earnings AS DOUBLE) AS earnings, trip_count FROM earned g WHERE NOT EXISTS"
            " (SELECT 1 FROM expense_days e WHERE NOT e.unfiled AND e.report_date = g.report_date AND e.vehicle_id = g.vehicle_id)",
            "earned",
            "expense_days",
        ),
        "trip_analytics": s(_TRIPS, "trip_ends", "trip_figures"),
        "daily_summary": s(_DAYS, "trip_days", "expense_days"),
        "rule_violations": s(_RULE_COUNTS, "telemetry"),
        "result_rule_violations": s(
            _result_rule_counts(), *[part for _, part, _ in _RESULT_RULES]
        ),
        "daily_job": s("SELECT * FROM profitability WHERE report_date = DATE '2024-01-15'", "profitability"),
    }
