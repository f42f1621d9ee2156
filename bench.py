"""Headline query times as one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the cores. Each query runs once to warm up
and then three times; the median counts. Results go to Spark's ``noop`` sink, so the whole
result is computed but not collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from roadbook.plans.catalogue import queries  # noqa: E402
from roadbook.session import open_session  # noqa: E402

HEADLINE = (
    "vehicle_profitability",
    "fleet_snapshot",
    "zone_snapshot",
    "zone_windows",
    "zone_windows_approx",
    "idle_episodes",
    "idle_alerts",
    "vehicle_status",
    "batch_health",
    "late_events",
    "trip_analytics",
    "daily_summary",
    "parse_telemetry",
    "silver",
    "result_rule_violations",
    "upsert_vehicle_state",
    "daily_job",
    "live_fleet",
    "idle_alerts_stream",
    "zone_windows_stream",
    "zone_windows_united",
    "daily_earnings_incremental",
)
RUNS = 3


def seconds(spark, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = open_session(
        "roadbook-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"),
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, times = queries(), {}
    for name in HEADLINE:
        seconds(spark, registered[name], sf_dir)
        times[name] = round(statistics.median(seconds(spark, registered[name], sf_dir) for _ in range(RUNS)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, median warm run, summed",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
