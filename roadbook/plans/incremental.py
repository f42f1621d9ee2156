"""Results per date kept up to date from the live log.

A mark says, per date, up to which run and batch the stored result goes. A refresh looks at folder names only to find the
dates with later batches, reads those dates, replaces their partitions and then moves their marks. A refresh that
broke off left the marks behind, so it is done again. Dates without new batches are neither read nor written.
"""

from __future__ import annotations

import datetime as dt
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from roadbook.contract import MARKS, SILVER
from roadbook.operators import earnings
from roadbook.sinks import tables
from roadbook.sources import logs


def newest_places(spark: SparkSession, path: str, date_column: str = "event_date") -> dict[str, str]:
    """Per date the newest run and batch that the log or its merged version holds."""
    found: dict[str, str] = {}
    for date, name in logs.dates(spark, path, date_column).items():
        if held := logs.batches(spark, f"{path}/{name}"):
            found[date] = max(held)
    merged = logs.merged_folder(path)
    for date, name in logs.dates(spark, merged, date_column).items():
        if version := logs.newest_version(spark, f"{merged}/{name}"):
            found[date] = max(found.get(date, ""), version[0])
    return {date: place for date, place in found.items() if date[:1].isdigit()}


def earnings_of(silver: DataFrame, days: list[dt.date]) -> DataFrame:
    return earnings.daily_earnings(silver)


def refresh(
    spark: SparkSession,
    silver: str,
    output: str,
    compute: Callable[[DataFrame, list[dt.date]], DataFrame] = earnings_of,
    partition: str = "report_date",
) -> list[dt.date]:
    """Bring the table at ``output``, partitioned by date, up to the log at ``silver``; the dates that were redone.

    ``compute`` gives the rows of some dates from all events of these dates.
    """
    marks = f"{output}_marks"
    known = {r["date"]: r["place"] for r in tables.read_version(spark, marks, MARKS).collect()}  # one row per date
    newest = newest_places(spark, silver)
    touched = [dt.date.fromisoformat(d) for d, place in sorted(newest.items()) if place > known.get(d, "")]
    if touched:
        rows = compute(logs.read_log(spark, silver, SILVER, "event_date", touched), touched)
        tables.write_partitions(rows, output, partition)
        moved = sorted((known | {d.isoformat(): newest[d.isoformat()] for d in touched}).items())
        tables.replace_version(spark.createDataFrame(moved, MARKS), marks, time.time_ns() // 1_000_000)
    return touched
