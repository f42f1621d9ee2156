"""Merging the many small files of batch logs, beside running streams and readers.

All rows of a date become one version of that date's partition in a folder beside the log, named in one step;
``sources/logs.py`` says how the two are read together. Files of the log that a merge has covered are removed by a later
call, when no reader can be at them any more. A merge that broke off leaves nothing that is read.
"""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadbook.sinks import files, tables
from roadbook.sources import logs

_DATE = re.compile(r"\d{4}-\d\d-\d\d$")


def _until(run: str, batch_id: int) -> Column:
    """Rows of the log up to a run and batch; runs order by name."""
    return (F.col("run") < F.lit(run)) | ((F.col("run") == F.lit(run)) & (F.col("batch_id") <= F.lit(batch_id)))


def merge_dates(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    date_column: str,
    before: dt.date,
    order: tuple[str, ...] = (),
    keep_seconds: float = tables.KEEP_SECONDS,
) -> list[str]:
    """Merge each date before ``before`` that has unmerged batches, remove what an older merge covers.

    Safe to repeat. A merge takes the batches that are complete when it starts; later ones stay in the log.
    """
    done = []
    for date, name in sorted(logs.dates(spark, path, date_column).items()):
        if not _DATE.match(date) or date >= before.isoformat():
            continue
        found = logs.batches(spark, f"{path}/{name}")
        target = f"{logs.merged_folder(path)}/{name}"
        newest = logs.newest_version(spark, target)
        last = max(found, default=None)
        if last is not None and (newest is None or last > newest[0]):
            run, number = last.removeprefix("v-").rsplit("-", 1)
            rows = logs.read_log(spark, path, schema, date_column, dt.date.fromisoformat(date))
            laid_out = _laid_out(rows.where(_until(run, int(number))).drop(date_column), order)
            tables.replace_version(laid_out, target, int(number), run, keep_seconds, f"{logs.UPTO}=")
            done.append(date)
        elif newest is not None and newest[1] > keep_seconds:
            for batch, folder in found.items():
                if batch <= newest[0]:
                    files.remove(spark, folder)
    return done


def _laid_out(rows: DataFrame, order: tuple[str, ...]) -> DataFrame:
    sized = rows.hint("rebalance")
    return sized.sortWithinPartitions(*order) if order else sized
