"""Rejected rows kept with their reason, and a replay of those that the rules accept now.

Each micro-batch logs the rows it rejected under its run and batch, beside the rows it accepted, so the two make up the batch. A
replay first notes, as a table of its own and in one step, what it found and how the rules judge it now; then it adds the accepted rows
to silver under a run of its own, leaves the rest in the log and gives up its note. All of that depends on the note alone, so a
replay that broke off is taken up by the next one and adds each row once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadbook.contract import REJECTED
from roadbook.operators import clean
from roadbook.sinks import files, tables

_KEYS = ["reject_date", "run", "batch_id"]
_RAW = [f.name for f in REJECTED.fields if f.name != "reject_reason"]


def rejected_rows(parsed: DataFrame) -> DataFrame:
    """The rows that cleaning leaves out, as they came, with the first rule they break."""
    missing = {f.name: F.lit(None).cast(f.dataType) for f in REJECTED.fields if f.name not in parsed.columns}
    rows = parsed.withColumns(missing).withColumn("raw", F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in REJECTED.fields]))
    marked = clean.with_reject_reason(rows.drop("reject_reason")).where(F.col("reject_reason").isNotNull())
    return marked.select(*[F.col("raw")[n].alias(n) for n in _RAW], "reject_reason")


def append_rejected(parsed: DataFrame, path: str, batch_id: int, run: str = tables.FIRST_RUN) -> None:
    rows = rejected_rows(parsed).withColumn("reject_date", F.to_date("kafka_ts"))
    tables.append_batch(rows, path, batch_id, "reject_date", run=run)


def read_rejected(spark: SparkSession, path: str) -> DataFrame:
    return tables.read_table(spark, path, REJECTED, reject_date=T.DateType(), **tables.KEY_KINDS)


def replay(
    spark: SparkSession,
    path: str,
    silver_path: str,
    silver: Callable[[DataFrame], DataFrame] = clean.silver,
    reason: Callable[[DataFrame], DataFrame] = clean.with_reject_reason,
) -> int:
    """Move the logged rows that ``reason`` accepts now to the silver log; their number."""
    note = f"{path}_replay"
    if not _noted(spark, note):
        rows = read_rejected(spark, path).withColumn("raw", F.struct(*_RAW)).drop("reject_reason")
        judged = reason(rows).select("raw.*", "reject_reason", *_KEYS)
        tables.replace_version(judged, note, 0, files.new_run())
    names = _noted(spark, note)
    if not names:
        return 0
    run = names[0].removeprefix("v-").rsplit("-", 1)[0]
    kinds = [T.StructField("reject_date", T.DateType()), *[T.StructField(n, k) for n, k in tables.KEY_KINDS.items()]]
    judged = spark.read.schema(T.StructType([*REJECTED.fields, *kinds])).parquet(f"{note}/{names[0]}")
    good = judged.where(F.col("reject_reason").isNull())
    moved = good.count()
    if moved:
        tables.append_silver(silver(good.select(*_RAW)), silver_path, 0, run)
        touched = good.select(*_KEYS).distinct()
        rest = judged.where(F.col("reject_reason").isNotNull())
        tables.write_partitions(rest.join(touched, _KEYS, "left_semi"), path, *_KEYS)
        for key in touched.join(rest.select(*_KEYS), _KEYS, "left_anti").toLocalIterator():  # folders that no row is left for
            date = key["reject_date"] or "__HIVE_DEFAULT_PARTITION__"
            files.remove(spark, f"{path}/reject_date={date}/run={key['run']}/batch_id={key['batch_id']}")
    files.remove(spark, note)
    return moved


def _noted(spark: SparkSession, note: str) -> list[str]:
    return [n for n in files.children(spark, note) if n.startswith("v-")]
