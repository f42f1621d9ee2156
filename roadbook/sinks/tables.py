"""Parquet result tables.

Four ways to write, all of them safe to repeat:

* batch log: every micro-batch owns the partition of its run and batch id;
* version: a small table is written whole beside its older versions and then given its
  name in one step; readers open the newest named one and nothing else;
* buckets: a keyed table is cut by a hash of its key; a write replaces the buckets it touches by a version of its own
  and leaves the others alone, so its cost follows the keys that changed;
* one partition: a date is replaced, other dates stay as they are.

A run is the life of one checkpoint. Its name is part of every key, so a stream that starts anew with a new
checkpoint, and thus with batch 0, adds to the tables and replaces nothing.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadbook.operators.latest import latest_by_key
from roadbook.sinks import files

FIRST_RUN = "r0"  # of tables that no stream writes
KEY_KINDS = {"run": T.StringType(), "batch_id": T.LongType()}  # partitions of a batch log
BUCKETS = 16  # of a keyed table
KEEP_SECONDS = 3600.0  # how long a replaced version can still be read


def finalise(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Columns of ``schema`` in its types; missing NOT NULL numbers and flags become 0 and false.

    Fractions are rounded half up to the declared scale, as a NUMERIC column would. Only a
    null gets the default: a value that does not fit its type fails the write. Columns of load
    times that the frame lacks are filled with the current time.
    """
    return df.select(*[_column(field, field.name in df.columns) for field in schema.fields])


def _column(field: T.StructField, given: bool) -> Column:
    if not given:
        return F.current_timestamp().cast(field.dataType).alias(field.name)
    value = F.col(field.name)
    column = value.try_cast(field.dataType)
    misfit = F.raise_error(F.concat(F.lit(f"{field.name} does not fit {field.dataType.simpleString()}: "), value.cast("string")))
    column = F.when(value.isNotNull() & column.isNull(), misfit.cast(field.dataType)).otherwise(column)
    if not field.nullable:
        default = F.lit(False) if isinstance(field.dataType, T.BooleanType) else F.lit(0)
        column = F.coalesce(column, default.cast(field.dataType))
    return column.alias(field.name)


def _write(df: DataFrame, path: str, *partitions: str) -> None:
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partitions).parquet(path)


def write_partitions(df: DataFrame, path: str, *partitions: str) -> None:
    """Replace the partitions that ``df`` holds and leave the others as they are."""
    _write(df, path, *partitions)


def _keys(batch_id: int, run: str) -> dict[str, Column]:
    return {"run": F.lit(run), "batch_id": F.lit(batch_id).cast("bigint")}


def append_batch(df: DataFrame, path: str, batch_id: int, *partitions: str, run: str = FIRST_RUN) -> None:
    """Append a micro-batch under its run and id; writing the same batch again replaces it."""
    _write(df.withColumns(_keys(batch_id, run)), path, *partitions, "run", "batch_id")


def append_silver(silver: DataFrame, path: str, batch_id: int, run: str = FIRST_RUN) -> None:
    """Silver rows by event date, sorted by vehicle and time inside each file.

    ``rebalance`` lets adaptive execution size the files: a heavy date is split over
    several tasks, light dates share one.
    """
    dated = silver.withColumns({"event_date": F.to_date("event_ts"), "ingested_at": F.current_timestamp(), **_keys(batch_id, run)})
    laid_out = dated.hint("rebalance", "event_date").sortWithinPartitions("event_date", "vehicle_id", "event_ts")
    _write(laid_out, path, "event_date", "run", "batch_id")


def _version(run: str, number: int) -> str:
    """Folder name; names order as runs and then numbers do."""
    return f"v-{run}-{number:015d}"


def replace_version(
    df: DataFrame, path: str, number: int, run: str = FIRST_RUN, keep_seconds: float = KEEP_SECONDS, prefix: str = ""
) -> None:
    """Publish ``df`` as the whole content of a small table. An empty frame publishes nothing.

    Versions replaced more than ``keep_seconds`` ago are removed; a reader has that long to finish. ``prefix`` comes
    before the version's name, to make it a partition folder.
    """
    spark, name = df.sparkSession, prefix + _version(run, number)
    staged = f"{path}/_{_version(run, number)}"
    df.write.mode("overwrite").parquet(staged)
    if spark.read.schema(df.schema).parquet(staged).isEmpty():
        files.remove(spark, staged)
        return
    files.move(spark, staged, f"{path}/{name}")
    ages = {n: age for n, age in files.children(spark, path).items() if n.startswith(f"{prefix}v-")}
    named = sorted(ages)
    for old, newer in zip(named, named[1:]):
        if ages[newer] > keep_seconds:  # replaced that long ago
            files.remove(spark, f"{path}/{old}")


def bucket_of(key: str) -> Column:
    """The bucket of a row; fixed for the life of a table."""
    return F.pmod(F.hash(key), F.lit(BUCKETS)).cast("int")


def touched_buckets(rows: DataFrame, key: str) -> list[int]:
    """Buckets that hold keys of these rows, at most ``BUCKETS`` numbers."""
    return sorted(r[0] for r in rows.select(bucket_of(key).alias("b")).distinct().collect())


def replace_buckets(
    df: DataFrame, path: str, key: str, batch_id: int, run: str = FIRST_RUN, keep_seconds: float = KEEP_SECONDS
) -> None:
    """Give each bucket that ``df`` has rows of a version of this run and batch, holding these rows and no others.

    Readers see every bucket whole, before or after the write. Versions replaced more than ``keep_seconds`` ago are removed.
    """
    sized = df.withColumn("bucket", bucket_of(key)).hint("rebalance", "bucket")
    append_batch(sized, path, batch_id, "bucket", run=run)
    for versions in _bucket_versions(df.sparkSession, path).values():
        ordered = sorted(versions)
        for old, newer in zip(ordered, ordered[1:]):
            if versions[newer][1] > keep_seconds:
                files.remove(df.sparkSession, f"{path}/{versions[old][0]}")


def _bucket_versions(spark: SparkSession, path: str) -> dict[int, dict[tuple[str, int], tuple[str, float]]]:
    """Per bucket the folder and age of each version, by run and batch id."""
    found: dict[int, dict[tuple[str, int], tuple[str, float]]] = {}
    for name, age in files.matching(spark, path, "bucket=*/run=*/batch_id=*").items():
        bucket, run, batch_id = (part.split("=")[1] for part in name.split("/"))
        found.setdefault(int(bucket), {})[run, int(batch_id)] = name, age
    return found


def read_buckets(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    before: tuple[str, int] | None = None,
    buckets: list[int] | None = None,
) -> DataFrame:
    """The newest version of every bucket, or of the named ones, or the newest older than the run and batch ``before``."""
    chosen = []
    for bucket, versions in sorted(_bucket_versions(spark, path).items()):
        known = [v for v in versions if before is None or v < before]
        if known and (buckets is None or bucket in buckets):
            chosen.append(f"{path}/{versions[max(known)][0]}")
    return spark.read.schema(schema).parquet(*chosen) if chosen else spark.createDataFrame([], schema)


def replace_date(df: DataFrame, path: str) -> None:
    """Replace the ``report_date`` partitions that ``df`` holds."""
    write_partitions(df, path, "report_date")


def read_table(spark: SparkSession, path: str, schema: T.StructType, **partitions: T.DataType) -> DataFrame:
    """A table, empty as long as nothing has been written to it."""
    fields = [*schema.fields, *[T.StructField(n, k) for n, k in partitions.items()]]
    try:
        return spark.read.schema(T.StructType(fields)).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], T.StructType(fields))


def read_version(
    spark: SparkSession, path: str, schema: T.StructType, before: tuple[str, int] | None = None
) -> DataFrame:
    """The newest version of a table, or the newest one older than the run and number ``before``."""
    named = [n for n in files.children(spark, path) if n.startswith("v-")]
    if before is not None:
        named = [n for n in named if n < _version(*before)]
    return spark.read.schema(schema).parquet(f"{path}/{max(named)}") if named else spark.createDataFrame([], schema)


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both frames, one per key; an incoming row replaces the existing one."""
    ranked = existing.withColumn("_rank", F.lit(0)).unionByName(incoming.withColumn("_rank", F.lit(1)))
    return latest_by_key(ranked, keys, F.col("_rank").desc()).drop("_rank")


def current(log: DataFrame, keys: list[str]) -> DataFrame:
    """Newest row per key of a batch log, that is the table after all upserts."""
    return latest_by_key(log, keys, F.col("run").desc(), F.col("batch_id").desc()).drop("run", "batch_id")
