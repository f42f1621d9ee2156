"""Exact windows kept as additive partial rows, with corrections for rows that came after a window had closed.

Every micro-batch adds, per window it touches, one partial row per vehicle and per trip: what its own rows say of them. Partial
rows of one vehicle or trip add up, so a window's figures over all batches are those over all rows, whatever their order.
A window closes when the watermark, the newest event time of earlier batches less the delay, passes its end. Partials
that come later are marked late: figures without them are what was final when the window closed, figures with
them are its correction. Nothing is held in streaming state; a batch that is replayed replaces its own partials.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from roadbook import contract
from roadbook.operators import measures
from roadbook.operators.windows import ZONE_KEYS, counted_units, unit_sums, window_rates
from roadbook.sinks import files, tables
from roadbook.sources import logs

_UNIT = ["window_start", "window_end", *ZONE_KEYS, "by_vehicle", "id"]


def window_units(silver: DataFrame, length: str) -> DataFrame:
    """One row per window and vehicle, and one per window and trip, with what its rows say."""
    units = F.array(
        F.struct(F.lit(True).alias("by_vehicle"), F.col("vehicle_id").alias("id")),
        F.struct(F.lit(False).alias("by_vehicle"), F.col("trip_id").alias("id")),
    )
    rows = silver.select(F.window("event_ts", length).alias("window"), *ZONE_KEYS, "status", "speed", "fare", F.inline(units))
    spread = rows.where("id IS NOT NULL").groupBy("window", *ZONE_KEYS, "by_vehicle", "id")
    figures = spread.agg(*[measures.ever(name).alias(name) for name in measures.counted_ids()], *unit_sums())
    return figures.withColumns({"window_start": F.col("window.start"), "window_end": F.col("window.end")}).drop("window")


def windows_of_units(units: DataFrame) -> DataFrame:
    """Window figures from partial rows, however many there are of one vehicle or trip."""
    added = units.groupBy(*_UNIT).agg(
        *[F.max(name).alias(name) for name in measures.counted_ids()],
        F.sum("speed_sum").alias("speed_sum"),
        F.max("fare").alias("fare"),
        F.sum("rows").alias("rows"),
    )
    frame = F.struct(F.col("window_start").alias("start"), F.col("window_end").alias("end")).alias("window")
    return window_rates(counted_units(added, [frame, *ZONE_KEYS], F.lit(True)))


@dataclass(frozen=True)
class WindowPartials:
    """``foreachBatch`` handler and reader of the partial rows under a folder."""

    path: str
    length: str = contract.METRICS_WINDOW
    delay: str = contract.WATERMARK
    run: str = tables.FIRST_RUN

    def __call__(self, silver: DataFrame, batch_id: int) -> None:
        spark = silver.sparkSession
        newest = silver.agg(F.max("event_ts").cast("timestamp").alias("newest"))
        tables.append_batch(newest.where("newest IS NOT NULL"), self._clock, batch_id, run=self.run)
        # the clock of earlier batches; one row per batch
        before = (F.col("run") < F.lit(self.run)) | ((F.col("run") == F.lit(self.run)) & (F.col("batch_id") < F.lit(batch_id)))
        passed = self._clocks(spark).where(before).agg(F.max("newest").alias("newest"))
        late = self._closed(F.col("window_end"), passed.select("newest").scalar())
        units = tables.finalise(window_units(silver, self.length).withColumn("late", late), contract.WINDOW_UNITS)
        dated = units.withColumn("window_date", F.to_date("window_start"))
        tables.append_batch(dated, f"{self.path}/units", batch_id, "window_date", run=self.run)

    @property
    def _clock(self) -> str:
        return f"{self.path}/clock"

    def _clocks(self, spark: SparkSession) -> DataFrame:
        return tables.read_table(spark, self._clock, contract.CLOCK, **tables.KEY_KINDS)

    def _closed(self, window_end: Column, newest: Column) -> Column:
        return F.coalesce(window_end.cast("timestamp") <= newest - F.expr(f"INTERVAL {self.delay}"), F.lit(False))

    def units(self, spark: SparkSession) -> DataFrame:
        return logs.read_log(spark, f"{self.path}/units", contract.WINDOW_UNITS, "window_date")

    def windows(self, spark: SparkSession) -> DataFrame:
        """All windows over all rows that have come."""
        return windows_of_units(self.units(spark))

    def final(self, spark: SparkSession) -> DataFrame:
        """Windows that have closed, as they stood when they closed."""
        newest = self._clocks(spark).agg(F.max("newest").alias("newest")).select("newest").scalar()
        return windows_of_units(self.units(spark).where(~F.col("late"))).where(self._closed(F.col("window_end"), newest))

    def corrections(self, spark: SparkSession) -> DataFrame:
        """The windows that late rows changed after they had closed, with the figures that hold now."""
        keys = ["window_start", *ZONE_KEYS]
        units = self.units(spark)
        changed = units.where("late").select(*keys).distinct()
        return windows_of_units(units.join(changed, keys, "left_semi"))

    def corrected(self, spark: SparkSession) -> DataFrame:
        """Final windows with their corrections put in."""
        keys = ["window_start", *ZONE_KEYS]
        corrections = self.corrections(spark)
        return self.final(spark).join(corrections.select(*keys), keys, "left_anti").unionByName(corrections)


def start_partials(silver: DataFrame, handler: WindowPartials, checkpoint: str, trigger: dict) -> StreamingQuery:
    handler = replace(handler, run=files.run_of(silver.sparkSession, checkpoint))
    return (
        silver.writeStream.foreachBatch(handler)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .queryName("window_partials")
        .start()
    )
