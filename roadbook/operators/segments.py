"""Idle streaks as a segmented scan over ranges of (vehicle, time).

Rows lie in ranges of one global order, so a vehicle may reach over any number of ranges. Each range is
read once, in order, and every row is given what its own range can tell. What a range cannot know about its
first rows depends only on how the ranges before it ended: one row per range says that, and those rows are
put together in order (an associative step) and carried in.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext, cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from roadbook.contract import IDLE

# task functions travel with the job, so executors need not have this package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

KNOWN = ["_known", "_since", "_sent"]  # rows that stand for what was stored: flag, start of the open streak, alert sent
_FOUND = ["_streak_ts", "_streak_seq", "_streak_sent", "_prev_status", "_prev_ts", "_prev_known", "_part", "_place", "_lead"]


class _Scan:
    """One range, batch by batch. Of the rows seen it keeps the last one and the streak open at it."""

    def __init__(self, part: int) -> None:
        self.part, self.place, self.last = part, 0, None

    def __call__(self, batch: pa.RecordBatch) -> pa.RecordBatch:
        n = batch.num_rows
        vehicle, status, time = (batch.column(c) for c in ("vehicle_id", "status", "event_ts"))
        ts, ts_null = _numbers(time)
        since, since_null = _numbers(batch.column("_since"))
        seq, _ = _numbers(batch.column("_seq"))
        known, sent = _flags(batch.column("_known")), _flags(batch.column("_sent"))
        idle = _flags(pc.equal(status, IDLE))
        codes, _ = _numbers(vehicle.dictionary_encode().indices)
        last = self.last
        new = np.ones(n, bool)
        new[1:] = codes[1:] != codes[:-1]
        new[0] = last is None or last["vehicle"] != vehicle[0].as_py()

        # in an open streak: an idle row, or a stored idle state whose start is known
        open_ = idle & ~(known & since_null)
        goes_on = open_ & ~new
        goes_on[1:] &= open_[:-1]
        goes_on[0] &= last is not None and last["open"]
        at = np.maximum.accumulate(np.where(open_ & ~goes_on, np.arange(n), -1))
        own = at >= 0
        at = np.maximum(at, 0)
        start_ts = np.where(known, since, ts)[at]
        start_seq = np.where(known, 0, seq)[at]
        start_sent = (known & sent)[at]
        if last is not None and last["open"]:
            start_ts, start_seq, start_sent = (
                np.where(own, mine, last[name]) for mine, name in ((start_ts, "ts"), (start_seq, "seq"), (start_sent, "sent"))
            )
        # rows of the streak that the range's first row may have inherited
        lead = np.zeros(n, bool)
        if last["lead"] if last is not None else open_[0] and not known[0]:
            first = np.flatnonzero(~goes_on[1 if last is None else 0 :])
            lead[: n if not len(first) else first[0] + (last is None)] = True
        if last is None:
            before_status = before_time = None
        else:
            before_status, before_time = last["status"], last["time"]
        out = [
            *batch.columns,
            pa.array(start_ts, pa.int64(), mask=~open_).cast(time.type),
            pa.array(start_seq, pa.int64(), mask=~open_),
            pa.array(start_sent, pa.bool_(), mask=~open_),
            _shifted(status, before_status, new),
            _shifted(time, before_time, new),
            pa.array(np.concatenate([[last is not None and last["known"]], known[:-1]]) & ~new),
            pa.array(np.full(n, self.part), pa.int32()),
            pa.array(np.arange(self.place, self.place + n), pa.int64()),
            pa.array(lead),
        ]
        self.place += n
        self.last = {
            "vehicle": vehicle[-1].as_py(),
            "status": status[-1],
            "time": time[-1],
            "known": bool(known[-1]),
            "open": bool(open_[-1]),
            "lead": bool(lead[-1]),
            "ts": start_ts[-1],
            "seq": start_seq[-1],
            "sent": start_sent[-1],
        }
        return pa.RecordBatch.from_arrays(out, [*batch.schema.names, *_FOUND])


def _numbers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values as whole numbers, and where they are missing."""
    missing = column.is_null().to_numpy(zero_copy_only=False)
    return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), missing


def _flags(column: pa.Array) -> np.ndarray:
    return pc.fill_null(column, False).to_numpy(zero_copy_only=False).astype(bool)


def _shifted(column: pa.Array, before: pa.Scalar | None, new: np.ndarray) -> pa.Array:
    """The value of the vehicle's previous row."""
    head = pa.nulls(1, column.type) if before is None else pa.array([before.as_py()], column.type)
    moved = pa.concat_arrays([head, column.slice(0, len(column) - 1)])
    return pc.if_else(pa.array(new), pa.scalar(None, column.type), moved)


def scan(rows: DataFrame) -> DataFrame:
    """What each row's range tells, for rows that lie in order within their partitions."""
    time = rows.schema["event_ts"].dataType
    kinds = [time, T.LongType(), T.BooleanType(), T.StringType(), time, T.BooleanType(), T.IntegerType(), T.LongType(), T.BooleanType()]
    schema = T.StructType([*rows.schema.fields, *[T.StructField(n, k) for n, k in zip(_FOUND, kinds)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = _Scan(TaskContext.get().partitionId())
        for batch in batches:
            if batch.num_rows:
                yield step(batch)

    return rows.mapInArrow(run, schema)


def _carried(scanned: DataFrame) -> DataFrame:
    """For each range, how the rows before it ended; one row per range."""
    streak = F.when(F.col("_streak_seq").isNotNull(), F.struct("_streak_ts", "_streak_seq", "_streak_sent"))
    end = F.struct("vehicle_id", "status", "event_ts", "_known", "_lead", streak.alias("open"))
    ends = scanned.groupBy("_part").agg(F.max_by(end, "_place").alias("end"))
    in_order = Window.orderBy("_part")
    before = F.lag("end").over(in_order)
    same = F.coalesce((before["vehicle_id"] == F.col("end.vehicle_id")) & before["open"].isNotNull(), F.lit(False))
    # a range that ends in the streak it began with ends in the streak that was open before it
    linked = ends.withColumn("linked", F.col("end._lead") & same)
    begun = F.last(F.when(~F.col("linked"), F.struct("end.open")), True).over(in_order.rowsBetween(Window.unboundedPreceding, 0))
    return linked.withColumn("open", F.when(F.col("linked"), begun["open"]).otherwise(F.col("end.open"))).select(
        "_part",
        F.lag("end.vehicle_id").over(in_order).alias("_in_vehicle"),
        F.lag("end.status").over(in_order).alias("_in_status"),
        F.lag("end.event_ts").over(in_order).alias("_in_ts"),
        F.lag("end._known").over(in_order).alias("_in_known"),
        F.lag("open").over(in_order).alias("_in_open"),
    )


def idle_scan(rows: DataFrame, keep: Callable[[DataFrame], DataFrame], ranges: int | None = None) -> DataFrame:
    """Rows plus ``streak``, ``prev_status``, ``prev_ts`` and ``prev_stored``, without the stored states among them.

    ``rows`` carry ``vehicle_id``, ``status``, ``event_ts``, ``_seq`` and the columns ``KNOWN``. They are dealt into ranges
    by one exchange; ``keep`` stores what the ranges tell, so that it is computed once.
    """
    order = [F.col("vehicle_id"), F.col("_known").desc(), F.col("event_ts"), F.col("_seq")]
    dealt = rows.repartitionByRange(*([ranges] if ranges else []), *order).sortWithinPartitions(*order)
    scanned = keep(scan(dealt))
    # as many rows as there are ranges
    joined = scanned.join(F.broadcast(_carried(scanned)), "_part", "left")
    same = F.coalesce(F.col("_in_vehicle") == F.col("vehicle_id"), F.lit(False))
    first = same & (F.col("_place") == 0)
    own = F.when(F.col("_streak_seq").isNotNull(), _streak("_streak_ts", "_streak_seq", "_streak_sent"))
    inherited = _streak("_in_open._streak_ts", "_in_open._streak_seq", "_in_open._streak_sent")
    given = [c for c in rows.columns if c not in (*KNOWN, "_seq")]
    return joined.where(~F.col("_known")).select(
        *given,
        F.when(F.col("_lead") & same & F.col("_in_open").isNotNull(), inherited).otherwise(own).alias("streak"),
        F.when(first, F.col("_in_status")).otherwise(F.col("_prev_status")).alias("prev_status"),
        F.when(first, F.col("_in_ts")).otherwise(F.col("_prev_ts")).alias("prev_ts"),
        F.when(first, F.col("_in_known")).otherwise(F.col("_prev_known")).alias("prev_stored"),
    )


def _streak(ts: str, seq: str, sent: str):
    """Where a streak began, and whether its alert went out in an earlier run."""
    return F.struct(F.col(ts).alias("ts"), F.col(seq).alias("seq"), F.col(sent).alias("sent"))
