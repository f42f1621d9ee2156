"""Event-time helpers that accept both timestamp kinds (the session zone is UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadbook.contract import DAY_PART_DEFAULT, DAY_PARTS

MICROS_PER_SECOND = 1_000_000
MICROS_PER_MINUTE = 60 * MICROS_PER_SECOND


_UNIT_SECONDS = {"second": 1, "minute": 60, "hour": 3600, "day": 86_400}


def length_seconds(text: str) -> int:
    """``10 seconds``, ``1 minute`` as seconds."""
    number, unit = text.split()
    return int(number) * _UNIT_SECONDS[unit.lower().rstrip("s")]


def micros(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def time_of_day(ts: Column, local_zone: str | None = None) -> Column:
    """Named part of the day; hours are UTC unless ``local_zone`` names another zone."""
    hour = F.hour(F.from_utc_timestamp(ts.cast("timestamp"), local_zone) if local_zone else ts)
    part = F.lit(DAY_PART_DEFAULT)
    for name, first, until in reversed(DAY_PARTS):
        part = F.when((hour >= first) & (hour < until), F.lit(name)).otherwise(part)
    return part


def elapsed_micros(start: Column, end: Column) -> Column:
    """Micros from start to end, never negative; 0 when there is no start."""
    return F.greatest(F.coalesce(micros(end) - micros(start), F.lit(0)), F.lit(0))


def minutes_decimal(span_micros: Column, digits: int) -> Column:
    """Minutes rounded half up to ``digits`` decimals.

    The double quotient is exact enough for ``floor`` because spans stay below 2**53 micros.
    """
    unit = MICROS_PER_MINUTE // 10**digits
    steps = F.floor((span_micros + F.lit(unit // 2)) / F.lit(float(unit)))
    return (steps.cast("decimal(12,0)") / F.lit(10**digits)).cast(f"decimal(10,{digits})")
