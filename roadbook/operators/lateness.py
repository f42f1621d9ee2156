"""Events that a watermark would drop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from roadbook.contract import WATERMARK
from roadbook.operators.running import with_running_max

ARRIVALS_PER_CHUNK = 1_000_000


def late_events(
    arrivals: DataFrame, delay: str = WATERMARK, arrivals_per_chunk: int = ARRIVALS_PER_CHUNK
) -> DataFrame:
    """Events older than the newest event time seen so far less ``delay``.

    Arrival order is ``event_id``; ids are unique, so a chunk of the id range holds at
    most ``arrivals_per_chunk`` rows.
    """
    position = F.floor(F.col("event_id") / F.lit(arrivals_per_chunk))
    seen = with_running_max(arrivals, F.col("event_id"), position, {"max_event_ts": F.col("event_ts")})
    return seen.where(F.col("event_ts") < F.col("max_event_ts") - F.expr(f"INTERVAL {delay}"))
