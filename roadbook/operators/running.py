"""Running maxima in a global order without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_running_max(rows: DataFrame, order: Column, chunk: Column, values: dict[str, Column]) -> DataFrame:
    """Add, per name, the maximum of a value over all rows up to and including this one.

    ``chunk`` must never fall as ``order`` rises and must bound the rows it groups. Each
    chunk is ordered on its own; across chunks only one row of maxima per chunk is ordered.
    """
    names = list(values)
    tagged = rows.withColumns({"_chunk": chunk, "_order": order, **values})
    peaks = tagged.groupBy("_chunk").agg(*[F.max(n).alias(n) for n in names])
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = peaks.select("_chunk", *[F.max(n).over(before).alias(f"_carried_{n}") for n in names])
    inside = Window.partitionBy("_chunk").orderBy("_order").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        tagged.withColumns({n: F.max(n).over(inside) for n in names})
        .join(carried, "_chunk")
        .select(*rows.columns, *[F.greatest(n, f"_carried_{n}").alias(n) for n in names])
    )
