"""Grid zones and bounds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from roadbook.contract import CITY, Grid


def clamp(value: Column, low: float, high: float) -> Column:
    """Pull ``value`` into [low, high]; null stays null and NaN goes to ``high``."""
    return F.when(value < F.lit(low), F.lit(low)).when(value > F.lit(high), F.lit(high)).otherwise(value)


def _cell(value: Column, low: float, high: float, cells: int, missing: Column) -> Column:
    width = (high - low) / cells
    inside = clamp(value, low, high)
    index = F.floor((inside - F.lit(low)) / F.lit(width))
    return F.when(value.isNull(), missing).otherwise(F.least(index, F.lit(cells - 1)))


def zone_id(lat: Column, lon: Column, grid: Grid = CITY, null_zone: bool = False) -> Column:
    """``Z<row><col>``. A missing coordinate counts as cell 0 unless ``null_zone`` is set."""
    missing = F.lit(None).cast("bigint") if null_zone else F.lit(0).cast("bigint")
    row = _cell(lat, grid.min_lat, grid.max_lat, grid.cells, missing)
    col = _cell(lon, grid.min_lon, grid.max_lon, grid.cells, missing)
    return F.concat(F.lit("Z"), row.cast("string"), col.cast("string"))


def in_bounds(lat: Column, lon: Column, grid: Grid = CITY) -> Column:
    """True inside the box, edges included; a missing coordinate is outside."""
    return F.coalesce(
        lat.between(grid.min_lat, grid.max_lat) & lon.between(grid.min_lon, grid.max_lon),
        F.lit(False),
    )
