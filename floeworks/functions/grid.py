"""Grids, cells and distances."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EARTH_RADIUS_KM = 6371.0088
KM_PER_DEGREE = 111.32


@dataclass(frozen=True)
class Grid:
    """A regular grid; row 0 is the northernmost."""

    height: int = 52
    width: int = 360
    lat_min: float = 60.0
    lat_max: float = 86.0
    lon_min: float = -180.0
    lon_max: float = 180.0


def to_cell(lat: Column, lon: Column, grid: Grid) -> tuple[Column, Column]:
    """Row and column of a position; null outside the (inclusive) bounds. The far edges belong to the last cells."""
    inside = lat.between(grid.lat_min, grid.lat_max) & lon.between(grid.lon_min, grid.lon_max)

    def index(part: Column, n: int) -> Column:
        return F.when(inside, F.least(F.greatest(F.floor(part * n), F.lit(0)), F.lit(n - 1)).cast("int"))

    return (
        index((F.lit(grid.lat_max) - lat) / (grid.lat_max - grid.lat_min), grid.height),
        index((lon - grid.lon_min) / (grid.lon_max - grid.lon_min), grid.width),
    )


def latlon_to_rc(lat: Column, lon: Column, grid: Grid) -> tuple[Column, Column, Column]:
    """Nearest node of the grid's axes (half to even), clipped, and whether the position is inside."""
    r = (F.lit(grid.lat_max) - lat) / (grid.lat_max - grid.lat_min) * (grid.height - 1)
    c = (lon - grid.lon_min) / (grid.lon_max - grid.lon_min) * (grid.width - 1)
    inside = lat.between(grid.lat_min, grid.lat_max) & lon.between(grid.lon_min, grid.lon_max)
    clip = lambda x, n: F.least(F.greatest(F.rint(x), F.lit(0.0)), F.lit(float(n - 1))).cast("int")
    return clip(r, grid.height), clip(c, grid.width), inside


def rc_to_latlon(row: Column, col: Column, grid: Grid) -> tuple[Column, Column]:
    return (
        F.lit(grid.lat_max) - row * ((grid.lat_max - grid.lat_min) / (grid.height - 1)),
        F.lit(grid.lon_min) + col * ((grid.lon_max - grid.lon_min) / (grid.width - 1)),
    )


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_RADIUS_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def wrap_longitude(df: DataFrame, column: str) -> DataFrame:
    """Longitudes 0..360 to [-180, 180), only where the table has any above 180."""
    out = df.crossJoin(F.broadcast(df.agg(F.max(column).alias("__top"))))  # one row
    wrapped = F.pmod(F.col(column) + 180.0, F.lit(360.0)) - 180.0
    return out.withColumn(column, F.when(F.col("__top") > 180, wrapped).otherwise(F.col(column))).select(*df.columns)


def bbox_filter(df: DataFrame, bbox: str, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """Rows within `minLon,minLat,maxLon,maxLat`."""
    parts = [float(x) for x in bbox.split(",")]
    if len(parts) != 4 or parts[0] >= parts[2] or parts[1] >= parts[3]:
        raise ValueError(f"bad bbox: {bbox}")
    return df.where(F.col(lon).between(parts[0], parts[2]) & F.col(lat).between(parts[1], parts[3]))


def axis_index(points: DataFrame, axis: DataFrame, value: str, into: str) -> DataFrame:
    """points with the nearest index (half to even, clipped) of value on an irregular axis (idx, value), rising or falling, and whether it is inside.

    The axis becomes intervals between neighbours; a point meets exactly one of them.
    """
    w = Window.orderBy("idx")
    part = axis.select("idx", "value", F.lead("value").over(w).alias("next"), F.lag("idx").over(w).alias("before")).where("next IS NOT NULL")
    last = F.max("idx").over(Window.partitionBy())
    part = part.select("idx", "value", "next", (F.col("idx") == last).alias("is_last"), F.col("before").isNull().alias("is_first"))
    v = F.col(value)
    low, high = F.least("value", "next"), F.greatest("value", "next")
    rising = F.col("next") > F.col("value")
    under, over = (F.when(rising, v < F.col("value")).otherwise(v > F.col("value"))), (F.when(rising, v >= F.col("next")).otherwise(v <= F.col("next")))
    within = ~under & ~over
    hit = within | (F.col("is_first") & under) | (F.col("is_last") & over)
    out = points.join(F.broadcast(part), hit)  # one axis: at most a few thousand nodes
    share = F.least(F.greatest((v - F.col("value")) / (F.col("next") - F.col("value")), F.lit(0.0)), F.lit(1.0))
    return out.select(*points.columns, F.rint(F.col("idx") + share).cast("int").alias(into), v.between(low, high).alias(f"{into}_inside"))
