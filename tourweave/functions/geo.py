"""Points and distances as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111_320


def valid_point(lat: Column, lon: Column) -> Column:
    """Both are numbers within the bounds; infinities fall to the bounds, NaN is excluded."""
    return F.coalesce(~F.isnan(lat) & ~F.isnan(lon) & (F.abs(lat) <= 90) & (F.abs(lon) <= 180), F.lit(False))


def planar_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on a plane through the mean latitude."""
    north = (lat1 - lat2) * METRES_PER_DEGREE
    east = (lon1 - lon2) * METRES_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.hypot(east, north)


def line_or_null(points: Column) -> Column:
    """A usable line: 2 to 200,000 valid points; anything else is null, never a made-up line."""
    fine = F.size(points).between(2, 200_000) & F.forall(points, lambda p: valid_point(p["lat"], p["lon"]))
    return F.when(fine, points)
