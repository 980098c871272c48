"""Distances, bearings and planar tests on degrees."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Mean earth radii, by the unit of the distance.
RADIUS_KM = 6371.0
RADIUS_NM = 3440.065


def haversine(lat1: Column, lng1: Column, lat2: Column, lng2: Column, radius: float = RADIUS_KM) -> Column:
    """Great-circle distance in the unit of ``radius``."""
    dlat, dlng = F.radians(lat2 - lat1) / 2, F.radians(lng2 - lng1) / 2
    a = F.pow(F.sin(dlat), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(dlng), 2)
    return 2 * radius * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bearing(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """Initial bearing in degrees, 0 to 360."""
    a, b, d = F.radians(lat1), F.radians(lat2), F.radians(lng2 - lng1)
    y = F.sin(d) * F.cos(b)
    x = F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d)
    turned = F.degrees(F.atan2(y, x)) + 360
    return F.when(turned >= 360, turned - 360).otherwise(turned)


def orientation(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Sign of the turn a, b, c."""
    return F.signum((bx - ax) * (cy - ay) - (by - ay) * (cx - ax))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Planar distance of a point to a segment; a segment of no length is a point."""
    dx, dy = bx - ax, by - ay
    long = dx * dx + dy * dy
    at = F.when(long == 0, 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((px - ax) * dx + (py - ay) * dy) / F.when(long == 0, 1.0).otherwise(long))))
    return F.sqrt(F.pow(px - ax - at * dx, 2) + F.pow(py - ay - at * dy, 2))
