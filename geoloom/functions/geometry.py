"""Distances, bearings and segment geometry as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111320.0
EARTH_KM = 6371.0


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(a, F.lit(1.0))))


def flat_metres(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Distance on the local scale: longitudes shrink with the cosine of the first latitude."""
    dy, dx = (lat2 - lat1) * METRES_PER_DEGREE, (lon2 - lon1) * METRES_PER_DEGREE * F.cos(F.radians(lat1))
    return F.sqrt(dx * dx + dy * dy)


def bearing(dx: Column, dy: Column) -> Column:
    """Degrees clockwise from north, 0 to 360."""
    return F.pmod(F.degrees(F.atan2(dx, dy)), F.lit(360.0))


def axial_difference(a: Column, b: Column) -> Column:
    """Angle between two directions whose sense doesn't matter, 0 to 90."""
    d = F.pmod(F.abs(a - b), F.lit(180.0))
    return F.least(d, 180.0 - d)


def segment_place(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Share of the segment at which the point's foot lies, clamped to 0..1."""
    dx, dy = bx - ax, by - ay
    length2 = dx * dx + dy * dy
    return F.when(length2 == 0, 0.0).otherwise(F.least(F.greatest(((px - ax) * dx + (py - ay) * dy) / length2, F.lit(0.0)), F.lit(1.0)))


def segment_distance(px: Column, py: Column, ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    t = segment_place(px, py, ax, ay, bx, by)
    ex, ey = px - (ax + t * (bx - ax)), py - (ay + t * (by - ay))
    return F.sqrt(ex * ex + ey * ey)


def box_distance_metres(lat: Column, lon: Column, south: Column, west: Column, north: Column, east: Column) -> Column:
    """Metres from a point to a box, 0 inside; the shorter way round the globe. A west beyond the east is across the 180th meridian."""
    dy = F.greatest(south - lat, lat - north, F.lit(0.0)) * METRES_PER_DEGREE
    over = F.when(west > east, east + 360).otherwise(east)
    apart = F.least(*[F.greatest(west - lon - turn, lon + turn - over, F.lit(0.0)) for turn in (-360, 0, 360)])
    dx = apart * METRES_PER_DEGREE * F.cos(F.radians(lat))
    return F.sqrt(dx * dx + dy * dy)


def circle_outline(lat: Column, lon: Column, radius_km: Column, vertices: int) -> Column:
    """Array of lat/lon vertices round a point."""
    step = 2 * 3.141592653589793 / vertices
    return F.transform(
        F.sequence(F.lit(0), F.lit(vertices - 1)),
        lambda k: F.struct((lat + radius_km * F.cos(k * step) / 111.32).alias("lat"), (lon + radius_km * F.sin(k * step) / (111.32 * F.cos(F.radians(lat)))).alias("lon")),
    )
