"""Tiles, cells and their names: Column -> Column."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_LATITUDE = 85.05
MERCATOR_HALF = math.pi * 6378137.0


def tile_x(lon: Column, z: Column | int) -> Column:
    """Fractional web-mercator column at zoom z."""
    return (lon + 180.0) / 360.0 * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)


def tile_y(lat: Column, z: Column | int) -> Column:
    """Fractional web-mercator row at zoom z; latitudes are clamped."""
    phi = F.radians(F.least(F.greatest(lat, F.lit(-MAX_LATITUDE)), F.lit(MAX_LATITUDE)))
    return (1 - F.log(F.tan(phi) + 1 / F.cos(phi)) / math.pi) / 2 * F.pow(F.lit(2.0), F.lit(z) if isinstance(z, int) else z)


def tile_bounds(z: int, x: Column, y: Column) -> dict[str, Column]:
    """west, south, east, north of a tile in degrees."""
    n = float(1 << z)
    lat = lambda v: F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * v / n))))
    return {"west": x / n * 360.0 - 180.0, "south": lat(y + 1), "east": (x + 1) / n * 360.0 - 180.0, "north": lat(y)}


def tile_bounds_3857(z: int, x: Column, y: Column) -> dict[str, Column]:
    """The same in EPSG:3857 metres."""
    side = 2 * MERCATOR_HALF / (1 << z)
    return {"xmin": x * side - MERCATOR_HALF, "ymin": MERCATOR_HALF - (y + 1) * side, "xmax": (x + 1) * side - MERCATOR_HALF, "ymax": MERCATOR_HALF - y * side}


def quadkey(z: int, x: Column, y: Column) -> Column:
    """One digit per zoom level, coarsest first."""
    digit = lambda s: F.call_function("shiftright", x, s).bitwiseAND(F.lit(1)) + 2 * F.call_function("shiftright", y, s).bitwiseAND(F.lit(1))
    return F.array_join(F.transform(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), lambda s: digit(s).cast("string")), "")


def hilbert_tile_id(z: int, x: Column, y: Column) -> Column:
    """Tiles of all coarser zooms first, then the Hilbert order of this one: a key to cluster tiles by."""
    x, y = x.cast("bigint"), y.cast("bigint")
    start = F.struct(x.alias("x"), y.alias("y"), F.lit(((1 << (2 * z)) - 1) // 3).cast("bigint").alias("d"))

    def step(a: Column, k: Column) -> Column:
        s = F.call_function("shiftleft", F.lit(1).cast("bigint"), k)
        rx = F.when(a["x"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        ry = F.when(a["y"].bitwiseAND(s) > 0, 1).otherwise(0).cast("bigint")
        d = a["d"] + s * s * F.when((rx == 1) & (ry == 1), 2).when(rx == 1, 3).when(ry == 1, 1).otherwise(0)
        fx, fy = F.when((ry == 0) & (rx == 1), s - 1 - a["x"].bitwiseAND(s - 1)).otherwise(a["x"].bitwiseAND(s - 1)), F.when((ry == 0) & (rx == 1), s - 1 - a["y"].bitwiseAND(s - 1)).otherwise(a["y"].bitwiseAND(s - 1))
        return F.struct(F.when(ry == 0, fy).otherwise(fx).cast("bigint").alias("x"), F.when(ry == 0, fx).otherwise(fy).cast("bigint").alias("y"), d.cast("bigint").alias("d"))

    return F.aggregate(F.sequence(F.lit(z - 1), F.lit(0), F.lit(-1)), start, step, lambda a: a["d"])


def cell(e7: Column, step_e7: int = 1_000_000) -> Column:
    """Index of the cell that holds a fixed-point coordinate; 1,000,000 is 0.1 degree."""
    return F.floor(e7 / step_e7)


def cell_name(lat: Column, lon: Column, step: int) -> Column:
    """Name of the whole-degree tile whose south-west corner is at or below the position, as in N60E005."""
    south, west = F.floor(lat / step) * step, F.floor(lon / step) * step
    return F.concat(F.when(south >= 0, "N").otherwise("S"), F.lpad(F.abs(south).cast("string"), 2, "0"), F.when(west >= 0, "E").otherwise("W"), F.lpad(F.abs(west).cast("string"), 3, "0"))


def zoom_for(metres_per_unit: float, lat: Column, low: int = 0, high: int = 19) -> Column:
    """The coarsest zoom whose pixels are no larger than a unit."""
    wanted = F.ceil(F.log2(156543.03392 * F.cos(F.radians(lat)) / metres_per_unit))
    return F.least(F.greatest(wanted, F.lit(low)), F.lit(high))
