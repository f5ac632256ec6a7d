"""Table functions for SQL: the cells of a polygon and the samples of a line, used with LATERAL."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from geoloom.functions.geometry import METRES_PER_DEGREE
from geoloom.session import ship_package


@udtf(returnType="z int, x int")
class CellsOf:
    """`cells_of(zs, xs)`: the unit cells whose middle is inside the closed ring, by the even-odd rule; none for null or short rings."""

    def eval(self, zs: list[float], xs: list[float]) -> Iterator[tuple[int, int]]:
        if zs is None or xs is None or len(zs) < 3:
            return
        z, x = np.array(zs, float), np.array(xs, float)
        z2, x2 = np.roll(z, -1), np.roll(x, -1)
        for row in range(int(np.floor(z.min())), int(np.ceil(z.max()))):
            hit = (z > row + 0.5) != (z2 > row + 0.5)
            at = np.sort(x[hit] + (row + 0.5 - z[hit]) * (x2[hit] - x[hit]) / (z2[hit] - z[hit]))
            for a, b in zip(at[::2], at[1::2], strict=True):
                for column in range(int(np.ceil(a - 0.5)), int(np.floor(b - 0.5)) + 1):
                    yield row, column


@udtf(returnType="k bigint, lat double, lon double")
class SamplesOf:
    """`samples_of(lats, lons, step)`: points every `step` metres along a line of 1e-7 degrees, from its start; none for null lines and those of one place."""

    def eval(self, lats: list[int], lons: list[int], step: float) -> Iterator[tuple[int, float, float]]:
        if lats is None or lons is None or len(lats) < 2:
            return
        y, x = np.array(lats, float), np.array(lons, float)
        dy, turn = np.diff(y), np.diff(x)
        turn = (turn + 1.8e9) % 3.6e9 - 1.8e9
        metres = np.hypot(turn * np.cos(np.radians(y[:-1] / 1e7)), dy) / 1e7 * METRES_PER_DEGREE
        keep = metres > 0
        y, x, dy, turn, metres = y[:-1][keep], x[:-1][keep], dy[keep], turn[keep], metres[keep]
        ends = np.cumsum(metres)
        for k in range(int(ends[-1] // step) + 1 if len(ends) else 0):
            s = min(int(np.searchsorted(ends, k * step, "right")), len(ends) - 1)
            t = min(1.0, max(0.0, (k * step - (ends[s] - metres[s])) / metres[s]))
            yield k, float(y[s] + t * dy[s]), float((x[s] + t * turn[s] + 1.8e9) % 3.6e9 - 1.8e9)


def register(spark: SparkSession) -> None:
    """Make cells_of and samples_of known to the session's SQL."""
    ship_package(spark)
    spark.udtf.register("cells_of", CellsOf)
    spark.udtf.register("samples_of", SamplesOf)
