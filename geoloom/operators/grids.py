"""Rasters in long form `(r, c, value)`: pooling, sampling, votes, pyramids. Absent pixels are nulls or absent rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pool_mode(classes: DataFrame, f: int, value: str = "class") -> DataFrame:
    """The most common class of each f x f block; 0 is none, the lowest class wins ties, a block of none has 0."""
    block = classes.select(F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c"), F.col(value).alias("v"))
    votes = block.groupBy("r", "c", "v").agg(F.count("*").alias("n"))
    return votes.groupBy("r", "c").agg(F.coalesce(F.max_by(F.when(F.col("v") > 0, F.col("v")), F.when(F.col("v") > 0, F.struct("n", -F.col("v")))), F.lit(0)).alias(value))


def pool_mean(grid: DataFrame, f: int, value: Column) -> DataFrame:
    """Mean of the pixels that have a value, and how many there are."""
    block = grid.select(F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c"), value.alias("v"))
    return block.groupBy("r", "c").agg(F.avg("v").alias("mean"), F.count("v").alias("n"))


def pool_filled(grid: DataFrame, f: int) -> DataFrame:
    """Mean of f x f blocks with no-data as 0; blocks without a value above 0 are left out."""
    block = grid.select(F.floor(F.col("r") / f).alias("r"), F.floor(F.col("c") / f).alias("c"), F.coalesce("value", F.lit(0)).alias("v"))
    return block.groupBy("r", "c").agg((F.sum("v") / (f * f)).alias("mean"), F.max("v").alias("top")).where("top > 0").drop("top")


def pyramid_level(drawn: DataFrame, level: int) -> DataFrame:
    """Integer average of the drawn pixels (value > 0) of 2^level blocks, rounded half up; 0 becomes 1."""
    side = 1 << level
    block = drawn.where("value > 0").groupBy(F.floor(F.col("r") / side).alias("r"), F.floor(F.col("c") / side).alias("c"))
    return block.agg(F.sum("value").alias("s"), F.count("*").alias("n")).select("r", "c", F.greatest(F.floor((F.col("s") + F.floor(F.col("n") / 2)) / F.col("n")), F.lit(1)).alias("value"))


def offsets(points: DataFrame, near: list[tuple[int, int]]) -> DataFrame:
    """Each row (with r and c) under the pixels at the given offsets, as `pr`, `pc`, `dr`, `dc`: the way to a pixel join.

    Those joins ask for a merge: the planner takes a raster for as small as the file of its rows, and would broadcast it.
    """
    table = F.array(*[F.struct(F.lit(a).alias("dr"), F.lit(b).alias("dc")) for a, b in near])
    return points.withColumn("_o", F.explode(table)).select("*", "_o.dr", "_o.dc").drop("_o").withColumns({"pr": F.col("r") + F.col("dr"), "pc": F.col("c") + F.col("dc")})


def near_pixels(points: DataFrame, pixels: DataFrame, k: int, side: int = 8) -> DataFrame:
    """Each row (with r and c) with the `pixels` (pr, pc, ...) at most `k` rows and columns off, and `dr`, `dc`.

    Points stand under one tile, pixels under the few tiles they are near, and offsets are compared after the join: of a
    point one row is shuffled, not one for each offset.
    """
    tiles = lambda p: F.sequence(F.floor((F.col(p) - k) / side), F.floor((F.col(p) + k) / side))
    filed = pixels.withColumn("_tr", F.explode(tiles("pr"))).withColumn("_tc", F.explode(tiles("pc")))
    own = points.withColumns({"_tr": F.floor(F.col("r") / side), "_tc": F.floor(F.col("c") / side)})
    met = own.join(filed.hint("merge"), ["_tr", "_tc"]).drop("_tr", "_tc").withColumns({"dr": F.col("pr") - F.col("r"), "dc": F.col("pc") - F.col("c")})
    return met.where((F.abs("dr") <= k) & (F.abs("dc") <= k))


def square(k: int) -> list[tuple[int, int]]:
    return [(a, b) for a in range(-k, k + 1) for b in range(-k, k + 1)]


def bilinear(points: DataFrame, grid: DataFrame, key: str, least: float = 1e-6, rings: int = 3) -> DataFrame:
    """Value at fractional `(y, x)`: the four pixels round it, weights of those present summing to one.

    Where none is present, the nearest pixel that is, within `rings` square rings round the nearest place of a pixel; ties
    by ring, then row, then column offset. Null beyond.
    """
    near = offsets(points.withColumns({"r": F.floor("y"), "c": F.floor("x")}), [(0, 0), (0, 1), (1, 0), (1, 1)])
    fy, fx = F.col("y") - F.col("r"), F.col("x") - F.col("c")
    weight = F.when(F.col("dr") == 1, fy).otherwise(1 - fy) * F.when(F.col("dc") == 1, fx).otherwise(1 - fx)
    pixels = grid.where("value is not null").select(F.col("r").alias("pr"), F.col("c").alias("pc"), "value")
    met = near.withColumn("w", weight).join(pixels.hint("merge"), ["pr", "pc"])
    summed = met.groupBy(key).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("value")).alias("s")).where(F.col("w") > least)
    near_four = summed.select(key, (F.col("s") / F.col("w")).alias("four"))
    rest = points.join(near_four, key, "left_anti").select(key, F.floor(F.col("y") + 0.5).alias("r"), F.floor(F.col("x") + 0.5).alias("c"))
    ring = F.greatest(F.abs("dr"), F.abs("dc"))
    beyond = offsets(rest, square(rings)).join(pixels.hint("merge"), ["pr", "pc"]).groupBy(key).agg(F.min_by("value", F.struct(ring, F.col("dr"), F.col("dc"))).cast("double").alias("ringed"))
    out = points.select(key).join(near_four, key, "left").join(beyond, key, "left")
    return out.select(key, F.coalesce("four", "ringed").alias("value"))


def catmull_rom(t: Column, k: Column) -> Column:
    """Weight of the k-th of four neighbours (-1 to 2) at t."""
    return (
        F.when(k == -1, ((-t + 2) * t - 1) * t / 2)
        .when(k == 0, (t * t * (3 * t - 5) + 2) / 2)
        .when(k == 1, ((4 - 3 * t) * t + 1) * t / 2)
        .otherwise((t - 1) * t * t / 2)
    )


def bicubic(points: DataFrame, grid: DataFrame, key: str, width: int, height: int) -> DataFrame:
    """Catmull-Rom value at `(y, x)`, null unless all sixteen pixels have one; columns wrap round, rows are held."""
    near = offsets(points.withColumns({"r": F.floor("y"), "c": F.floor("x")}), [(a, b) for a in range(-1, 3) for b in range(-1, 3)])
    w = catmull_rom(F.col("x") - F.col("c"), F.col("dc")) * catmull_rom(F.col("y") - F.col("r"), F.col("dr"))
    near = near.withColumns({"w": w, "pc": F.pmod("pc", F.lit(width)), "pr": F.least(F.greatest("pr", F.lit(0)), F.lit(height - 1))})
    pixels = grid.where("value is not null").select(F.col("r").alias("pr"), F.col("c").alias("pc"), "value")
    summed = near.join(pixels.hint("merge"), ["pr", "pc"]).groupBy(key).agg(F.count("*").alias("n"), F.sum(F.col("w") * F.col("value")).alias("value")).where("n = 16")
    return points.select(key).join(summed.select(key, "value"), key, "left")


def nearest_class(points: DataFrame, classes: DataFrame, key: str, rings: int) -> DataFrame:
    """The class of the nearest pixel that has one, within square rings; ties by ring, then row, then column offset."""
    held = classes.where("class > 0").select(F.col("r").alias("pr"), F.col("c").alias("pc"), "class")
    ring = F.greatest(F.abs("dr"), F.abs("dc"))
    best = near_pixels(points, held, rings).groupBy(key).agg(F.min_by("class", F.struct(ring, F.col("dr"), F.col("dc"))).alias("class"))
    return points.select(key).join(best, key, "left")


def majority3(classes: DataFrame) -> DataFrame:
    """3 x 3 vote of every classified pixel; unknown (0) competes, the lowest code wins ties."""
    own = classes.where("class <> 0").select("r", "c")
    near = offsets(own, square(1)).join(classes.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "class").hint("merge"), ["pr", "pc"])
    votes = near.groupBy("r", "c", "class").agg(F.count("*").alias("n"))
    return votes.groupBy("r", "c").agg(F.max_by("class", F.struct("n", -F.col("class"))).alias("class"))


def local_maxima(grid: DataFrame, low: float, high: float, unit: float) -> DataFrame:
    """Pixels of a height between low and high that no pixel within their own radius tops, and with company.

    The radius is round(height / unit / 3), held to 1..4; of equal heights the first in row order wins; three of the
    eight neighbours are at least 0.4 of the height.
    """
    tops = grid.where(F.col("value").between(low, high)).select("r", "c", "value").withColumn("radius", F.least(F.greatest(F.floor(F.col("value") / unit / 3 + 0.5), F.lit(1)), F.lit(4)))
    near = offsets(tops, [o for o in square(4) if o != (0, 0)]).where((F.abs("dr") <= F.col("radius")) & (F.abs("dc") <= F.col("radius")))
    other = grid.where("value is not null").select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("value").alias("o"))
    met = near.join(other.hint("merge"), ["pr", "pc"])
    earlier = (F.col("dr") < 0) | ((F.col("dr") == 0) & (F.col("dc") < 0))
    beaten = F.sum(((F.col("o") > F.col("value")) | ((F.col("o") == F.col("value")) & earlier)).cast("int"))
    company = F.sum(((F.abs("dr") <= 1) & (F.abs("dc") <= 1) & (F.col("o") >= 0.4 * F.col("value"))).cast("int"))
    return met.groupBy("r", "c", "value").agg(beaten.alias("beaten"), company.alias("company")).where("beaten = 0 and company >= 3").select("r", "c", "value")


def slopes(grid: DataFrame) -> DataFrame:
    """Central differences along rows and columns, held at the edges, with a hillshade in 0..1 (light from north-west)."""
    by_row, by_col = Window.partitionBy("r").orderBy("c"), Window.partitionBy("c").orderBy("r")
    v = F.col("value")
    d = grid.withColumns({"dx": (F.coalesce(F.lead("value").over(by_row), v) - F.coalesce(F.lag("value").over(by_row), v)) / 2, "dy": (F.coalesce(F.lead("value").over(by_col), v) - F.coalesce(F.lag("value").over(by_col), v)) / 2})
    return d.withColumn("shade", F.least(F.greatest((1 + (F.col("dx") + F.col("dy")) * -0.01) / F.sqrt(1 + (F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) * 0.0001), F.lit(0.0)), F.lit(1.0)))


def run_length(classes: DataFrame) -> DataFrame:
    """Runs `(r, start, end, class)` of equal classes in neighbouring columns; end is behind the last; 0 makes no run."""
    same = Window.partitionBy("r", "class").orderBy("c")
    island = classes.where("class <> 0").withColumn("_i", F.col("c") - F.row_number().over(same))
    return island.groupBy("r", "class", "_i").agg(F.min("c").alias("start"), (F.max("c") + 1).alias("end")).drop("_i")


def run_lookup(points: DataFrame, runs: DataFrame, width: int = 64) -> DataFrame:
    """The class of the run that holds each point's column, 0 if none: equal rows and column buckets, then the range."""
    buckets = F.sequence(F.floor(F.col("start") / width), F.floor((F.col("end") - 1) / width))
    filed = runs.withColumn("_b", F.explode(buckets))
    hit = points.withColumn("_b", F.floor(F.col("c") / width)).join(filed, ["r", "_b"]).where("c >= start and c < end")
    return points.join(hit.select("r", "c", "class").distinct(), ["r", "c"], "left").withColumn("class", F.coalesce("class", F.lit(0)))


def gaussian_disc(points: DataFrame, grid: DataFrame, key: str, radius: int, sigma: float) -> DataFrame:
    """Gaussian-weighted mean of a disc, with negative values and absent pixels as 0."""
    d2 = F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc")
    w = F.exp(-d2 / (2 * sigma * sigma))
    whole = sum(math.exp(-(a * a + b * b) / (2 * sigma * sigma)) for a, b in square(radius) if a * a + b * b <= radius * radius)
    pixels = grid.select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.greatest(F.coalesce("value", F.lit(0)), F.lit(0)).alias("value"))
    met = near_pixels(points, pixels.where("value > 0"), radius).where(d2 <= radius * radius)
    means = met.groupBy(key).agg((F.sum(w * F.col("value")) / whole).alias("mean"))
    return points.select(key).join(means.hint("merge"), key, "left").select(key, F.coalesce("mean", F.lit(0.0)).alias("mean"))
