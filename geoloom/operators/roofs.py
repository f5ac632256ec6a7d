"""Heights and roofs of buildings read off a surface raster, sampled along each building's own axes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples along and across, and the share of the half extents that they reach, for heights and for roofs.
HEIGHT_GRID, HEIGHT_REACH, HEIGHT_LEAST = (5, 5), 0.7, 3
ROOF_GRID, ROOF_REACH, ROOF_LEAST = (9, 7), 0.85, 15
#: Least half extents of a building whose roof can be told.
LEAST_HALF_A, LEAST_HALF_B = 3.0, 2.5
#: Roofs are as high as this at least, eaves too; below this difference they are flat.
LEAST_RIDGE, LEAST_EAVE, FLAT = 2.0, 1.5, 1.2
#: Share of the pitch by which the middle stands above the edges.
PITCHED = 0.35


def axis_samples(buildings: DataFrame, surface: DataFrame, grid: tuple[int, int], reach: float) -> DataFrame:
    """`(id, i, j, v)`: the surface less the base under a grid of points in each building's axes; holes are left out, v is null where the surface is.

    `buildings`: id, cy, cx (centre), ay, ax (unit vector along the long side), half_a, half_b, base; `surface`: r, c, value.
    Every point reads the one cell it lies in, an equi join. The points are many more than the planner takes them for, so the
    join asks for a merge. A test of the values would be pushed down to where they are worked out, and work them out twice.
    """
    nu, nv = grid
    i, j = F.col("i"), F.col("j")
    spread = buildings.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(nu - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(nv - 1))))
    u, v = (-reach + 2 * reach * i / (nu - 1)) * F.col("half_a"), (-reach + 2 * reach * j / (nv - 1)) * F.col("half_b")
    placed = spread.withColumns({"_u": u, "_v": v}).select("id", "i", "j", "base", F.floor(F.col("cy") + F.col("_u") * F.col("ay") + F.col("_v") * F.col("ax")).alias("r"), F.floor(F.col("cx") + F.col("_u") * F.col("ax") - F.col("_v") * F.col("ay")).alias("c"))
    return placed.hint("merge").join(surface.select("r", "c", "value"), ["r", "c"]).select("id", "i", "j", (F.col("value") - F.col("base")).alias("v"))


def _at(ordered: str, share: float) -> Column:
    """The value at a share of the ordered ones, the last at most; index rounded down."""
    return F.get(ordered, F.least(F.floor(F.size(ordered) * F.lit(share)), F.size(ordered) - 1).cast("int"))


def surface_heights(buildings: DataFrame, surface: DataFrame, share: float = 0.8) -> DataFrame:
    """`(id, height, samples)`: the upper fifth of the surface inside each building, over its base; none below HEIGHT_LEAST samples."""
    tops = axis_samples(buildings, surface, HEIGHT_GRID, HEIGHT_REACH).groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("o"))
    return tops.where(F.size("o") >= HEIGHT_LEAST).select("id", _at("o", share).alias("height"), F.size("o").alias("samples"))


def roofs(buildings: DataFrame, surface: DataFrame, highest: float = 1000.0) -> DataFrame:
    """`(id, eave, ridge, shape)` with shape flat, gabled, hipped or irregular, read off at most 63 samples of each building.

    Eave and ridge are the 20th and 92nd percentile. With hardly any difference the roof is flat. Where the middle rows
    stand above the edge rows it is pitched: hipped if the middle columns stand above the end columns too, else gabled;
    where only the columns differ, the ridge runs across and it is gabled. What is left is irregular. Buildings that are
    too small, of too few samples, too low or above `highest` have no row.
    """
    wide = buildings.where((F.col("half_a") >= LEAST_HALF_A) & (F.col("half_b") >= LEAST_HALF_B))
    samples = axis_samples(wide, surface, ROOF_GRID, ROOF_REACH)
    rows = {f"row{k}": F.avg(F.when(F.col("j") == k, F.col("v"))).alias(f"row{k}") for k in (0, 2, 3, 4, 6)}
    columns = {f"col{k}": F.avg(F.when(F.col("i") == k, F.col("v"))).alias(f"col{k}") for k in (0, 3, 4, 5, 8)}
    told = samples.groupBy("id").agg(F.array_sort(F.collect_list("v")).alias("o"), *rows.values(), *columns.values()).where(F.size("o") >= ROOF_LEAST)
    told = told.withColumns({"low": _at("o", 0.2), "ridge": _at("o", 0.92)}).where((F.col("ridge") >= LEAST_RIDGE) & (F.col("ridge") <= highest))
    mean = lambda *names: F.try_divide(sum((F.coalesce(n, F.lit(0.0)) for n in names), F.lit(0.0)), sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)))
    eave = F.greatest(F.col("low"), F.lit(LEAST_EAVE))
    pitch = F.col("ridge") - eave
    across = F.coalesce(mean("row2", "row3", "row4") - mean("row0", "row6") >= PITCHED * pitch, F.lit(False))
    ends = F.coalesce(mean("col3", "col4", "col5") - mean("col0", "col8") >= F.greatest(F.lit(1.0), PITCHED * pitch), F.lit(False))
    flat = pitch < FLAT
    shape = F.when(flat, "flat").when(across & ends, "hipped").when(across | ends, "gabled").otherwise("irregular")
    return told.select("id", F.when(flat, F.col("ridge")).otherwise(eave).alias("eave"), "ridge", shape.alias("shape"))
