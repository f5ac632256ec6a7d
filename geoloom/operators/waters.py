"""One water surface for each body of water, from heights sampled along its shore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Shore samples of a body, at most.
SHORE_SAMPLES = 24
#: A surface up to this much over the water level belongs to the sea.
SEA_MARGIN = 1.0
#: Kinds that stay what they are by the sea.
MADE = ("swimming_pool", "fountain_basin", "basin")


def depth_class(kind: Column, area_m2: Column) -> Column:
    """Depth of a body by its kind, of lakes and reservoirs by their area too; null for other kinds."""
    lake = F.when(area_m2 > 1_000_000, 12).when(area_m2 > 100_000, 7).otherwise(4)
    reservoir = F.when(area_m2 > 500_000, 10).otherwise(6)
    plain = {6: ("sea",), 3: ("river", "canal"), 2: ("pond", "basin", "swimming_pool"), 1: ("stream", "ditch", "fountain_basin", "wetland_water")}
    depth = F.when(kind == "lake", lake).when(kind == "reservoir", reservoir)
    for metres, kinds in plain.items():
        depth = depth.when(kind.isin(*kinds), metres)
    return depth


def water_surfaces(areas: DataFrame, shore: DataFrame, heights: DataFrame, level: float, most: int = SHORE_SAMPLES) -> DataFrame:
    """`(area_id, kind, surface, depth, at_sea, samples)`: one flat surface for each body.

    `areas`: area_id, kind, tidal, area_m2, mid_r, mid_c; `shore`: area_id, seq (from 0 without a gap along its outer rings),
    r, c; `heights`: r, c, value. Up to `most` vertices spread evenly along the whole shore read the cell they lie in. The
    surface is the median of those that have a height (the upper middle one), else the height at the middle, else `level`.
    A body of the sea, a tidal one or one no more than SEA_MARGIN over `level` is at sea: its surface is `level` and its
    kind sea, but for MADE ones. Shores are counted by a map-side combine and thinned before they meet the heights, so
    no task holds a shore and a body brings `most` rows to its group.
    """
    counts = shore.groupBy("area_id").agg(F.count("*").alias("n"))
    step = F.greatest(F.floor(F.col("n") / most), F.lit(1))
    picked = shore.join(counts, "area_id").where((F.col("seq") % step == 0) & (F.col("seq") < step * most))
    known = heights.where("value is not null").select("r", "c", "value")
    cell = lambda y, x: [F.floor(y).alias("r"), F.floor(x).alias("c")]
    along = picked.select("area_id", *cell("r", "c")).join(known, ["r", "c"]).groupBy("area_id").agg(F.array_sort(F.collect_list("value")).alias("o"))
    middle = areas.select("area_id", *cell("mid_r", "mid_c")).join(known, ["r", "c"]).select("area_id", F.col("value").alias("mid"))
    median = F.get("o", F.floor(F.size("o") / 2).cast("int"))
    found = areas.join(along, "area_id", "left").join(middle, "area_id", "left").withColumn("found", F.coalesce(median, "mid", F.lit(level)).cast("double"))
    at_sea = (F.col("kind") == "sea") | F.coalesce("tidal", F.lit(False)) | (F.col("found") <= level + SEA_MARGIN)
    kind = F.when(F.col("at_sea") & ~F.col("kind").isin(*MADE), "sea").otherwise(F.col("kind"))
    told = found.withColumn("at_sea", at_sea).withColumn("kind", kind)
    surface = F.when(F.col("at_sea"), F.lit(float(level))).otherwise(F.floor(F.col("found") + 0.5).cast("double"))
    return told.select("area_id", "kind", surface.alias("surface"), depth_class(F.col("kind"), F.col("area_m2")).alias("depth"), "at_sea", F.coalesce(F.size("o"), F.lit(0)).alias("samples"))
