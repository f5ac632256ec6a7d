"""Rasters over zooms: tiles that a zoom lacks filled from the next coarser one, and blends of two models by distance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoloom.session import stored


def _tiles(pixels: DataFrame, size: int) -> DataFrame:
    return pixels.withColumns({"tr": F.floor(F.col("r") / size), "tc": F.floor(F.col("c") / size)})


def plausible_pixels(pixels: DataFrame, size: int, low: float, high: float) -> DataFrame:
    """`pixels` (z, r, c, value) with tr and tc, without the tiles that hold a value outside low..high."""
    tiled = _tiles(pixels.where("value is not null"), size)
    wrong = tiled.where(~F.col("value").between(low, high)).select("z", "tr", "tc").distinct()
    return tiled.join(wrong, ["z", "tr", "tc"], "left_anti")


def upsample(missing: DataFrame, parents: DataFrame, size: int, columns: int) -> DataFrame:
    """Pixels `(tr, tc, r, c, value)` of the `missing` tiles (tr, tc), bilinear between the four nearest of the zoom below.

    `parents`: its pixels (r, c, value), `columns` its width in pixels, round the globe. A pixel past the edge of the parent
    tile comes from its neighbour; where there is none, the parent's edge pixel stands in. A pixel without all four is left out.
    """
    j = missing.withColumn("r", F.explode(F.sequence(F.col("tr") * size, F.col("tr") * size + size - 1)))
    own = j.withColumn("c", F.explode(F.sequence(F.col("tc") * size, F.col("tc") * size + size - 1)))
    sy, sx = (F.col("r") + 0.5) / 2.0 - 0.5, (F.col("c") + 0.5) / 2.0 - 0.5
    placed = own.withColumns({"_y": F.floor(sy), "_x": F.floor(sx), "_fy": sy - F.floor(sy), "_fx": sx - F.floor(sx)})
    tap = lambda dy, dx: F.struct((F.col("_y") + dy).alias("py"), (F.col("_x") + dx).alias("px"), ((F.col("_fy") if dy else 1 - F.col("_fy")) * (F.col("_fx") if dx else 1 - F.col("_fx"))).alias("w"))
    taps = placed.select("tr", "tc", "r", "c", F.inline(F.array(*[tap(dy, dx) for dy in (0, 1) for dx in (0, 1)])))
    low_y, low_x = F.floor(F.col("tr") / 2) * size, F.floor(F.col("tc") / 2) * size
    held = taps.withColumns({"ey": F.least(F.greatest("py", low_y), low_y + size - 1), "ex": F.least(F.greatest("px", low_x), low_x + size - 1), "px": F.pmod("px", F.lit(columns))})
    first = parents.select(F.col("r").alias("py"), F.col("c").alias("px"), F.col("value").alias("v"))
    inside = held.join(first, ["py", "px"], "left")
    past = (F.col("py") != F.col("ey")) | (F.col("px") != F.col("ex"))
    edge = parents.select(F.col("r").alias("ey"), F.col("c").alias("ex"), F.col("value").alias("e"))
    lacking = inside.where(F.col("v").isNull() & past).drop("v").join(edge, ["ey", "ex"]).withColumnRenamed("e", "v")
    both = inside.where("v is not null").select("tr", "tc", "r", "c", "w", "v").union(lacking.select("tr", "tc", "r", "c", "w", "v"))
    whole = both.groupBy("tr", "tc", "r", "c").agg(F.sum(F.col("w") * F.col("v")).alias("value"), F.count("*").alias("_n"))
    return whole.where("_n = 4").drop("_n")


def finest(pixels: DataFrame, wanted: DataFrame, zoom: int, lowest: int, size: int, low: float, high: float, columns: int) -> DataFrame:
    """`(r, c, value, z)`: all pixels of the `wanted` tiles (tr, tc) of a zoom; z is the zoom of the tile that gave them.

    `pixels`: z, r, c, value, addressed over the whole of each zoom; `columns` is the width of `zoom` in pixels. A tile that
    a zoom lacks, or that holds a value outside low..high, is made from the zoom below, down to `lowest`; its parent's
    neighbours are made too where they lack, so values run on across the parents' seams. A wanted tile without any ancestor
    has no rows. One stored table for each zoom, so the plan doesn't grow with them.
    """
    good = plausible_pixels(pixels, size, low, high)
    ring = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in (-1, 0, 1) for b in (-1, 0, 1)])
    need, lacks = {zoom: wanted.select("tr", "tc").distinct()}, {}
    for z in range(zoom, lowest - 1, -1):
        there = good.where(F.col("z") == z).select("tr", "tc").distinct()
        lacks[z] = stored(need[z].join(there, ["tr", "tc"], "left_anti"))
        wide = max(1, columns // size >> (zoom - z + 1))
        parents = lacks[z].select(F.floor(F.col("tr") / 2).alias("pr"), F.floor(F.col("tc") / 2).alias("pc")).distinct().select("*", F.inline(ring))
        need[z - 1] = parents.select((F.col("pr") + F.col("dy")).alias("tr"), F.pmod(F.col("pc") + F.col("dx"), F.lit(wide)).alias("tc")).where("tr >= 0").distinct()
    whole = good.where(F.col("z") == lowest).join(need[lowest], ["tr", "tc"], "left_semi").select("tr", "tc", "r", "c", "value", F.col("z").alias("from_z"))
    for z in range(lowest + 1, zoom + 1):
        below = stored(whole)
        source = below.select(F.col("tr").alias("pr"), F.col("tc").alias("pc"), "from_z").distinct()
        made = upsample(lacks[z], below, size, columns >> (zoom - z + 1))
        made = made.withColumns({"pr": F.floor(F.col("tr") / 2), "pc": F.floor(F.col("tc") / 2)}).join(source, ["pr", "pc"])
        own = good.where(F.col("z") == z).join(need[z], ["tr", "tc"], "left_semi").select("tr", "tc", "r", "c", "value", F.col("z").alias("from_z"))
        whole = own.union(made.select(*own.columns))
    return whole.select("r", "c", "value", F.col("from_z").alias("z"))


def feathered(pixels: DataFrame, surveyed: DataFrame, model: DataFrame, size: int, unit_m: float | Column, columns: int, blend_m: float = 400.0, rings: int = 4, shore: float = 0.5, land: float = 0.51) -> DataFrame:
    """`(r, c, value)`: `pixels` (r, c, value) drawn towards `model` (r, c, model) with distance from the `surveyed` tiles (tr, tc).

    Pixels of surveyed tiles stay as they are, so do those within `shore` of zero and those without a model value. Others
    take the share t * t * (3 - 2 t) of the model, t being the distance of the pixel's middle from the nearest surveyed
    tile over `blend_m`, at most 1; what was above `shore` doesn't fall below `land`. Tiles are `size` pixels and `unit_m`
    metres wide (a column may follow `tr`), `columns` of them round the globe. The surveyed tiles within `rings` of each
    other tile are found by equi joins on tiles: at most (2 rings + 1)^2 of them.
    """
    tiled = _tiles(pixels, size)
    known = surveyed.select("tr", "tc").distinct()
    open_tiles = tiled.select("tr", "tc").distinct().join(known, ["tr", "tc"], "left_anti")
    near = F.array(*[F.struct(F.lit(a).alias("dy"), F.lit(b).alias("dx")) for a in range(-rings, rings + 1) for b in range(-rings, rings + 1) if a or b])
    asked = open_tiles.select("tr", "tc", F.inline(near)).select("tr", "tc", (F.col("tr") + F.col("dy")).alias("sr"), (F.col("tc") + F.col("dx")).alias("sc"), F.pmod(F.col("tc") + F.col("dx"), F.lit(columns)).alias("at"))
    met = asked.join(known.select(F.col("tr").alias("sr"), F.col("tc").alias("at")), ["sr", "at"]).groupBy("tr", "tc").agg(F.collect_list(F.struct("sr", "sc")).alias("near"))
    tiles = open_tiles.join(met, ["tr", "tc"], "left")
    py, px = (F.col("r") + 0.5) / size, (F.col("c") + 0.5) / size
    beside = lambda p, at: F.greatest(at - p, p - (at + 1), F.lit(0.0))
    d2 = F.array_min(F.transform("near", lambda s: beside(px, s["sc"]) * beside(px, s["sc"]) + beside(py, s["sr"]) * beside(py, s["sr"])))
    t = F.coalesce(F.least(F.lit(1.0), F.sqrt(d2) * unit_m / blend_m), F.lit(1.0))
    m, g = F.col("value"), F.col("model")
    drawn = tiled.join(tiles, ["tr", "tc"]).join(model.select("r", "c", "model"), ["r", "c"], "left").withColumn("t", t)
    mixed = m + F.col("t") * F.col("t") * (3 - 2 * F.col("t")) * (g - m)
    out = F.when((F.abs(m) <= shore) | g.isNull() | (F.col("t") <= 0), m).when(m > shore, F.greatest(mixed, F.lit(land))).otherwise(mixed)
    return drawn.select("r", "c", out.alias("value")).union(tiled.join(known, ["tr", "tc"], "left_semi").select("r", "c", "value"))
