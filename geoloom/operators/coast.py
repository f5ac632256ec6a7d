"""Land and sea from directed coastlines: the pieces of a raster that the lines part, and a vote of either side for each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.components import connected_components
from geoloom.session import stored

#: Columns of a row that are taken together, and that neighbouring rows meet under.
BLOCK, BUCKET = 4096, 64
#: Cells between the cuts at a row and a column line that are taken for one corner: rounding parts them.
CORNER = 1e-9
#: How far beside the line a side is asked, and the metres between votes.
BESIDE, APART = 1.6, 2.0


def line_cells(segments: DataFrame) -> DataFrame:
    """The cells `(r, c)` that segments (ay, ax, by, bx in cells) pass through, each once; neighbours share a side.

    A segment is cut where it meets a row or column line; each part lies in one cell. Where it passes through a corner, the
    cell before it in rows and behind it in columns is taken too. Parts shorter than CORNER cells are corners, or ends on a
    line, and have no cell of their own.
    """
    y = lambda t: F.col("ay") + t * (F.col("by") - F.col("ay"))
    x = lambda t: F.col("ax") + t * (F.col("bx") - F.col("ax"))

    def cuts(a: Column, b: Column) -> Column:
        low, high = F.floor(F.least(a, b)) + 1, F.ceil(F.greatest(a, b)) - 1
        every = F.transform(F.sequence(low, F.greatest(low, high)), lambda k: (k - a) / F.when(a == b, F.lit(1.0)).otherwise(b - a))
        return F.when((a != b) & (high >= low), every).otherwise(F.array().cast("array<double>"))

    ends = F.array(F.lit(0.0), F.lit(1.0))
    cut = segments.withColumn("_t", F.array_sort(F.concat(ends, cuts(F.col("ay"), F.col("by")), cuts(F.col("ax"), F.col("bx")))))
    part = cut.withColumn("_k", F.explode(F.sequence(F.lit(0), F.size("_t") - 2))).withColumns({"_a": F.get("_t", F.col("_k")), "_b": F.get("_t", F.col("_k") + 1)})
    short = (F.col("_b") - F.col("_a")) * F.greatest(F.abs(F.col("by") - F.col("ay")), F.abs(F.col("bx") - F.col("ax"))) < CORNER
    corner = short & (F.col("_a") > 0) & (F.col("_b") < 1)
    middle = (F.col("_a") + F.col("_b")) / 2
    # In a corner: the row that the segment comes from, the column that it goes to.
    before = F.round(y(middle)).cast("bigint") - F.when(F.col("by") > F.col("ay"), 1).otherwise(0)
    after = F.round(x(middle)).cast("bigint") - F.when(F.col("bx") > F.col("ax"), 0).otherwise(1)
    return part.where(~short | corner | ((F.col("_a") == 0) & (F.col("_b") == 1))).select(F.when(corner, before).otherwise(F.floor(y(middle))).alias("r"), F.when(corner, after).otherwise(F.floor(x(middle))).alias("c")).distinct()


def pieces(cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """4-connected pieces of `cells` (r, c): each cell's run `(r, c, c0)`, and each run's piece `(r, c0, piece)`.

    A run is a row's unbroken stretch of cells, at most BLOCK long, so the graph has a node for each run and not for each
    cell; runs of neighbouring rows meet by row and bucket of columns. A piece is named by its first run.
    """
    block = F.floor(F.col("c") / BLOCK)
    row = Window.partitionBy("r", block).orderBy("c")
    held = cells.select("r", "c").distinct().withColumn("_g", F.col("c") - F.row_number().over(row))
    of_cell = held.withColumn("c0", F.min("c").over(Window.partitionBy("r", block, "_g"))).drop("_g")
    runs = stored(of_cell.groupBy("r", "c0").agg(F.max("c").alias("c1")))
    bucketed = runs.withColumn("_b", F.explode(F.sequence(F.floor(F.col("c0") / BUCKET), F.floor(F.col("c1") / BUCKET))))
    above = bucketed.select((F.col("r") + 1).alias("r"), "_b", F.col("c0").alias("d0"), F.col("c1").alias("d1"))
    name = lambda r, c: F.struct(r.alias("r"), c.alias("c0"))
    down = bucketed.join(above, ["r", "_b"]).where("c0 <= d1 and d0 <= c1").select(name(F.col("r") - 1, F.col("d0")).alias("src"), name(F.col("r"), F.col("c0")).alias("dst"))
    on = runs.select("r", (F.col("c1") + 1).alias("c0"), F.col("c0").alias("d0")).join(runs.select("r", "c0"), ["r", "c0"])
    along = on.select(name(F.col("r"), F.col("d0")).alias("src"), name(F.col("r"), F.col("c0")).alias("dst"))
    found = connected_components(down.union(along))
    named = runs.join(found.select(F.col("node.r").alias("r"), F.col("node.c0").alias("c0"), "component"), ["r", "c0"], "left")
    return of_cell, stored(named.select("r", "c0", F.coalesce("component", name(F.col("r"), F.col("c0"))).alias("piece")))


def side_votes(coast: DataFrame) -> DataFrame:
    """`(r, c, sea, land)`: what samples along the directed segments say of the cells beside them, the sea to the right (rows going down)."""
    dy, dx = F.col("by") - F.col("ay"), F.col("bx") - F.col("ax")
    sized = coast.withColumns({"_dy": dy, "_dx": dx}).withColumn("_len", F.sqrt(F.col("_dx") * F.col("_dx") + F.col("_dy") * F.col("_dy"))).where("_len > 1e-6")
    n = F.greatest(F.floor(F.col("_len") / APART), F.lit(1))
    sampled = sized.withColumn("_n", n).withColumn("_s", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_n"))))
    t = F.col("_s") / F.col("_n")
    py, px = F.col("ay") + F.col("_dy") * t, F.col("ax") + F.col("_dx") * t
    ny, nx = F.col("_dx") / F.col("_len") * BESIDE, -F.col("_dy") / F.col("_len") * BESIDE
    place = lambda sign, sea: F.struct(F.floor(py + sign * ny).alias("r"), F.floor(px + sign * nx).alias("c"), F.lit(sea).alias("sea"), F.lit(1 - sea).alias("land"))
    return sampled.select(F.inline(F.array(place(1, 1), place(-1, 0)))).groupBy("r", "c").agg(F.sum("sea").alias("sea"), F.sum("land").alias("land"))


def sea_cells(cells: DataFrame, coast: DataFrame, level: float = 0.0) -> DataFrame:
    """`(r, c, sea)` for all `cells` (r, c, elevation, each once), from directed coastlines `coast` (ay, ax, by, bx in cells).

    Cells under a line are sea: the line is the water's edge. Of the pieces that are left, one with more votes for sea is
    sea; of as many on both sides, and none at all, the cells that lie below `level`. A null elevation is land.
    """
    edge = line_cells(coast)
    free = cells.join(edge, ["r", "c"], "left_anti")
    of_cell, of_run = pieces(free)
    votes = side_votes(coast).join(of_cell, ["r", "c"]).groupBy("r", "c0").agg(F.sum("sea").alias("sea"), F.sum("land").alias("land"))
    verdict = of_run.join(votes, ["r", "c0"]).groupBy("piece").agg(F.sum("sea").alias("sea"), F.sum("land").alias("land"))
    told = of_run.join(verdict, "piece", "left").select("r", "c0", F.coalesce(F.col("sea") - F.col("land"), F.lit(0)).alias("lead"))
    below = F.coalesce(F.col("elevation") < level, F.lit(False))
    inner = free.join(of_cell, ["r", "c"]).join(told, ["r", "c0"]).select("r", "c", F.when(F.col("lead") == 0, below).otherwise(F.col("lead") > 0).alias("sea"))
    return inner.union(cells.join(edge, ["r", "c"], "left_semi").select("r", "c", F.lit(True).alias("sea")))
