"""Features cut at tile borders put together again: edges that cancel go, what is left is joined to rings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators.arrow import assemble_rings


def outer_edges(edges: DataFrame, key: str, step: int) -> DataFrame:
    """`edges` (key, ay, ax, by, bx; directed, whole numbers) of all pieces of a feature without those that its pieces share.

    Pieces meet along lines of the grid of `step`, where a piece may have corners that its neighbour lacks. So the stretches
    between all corners of a feature on one line are taken singly: each goes as often one way as the other, or it is an
    edge of the whole. Edges inside tiles stay as they are; those of no length, and of nulls, are left out.
    """
    real = edges.where("ay <> by or ax <> bx").select(key, *[F.col(c).cast("bigint").alias(c) for c in ("ay", "ax", "by", "bx")])
    along_x = (F.col("ay") == F.col("by")) & (F.pmod("ay", F.lit(step)) == 0)
    along_y = (F.col("ax") == F.col("bx")) & (F.pmod("ax", F.lit(step)) == 0)
    inner = real.where(~along_x & ~along_y).select(key, "ay", "ax", "by", "bx")
    on = real.where(along_x | along_y).select(key, along_x.alias("flat"), F.when(along_x, F.col("ay")).otherwise(F.col("ax")).alias("line"), F.when(along_x, F.col("ax")).otherwise(F.col("ay")).alias("a"), F.when(along_x, F.col("bx")).otherwise(F.col("by")).alias("b"))
    line = [key, "flat", "line"]
    corners = on.select(*line, F.explode(F.array("a", "b")).alias("p")).distinct()
    stretches = corners.withColumn("q", F.lead("p").over(Window.partitionBy(*line).orderBy("p"))).where("q is not null")
    held = on.withColumns({"low": F.least("a", "b"), "high": F.greatest("a", "b"), "sense": F.when(F.col("b") > F.col("a"), 1).otherwise(-1)})
    net = held.join(stretches, line).where("p >= low and q <= high").groupBy(*line, "p", "q").agg(F.sum("sense").alias("net")).where("net <> 0")
    start, stop = F.when(F.col("net") > 0, F.col("p")).otherwise(F.col("q")), F.when(F.col("net") > 0, F.col("q")).otherwise(F.col("p"))
    at = lambda p, flat: F.when(F.col("flat") == flat, F.col("line")).otherwise(p)
    return inner.union(net.select(key, at(start, True), at(start, False), at(stop, True), at(stop, False)))


def dissolve(edges: DataFrame, key: str, step: int) -> DataFrame:
    """`(key, ring, seq, y, x)`: the rings of each feature of which `edges` are the pieces' edges, corners in order.

    Corners where a border cut an outline stay in it. The edges of one feature are one group when they are joined.
    """
    left = outer_edges(edges, key, step)
    place = lambda y, x: F.concat_ws(",", F.col(y), F.col(x))
    numbered = left.withColumn("way_id", F.row_number().over(Window.partitionBy(key).orderBy("ay", "ax", "by", "bx")).cast("bigint"))
    rings = assemble_rings(numbered.select(key, "way_id", place("ay", "ax").alias("first"), place("by", "bx").alias("last")), [key])
    met = rings.join(numbered, [key, "way_id"])
    pick = lambda a, b: F.when(F.col("reversed"), F.col(b)).otherwise(F.col(a))
    return met.select(key, "ring", "seq", pick("ay", "by").alias("y"), pick("ax", "bx").alias("x"))


def ring_areas(rings: DataFrame, key: str) -> DataFrame:
    """`(key, ring, corners, area)`: twice the signed area of each ring, exact for whole numbers below 2^31."""
    along = Window.partitionBy(key, "ring").orderBy("seq")
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = rings.withColumns({"y2": F.coalesce(F.lead("y").over(along), F.first("y").over(whole)), "x2": F.coalesce(F.lead("x").over(along), F.first("x").over(whole))})
    y0, x0 = F.first("y").over(whole), F.first("x").over(whole)
    moved = nxt.select(key, "ring", (F.col("x") - x0).alias("x"), (F.col("y") - y0).alias("y"), (F.col("x2") - x0).alias("x2"), (F.col("y2") - y0).alias("y2"))
    return moved.groupBy(key, "ring").agg(F.count("*").alias("corners"), F.sum(F.col("x") * F.col("y2") - F.col("x2") * F.col("y")).alias("area"))
