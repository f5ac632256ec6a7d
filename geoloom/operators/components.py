"""Connected components of an edge table by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.session import checkpoint, stored


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """`(node, component)` for every node of an edge; component is the smallest node reachable.

    Each round is one large-star and one small-star step: aggregations with a map-side combine and equi joins, so a hub
    that holds a third of all edges is summed before the shuffle and its join partition can be split. The number of
    rounds grows with the logarithm of the longest chain. Self loops and nulls make no edge; repeats count once; an
    empty table gives an empty table. If max_rounds does not suffice, ValueError is raised: no partial result is given.
    """
    pairs = (
        edges.select(F.greatest(src, dst).alias("u"), F.least(src, dst).alias("v"))
        .where(F.col(src).isNotNull() & F.col(dst).isNotNull() & (F.col("u") != F.col("v")))
        .distinct()
    )
    current, before = checkpoint(pairs), None
    for _ in range(max_rounds):
        mark = current.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == before:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component"))
            ).distinct()
        before = mark
        current = checkpoint(_small_star(_large_star(current)))
    raise ValueError(f"components did not settle in {max_rounds} rounds")


def shared_cells(points: DataFrame, line: str, order: str, cell: str) -> DataFrame:
    """`(node, component)` of every line that shares a cell with another, directly or through others; component is the smallest line.

    `points` are (line, order, cell), the cell a long. Components are those of the cells, which the steps of lines tie:
    a step is kept once, however many lines take it, so the graph grows with the cells and not with the lines. Points of
    null lines or cells are left out.
    """
    known = points.where(F.col(line).isNotNull() & F.col(cell).isNotNull()).select(F.col(line).alias("node"), F.col(order).alias("at"), F.col(cell).alias("cell"))
    along = Window.partitionBy("node").orderBy("at")
    steps = stored(known.withColumns({"next": F.lead("cell").over(along), "n": F.row_number().over(along)}).select("node", "cell", "next", "n"))
    tied = connected_components(steps.where("cell <> next").select("cell", "next").distinct(), "cell", "next").select(F.col("node").alias("cell"), F.col("component").alias("root"))
    starts = steps.where("n = 1").select("node", "cell")  # all cells of a line are in one component: its first one tells which
    held = starts.groupBy("cell").agg(F.min("node").alias("low"), F.max("node").alias("high")).join(tied.hint("merge"), "cell", "left").withColumn("root", F.coalesce("root", "cell"))
    named = held.groupBy("root").agg(F.min("low").alias("component"), F.max("high").alias("high")).where("component <> high").select("root", "component")
    of_cell = held.select("cell", "root").join(named.hint("merge"), "root").select("cell", "component")
    return starts.join(of_cell.hint("merge"), "cell").select("node", "component")


def _large_star(pairs: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is tied to the node's smallest neighbour."""
    both = pairs.union(pairs.select(F.col("v"), F.col("u")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()


def _small_star(pairs: DataFrame) -> DataFrame:
    """A node and its smaller neighbours are tied to the smallest of them."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m"))
    tied = pairs.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.union(least.select("u", F.col("m").alias("v"))).distinct()
