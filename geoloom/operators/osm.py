"""Element tables: resolving geometry, importing an area, filing features under cells."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import METRES_PER_DEGREE
from geoloom.operators.spatial import box_cells

#: Cells that a way's and a relation's box may span.
WAY_CELLS, RELATION_CELLS = 400, 20_000


def resolve_ways(ways: DataFrame, nodes: DataFrame) -> DataFrame:
    """Long form of the ways' geometry: `(way_id, pos, lat_e7, lon_e7)`, in the order of refs.

    Refs without a node are skipped; a way of fewer than two found points has no geometry.
    """
    refs = ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))
    found = refs.join(nodes.select("node_id", "lat_e7", "lon_e7"), "node_id")
    return found.withColumn("_n", F.count("*").over(Window.partitionBy("way_id"))).where("_n >= 2").select("way_id", "pos", "lat_e7", "lon_e7")


def segments(points: DataFrame, line: str = "way_id", order: str = "pos") -> DataFrame:
    """Segments of each line with their metres and the metres that lie before them."""
    along = Window.partitionBy(line).orderBy(order)
    nxt = points.withColumns({"lat2_e7": F.lead("lat_e7").over(along), "lon2_e7": F.lead("lon_e7").over(along)}).where("lat2_e7 is not null")
    dy = (F.col("lat2_e7") - F.col("lat_e7")) / 1e7 * METRES_PER_DEGREE
    dx = (F.col("lon2_e7") - F.col("lon_e7")) / 1e7 * METRES_PER_DEGREE * F.cos(F.radians(F.col("lat_e7") / 1e7))
    sized = nxt.withColumns({"dx": dx, "dy": dy}).withColumn("metres", F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    return sized.withColumn("before", F.coalesce(F.sum("metres").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))


def way_boxes(points: DataFrame, key: str = "way_id") -> DataFrame:
    return points.groupBy(key).agg(F.min("lat_e7").alias("south_e7"), F.min("lon_e7").alias("west_e7"), F.max("lat_e7").alias("north_e7"), F.max("lon_e7").alias("east_e7"))


def file_under_cells(boxes: DataFrame, most: int = WAY_CELLS, step_e7: int = 1_000_000) -> DataFrame:
    """Features under every cell their box touches; oversize ones are left out before the rows are multiplied."""
    return box_cells(boxes, step_e7, most=most)


def write_cells(filed: DataFrame, path: str) -> None:
    """The cell store: rows of a cell lie together, one folder per cell; an import replaces the store."""
    filed.repartition("cell_lat", "cell_lon").write.partitionBy("cell_lat", "cell_lon").mode("overwrite").parquet(path)


def read_cells(store: DataFrame, key: str, south: int, west: int, north: int, east: int, step_e7: int = 1_000_000) -> DataFrame:
    """Features of a store that touch the box, once each; only overlapping cells are read."""
    cells = store.where(F.col("cell_lat").between(south // step_e7, north // step_e7) & F.col("cell_lon").between(west // step_e7, east // step_e7))
    touching = cells.where((F.col("south_e7") <= north) & (F.col("north_e7") >= south) & (F.col("west_e7") <= east) & (F.col("east_e7") >= west))
    return touching.drop("cell_lat", "cell_lon").dropDuplicates([key])


def kept_ways(ways: DataFrame, members: DataFrame, relations: DataFrame, keep: str) -> DataFrame:
    """Ways that the filter keeps, and the members of kept relations that it doesn't."""
    own = ways.where(keep)
    of_relation = members.join(relations.select("rel_id"), "rel_id", "left_semi").select(F.col("ref").alias("way_id")).distinct()
    others = ways.join(of_relation, "way_id", "left_semi").join(own.select("way_id"), "way_id", "left_anti")
    return own.withColumn("by_relation", F.lit(False)).unionByName(others.withColumn("by_relation", F.lit(True)))


def area_import(nodes: DataFrame, refs: DataFrame, members: DataFrame, south: int, west: int, north: int, east: int) -> DataFrame:
    """Ways of a box, with how they came in: a node inside, or as a further piece of a relation that a way inside touches."""
    inside = nodes.where(F.col("lat_e7").between(south, north) & F.col("lon_e7").between(west, east))
    touching = refs.join(inside.select("node_id"), "node_id", "left_semi").select("way_id").distinct()
    relations = members.join(touching.withColumnRenamed("way_id", "ref"), "ref", "left_semi").select("rel_id").distinct()
    pieces = members.join(relations, "rel_id", "left_semi").select(F.col("ref").alias("way_id")).distinct().join(touching, "way_id", "left_anti")
    return touching.withColumn("how", F.lit("inside")).union(pieces.withColumn("how", F.lit("relation")))


def relation_geometry(members: DataFrame, points: DataFrame) -> DataFrame:
    """Points of the relations' member ways with the inner flag."""
    flagged = members.select("rel_id", F.col("ref").alias("way_id"), (F.col("role") == "inner").alias("inner"))
    return flagged.join(points, "way_id")


def import_summary(filed: DataFrame, boxes: DataFrame) -> DataFrame:
    """One catalogue row: features, cells and joint box of an import."""
    cells = filed.agg(F.countDistinct("cell_lat", "cell_lon").alias("cells"))
    total = boxes.agg(F.count("*").alias("features"), F.min("south_e7").alias("south_e7"), F.min("west_e7").alias("west_e7"), F.max("north_e7").alias("north_e7"), F.max("east_e7").alias("east_e7"))
    both = total.unionByName(cells, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
