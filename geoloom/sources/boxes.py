"""Features with their boxes as Parquet along a space-filling curve, read by box with whole row groups left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoloom.functions.tiles import hilbert_tile_id

#: Zoom of the curve's cells, bytes of a row group, and of the pages that its statistics are kept for.
CURVE_ZOOM, GROUP_BYTES, PAGE_BYTES = 14, 8 << 20, 64 << 10


def write_boxes(features: DataFrame, path: str, box: tuple[str, str, str, str], zoom: int = CURVE_ZOOM, group_bytes: int = GROUP_BYTES) -> None:
    """`features` with a struct `bbox` (south, west, north, east of the columns named), sorted along the Hilbert curve of the boxes' middles.

    Neighbours on the map lie in neighbouring row groups, so the statistics of a group's boxes are narrow. Tasks are dealt
    out by ranges of the curve; each writes files of its own.
    """
    south, west, north, east = (F.col(c) for c in box)
    cells = 1 << zoom
    place = lambda a, b, span: F.least(F.greatest(F.floor((a + b + 2 * span) / (4.0 * span) * cells), F.lit(0)), F.lit(cells - 1))
    at = hilbert_tile_id(zoom, place(west, east, 1_800_000_000), place(south, north, 900_000_000))
    boxed = features.withColumn("bbox", F.struct(south.alias("south"), west.alias("west"), north.alias("north"), east.alias("east"))).withColumn("_at", at)
    sorted_ = boxed.repartitionByRange("_at").sortWithinPartitions("_at").drop("_at")
    sorted_.write.option("parquet.block.size", group_bytes).option("parquet.page.size", min(PAGE_BYTES, group_bytes)).option("parquet.block.size.row.check.min", 100).option("parquet.page.size.row.check.min", 100).parquet(path)


def read_boxes(spark: SparkSession, path: str, south: int, west: int, north: int, east: int) -> DataFrame:
    """Features of such a table whose box touches the one given; the conditions reach the scan as filters on the nested columns."""
    t = spark.read.parquet(path)
    b = F.col("bbox")
    return t.where((b["south"] <= north) & (b["north"] >= south) & (b["west"] <= east) & (b["east"] >= west))
