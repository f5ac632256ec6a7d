"""Writers and their merge rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge_by_key(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows, and the old rows whose key no new row bears."""
    return new.unionByName(old.join(new.select(*keys).distinct(), keys, "left_anti"))


def merge_as_set(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, identical rows once."""
    return old.unionByName(new).dropDuplicates()


def newest_day(grids: DataFrame, day: str = "day") -> DataFrame:
    """Only the rows of the newest day."""
    newest = grids.agg(F.max(day).alias("_newest"))
    return grids.join(newest, grids[day] == newest["_newest"], "left_semi")


def overwrite_cells(rows: DataFrame, path: str) -> None:
    """Replace only the cells that `rows` holds."""
    rows.write.partitionBy("cell_lat", "cell_lon").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
