"""Order statistics by rank, as the floor-index rules need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(df: DataFrame, groups: list[str], value: str, ties: list[str]) -> DataFrame:
    """`df` with k, the rank of its value from 0 within the group, and n, the group's rows."""
    whole = Window.partitionBy(*groups)
    return df.withColumns({"k": F.row_number().over(whole.orderBy(value, *ties)) - 1, "n": F.count("*").over(whole)})


def rounded(value: Column, digits: int) -> Column:
    """`value` at so many decimals with its sign, as other engines have it: a small negative one is -0.0, which F.round makes 0.0."""
    short = F.round(value, digits)
    return F.when((short == 0) & (value < 0), F.lit(-0.0)).otherwise(short)


def steady_mean(value: Column) -> Column:
    """The mean of doubles, the same whatever the order of its rows: they are added up as decimals, unless some are too large or not finite."""
    exact = value.try_cast("decimal(38,18)")
    return F.when(F.count(exact) == F.count(value), F.try_divide(F.sum(exact).cast("double"), F.count(value))).otherwise(F.avg(value))
