"""Profiles along lines, positions `(line, i, value)`: smoothing, ramps, gaps, coding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _along(line: str = "line") -> Window:
    return Window.partitionBy(line).orderBy("i")


def smooth(p: DataFrame, half: int, room: float = 1.0) -> DataFrame:
    """Centred moving average of +-half positions, held to +-room of the raw value and blended to the pinned ends."""
    w = _along()
    mean = F.avg("value").over(w.rowsBetween(-half, half))
    last = F.max("i").over(Window.partitionBy("line"))
    held = F.least(F.greatest(mean, F.col("value") - room), F.col("value") + room)
    near = F.least(F.least(F.col("i"), last - F.col("i")) / float(half), F.lit(1.0))
    return p.withColumn("smooth", F.col("value") + (held - F.col("value")) * near)


def ramp_up(p: DataFrame, need: str, grade: float) -> DataFrame:
    """The lowest profile that covers every need and climbs no steeper than `grade` per position: a cone over each need."""
    w = _along()
    fore = F.max(F.col(need) + grade * F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - grade * F.col("i")
    back = F.max(F.col(need) - grade * F.col("i")).over(w.rowsBetween(0, Window.unboundedFollowing)) + grade * F.col("i")
    return p.withColumn("ramp", F.greatest(fore, back))


def ramp_down(p: DataFrame, cap: str, grade: float) -> DataFrame:
    """The same from above: the highest profile under every cap."""
    w = _along()
    fore = F.min(F.col(cap) - grade * F.col("i")).over(w.rowsBetween(Window.unboundedPreceding, 0)) + grade * F.col("i")
    back = F.min(F.col(cap) + grade * F.col("i")).over(w.rowsBetween(0, Window.unboundedFollowing)) - grade * F.col("i")
    return p.withColumn("cap", F.least(fore, back))


def fill_gaps(p: DataFrame) -> DataFrame:
    """Nulls become the straight line between the known values round them; both ends are held."""
    before, after = _along().rowsBetween(Window.unboundedPreceding, 0), _along().rowsBetween(0, Window.unboundedFollowing)
    at = F.when(F.col("value").isNotNull(), F.col("i"))
    i0, i1 = F.last(at, ignorenulls=True).over(before), F.first(at, ignorenulls=True).over(after)
    v0, v1 = F.last("value", ignorenulls=True).over(before), F.first("value", ignorenulls=True).over(after)
    line = F.when(i0 == i1, v0).otherwise(v0 + (v1 - v0) * (F.col("i") - i0) / (i1 - i0))
    return p.withColumn("filled", F.coalesce(line, v0, v1))


def tilt(p: DataFrame, value: str, start: Column, end: Column) -> DataFrame:
    """Shift a profile linearly so that it begins at `start` and ends at `end`."""
    whole = _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first(value).over(whole), F.last(value).over(whole), F.max("i").over(whole)
    share = F.when(n == 0, 0.0).otherwise(F.col("i") / n)
    return p.withColumn("tilted", F.col(value) + (start - first) * (1 - share) + (end - last) * share)


def _straight() -> Column:
    """The straight line between the grounds at the first and the last position."""
    whole = _along().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first, last, n = F.first("ground").over(whole), F.last("ground").over(whole), F.max("i").over(whole)
    return F.when(n == 0, first).otherwise(first + (last - first) * F.col("i") / n)


def deck(p: DataFrame, grade: float) -> DataFrame:
    """Bridge deck: the straight line between the ends, or what crossing ways below need, ramped."""
    straight = p.withColumn("_line", _straight())
    return ramp_up(straight.withColumn("_need", F.greatest("_line", F.coalesce("need", "_line"))), "_need", grade).withColumn("deck", F.col("ramp")).drop("_line", "_need", "ramp")


def bore(p: DataFrame, grade: float) -> DataFrame:
    """Tunnel floor: the straight line between the ends, or what crossing ways above leave free, ramped."""
    straight = p.withColumn("_line", _straight())
    return ramp_down(straight.withColumn("_cap", F.least("_line", F.coalesce("need", "_line"))), "_cap", grade).withColumn("bore", F.col("cap")).drop("_line", "_cap", "cap")


def slope_limited(p: DataFrame, grade: float) -> DataFrame:
    """Between the envelope from above and from below: no step is steeper than `grade`."""
    both = ramp_down(ramp_up(p, "value", grade), "value", grade)
    return both.withColumn("limited", (F.col("ramp") + F.col("cap")) / 2).drop("ramp", "cap")


def delta(p: DataFrame, value: str = "value") -> DataFrame:
    """First value, then differences."""
    return p.withColumn("delta", F.col(value) - F.coalesce(F.lag(value).over(_along()), F.lit(0)))


def undelta(p: DataFrame) -> DataFrame:
    return p.withColumn("value", F.sum("delta").over(_along().rowsBetween(Window.unboundedPreceding, 0)))


def every_nth(p: DataFrame, n: int) -> DataFrame:
    return p.withColumn("_k", F.row_number().over(_along()) - 1).where(F.col("_k") % n == 0).drop("_k")


def flattest_strip(p: DataFrame, width: int) -> DataFrame:
    """The strip of `width` positions with the least range plus a quarter of its offset from the middle, and its upper median."""
    w = _along().rowsBetween(0, width - 1)
    n = F.max("i").over(Window.partitionBy("line"))
    s = p.withColumns({"low": F.min("value").over(w), "high": F.max("value").over(w), "held": F.sort_array(F.collect_list("value").over(w)), "n": n})
    s = s.where(F.col("i") + width - 1 <= F.col("n"))
    score = F.col("high") - F.col("low") + 0.25 * F.abs(F.col("i") + (width - 1) / 2 - F.col("n") / 2)
    s = s.withColumn("score", score).withColumn("_k", F.row_number().over(Window.partitionBy("line").orderBy(F.round("score", 6), "i"))).where("_k = 1")
    return s.select("line", F.col("i").alias("start"), "score", F.get("held", F.floor(F.size("held") / 2).cast("int")).alias("level"))


def budgeted(p: DataFrame, order: Column, size: str, budget: float, group: str | None = None) -> DataFrame:
    """Rows in order until the running total passes the budget, within each group."""
    w = (Window.partitionBy(group) if group else Window.partitionBy(F.lit(0))).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return p.withColumn("running", F.sum(size).over(w)).where(F.col("running") <= budget)
