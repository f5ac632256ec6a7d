"""Bucketed spatial joins: every one is an equi join on a cell key, then an exact test.

Rows that are spread over cells are many more than the planner takes them for, so the joins ask for a merge: a broadcast
would bring them all to the driver.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import METRES_PER_DEGREE
from geoloom.session import stored

HALF_TURN = 1_800_000_000


def metres_e7(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between fixed-point positions on the local scale of the first, the shorter way round the globe."""
    dy = (lat2 - lat1) / 1e7 * METRES_PER_DEGREE
    turn = F.when(lon2 - lon1 > HALF_TURN, -2 * HALF_TURN).when(lon2 - lon1 < -HALF_TURN, 2 * HALF_TURN).otherwise(0)
    dx = (lon2 - lon1 + turn) / 1e7 * METRES_PER_DEGREE * F.cos(F.radians(lat1 / 1e7))
    return F.sqrt(dx * dx + dy * dy)


def _columns(band: Column, height_e7: int, reach: float) -> Column:
    """Columns of a latitude band, none narrower than `reach` metres at the band's latitude furthest from the equator."""
    far = F.least(F.greatest(F.abs(band * height_e7), F.abs((band + 1) * height_e7)) / 1e7, F.lit(90.0))
    return F.greatest(F.floor(360 * METRES_PER_DEGREE * F.cos(F.radians(far)) / reach), F.lit(1).cast("bigint"))


def near_pairs(left: DataFrame, right: DataFrame, reach: float, left_at: tuple[str, str], right_at: tuple[str, str], also: tuple[tuple[str, str], ...] = ()) -> DataFrame:
    """Pairs of rows (positions in 1e-7 degrees) that may lie within `reach` metres: all that do, at any latitude, and some more.

    Cells are latitude bands of `reach` metres, each cut into as many columns as its narrow side allows, all round the
    globe. The right side is given three bands and in each of them three of the band's own columns, so each pair meets
    once, across the 180th meridian too. `also`: pairs of columns that have to be equal, joined on with the cell. Rows of
    null positions meet none.
    """
    if reach <= 0:
        raise ValueError("reach has to be above zero")
    height = int(-(-reach * 1e7 // METRES_PER_DEGREE))
    place = lambda lon, n: F.pmod(F.floor((lon + HALF_TURN) / (2.0 * HALF_TURN) * n), n)
    band = F.floor(F.col(left_at[0]) / height)
    own = left.withColumn("_cy", band).withColumn("_cx", place(F.col(left_at[1]), _columns(F.col("_cy"), height, reach)))
    spread = right.withColumn("_cy", F.explode(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.floor(F.col(right_at[0]) / height) + d)))
    n = _columns(F.col("_cy"), height, reach)
    beside = F.array_distinct(F.transform(F.array(*[F.lit(d) for d in (-1, 0, 1)]), lambda d: F.pmod(place(F.col(right_at[1]), n) + d, n)))
    spread = spread.withColumn("_cx", F.explode(beside))
    keys = [*[F.col(f"l.{c}") == F.col(f"r.{c}") for c in ("_cy", "_cx")], *[F.col(f"l.{a}") == F.col(f"r.{b}") for a, b in also]]
    met = own.alias("l").join(spread.alias("r").hint("merge"), keys)
    return met.select(*[F.col(f"l.{c}") for c in left.columns], *[F.col(f"r.{c}") for c in right.columns])


def filed(boxes: DataFrame, step_e7: int, south: Column, west: Column, north: Column, east: Column) -> DataFrame:
    """`boxes` under every cell they touch (`_cy`, `_cx`), the columns counted round the globe; a west beyond the east is across the 180th meridian."""
    n = 2 * HALF_TURN // step_e7
    column = lambda x: F.floor((x + HALF_TURN) / (2.0 * HALF_TURN) * n)
    over = F.when(west > east, east + 2 * HALF_TURN).otherwise(east)
    rows = boxes.withColumn("_cy", F.explode(F.sequence(F.floor(south / step_e7), F.floor(north / step_e7))))
    last = F.least(column(over), column(west) + n - 1)
    return rows.withColumn("_cx", F.explode(F.sequence(column(west), last))).withColumn("_cx", F.pmod(F.col("_cx"), F.lit(n)))


def with_boxes_near(left: DataFrame, boxes: DataFrame, reach: float | Column, left_box: tuple[str, str, str, str], box: tuple[str, str, str, str], step_e7: int = 100_000, also: tuple[str, ...] = (), once: bool = False) -> DataFrame:
    """Pairs of boxes (south, west, north, east in 1e-7 degrees; a point is a box of no size) that may come within `reach` metres.

    The reach may be a column of `boxes`. `also`: columns of both that have to be equal, joined on with the cell. `once`: a
    pair comes out only if the one box touches the other grown by the reach, and in one row of cells; else in each cell that both touch.
    Both are filed under the cells that they touch, those of `boxes` grown by the reach at their latitude, so boxes of any
    size are found; a pair meets in each cell that both touch. Columns run all round the globe: a box may reach beyond
    +-180 degrees, or have its west beyond its east, and meets what lies on the other side of the meridian.
    """
    pad = reach / METRES_PER_DEGREE * 1e7
    south, west, north, east = (F.col(c) for c in box)
    wide = pad / F.greatest(F.cos(F.radians(F.least(F.greatest(F.abs(south), F.abs(north)) + pad, F.lit(9e8)) / 1e7)), F.lit(1e-3))
    over = F.when(west > east, east + 2 * HALF_TURN).otherwise(east)
    grown = boxes.withColumns({"_s": south - pad, "_w": west - wide, "_n": north + pad, "_e": over + wide})
    spread = filed(grown, step_e7, *(F.col(c) for c in ("_s", "_w", "_n", "_e")))
    if not once:
        spread = spread.drop("_s", "_w", "_n", "_e")
    met = filed(left, step_e7, *(F.col(c) for c in left_box)).join(spread.hint("merge"), ["_cy", "_cx", *also])
    if once:
        # Two stretches of a circle meet if one begins within the other. Of the rows of cells, the first that both touch counts.
        l_south, l_west, l_north, l_east = (F.col(c) for c in left_box)
        after = lambda a, b: F.pmod(a - b, F.lit(2.0 * HALF_TURN))
        l_wide = F.when(l_west > l_east, l_east + 2 * HALF_TURN).otherwise(l_east) - l_west
        touch = (after(l_west, F.col("_w")) <= F.col("_e") - F.col("_w") + 1e-3) | (after(F.col("_w"), l_west) <= l_wide + 1e-3)
        met = met.where((l_south <= F.col("_n")) & (l_north >= F.col("_s")) & touch)
        met = met.where(F.col("_cy") == F.floor(F.greatest(l_south, F.col("_s")) / step_e7)).drop("_s", "_w", "_n", "_e")
    return met.drop("_cy", "_cx")


def turned(lon: Column) -> Column:
    """A difference of longitudes (1e-7 degrees), the shorter way round the globe."""
    return F.when(lon > HALF_TURN, lon - 2 * HALF_TURN).when(lon < -HALF_TURN, lon + 2 * HALF_TURN).otherwise(lon)


def nearest(pairs: DataFrame, left_id: str, distance: str, tie: str) -> DataFrame:
    """The pair of least distance (rounded to 1e-6) for each left row; the smaller tie key wins."""
    order = Window.partitionBy(left_id).orderBy(F.round(distance, 6), tie)
    return pairs.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def nearest_within(left: DataFrame, right: DataFrame, key: str, reach: float, left_at: tuple[str, str], right_at: tuple[str, str], ties: list, k: int = 1, also: tuple[tuple[str, str], ...] = (), good: Column | None = None, digits: int = 3) -> DataFrame:
    """The `k` nearest rows of `right` for each `key` of `left`, none beyond `reach` metres: both's columns and `d`, the metres.

    Distances are compared to so many `digits`; equal ones go by the columns `ties`. Pairs are of rows that agree in `also`
    and fulfil `good`. A row looks within a 64th of the reach first; only rows that find fewer than `k` so near look again,
    four times as far. So a row meets about as many others in a crowd as where they are sparse.
    """
    left, right = stored(left), stored(right)
    parts, near = [], reach / 64
    while True:
        pairs = near_pairs(right, left, near, right_at, left_at, tuple((b, a) for a, b in also)).select(*left.columns, *right.columns)
        met = pairs.withColumn("d", metres_e7(*[F.col(c) for c in (*left_at, *right_at)])).where(F.round("d", digits) <= near)
        order = Window.partitionBy(key).orderBy(F.round("d", digits), *ties)
        top = (met if good is None else met.where(good)).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= k)
        if near >= reach:
            return reduce(DataFrame.union, [*parts, top.drop("_n")])
        top = stored(top)
        full = top.where(F.col("_n") == k).where(F.round("d", digits) < near - 2 * 10.0**-digits).select(key)
        parts.append(top.join(full.hint("merge"), key, "left_semi").select(*top.columns).drop("_n"))
        left = stored(left.join(full.hint("merge"), key, "left_anti").select(*left.columns))
        near = min(near * 4, reach)


def box_cells(boxes: DataFrame, step_e7: int, south: str = "south_e7", west: str = "west_e7", north: str = "north_e7", east: str = "east_e7", most: int | None = None) -> DataFrame:
    """Each box under every cell it touches, `(cell_lat, cell_lon)`; boxes of more than `most` cells are left out."""
    lo_y, hi_y = F.floor(F.col(south) / step_e7), F.floor(F.col(north) / step_e7)
    lo_x, hi_x = F.floor(F.col(west) / step_e7), F.floor(F.col(east) / step_e7)
    if most is not None:
        boxes = boxes.where((hi_y - lo_y + 1) * (hi_x - lo_x + 1) <= most)
    return boxes.withColumn("cell_lat", F.explode(F.sequence(lo_y, hi_y))).withColumn("cell_lon", F.explode(F.sequence(lo_x, hi_x)))


def square_edges(table: DataFrame, id_column: str) -> DataFrame:
    """Ring edges `(id, ay, ax, by, bx)` of axis-parallel footprints given by centre and half sides."""
    y0, y1, x0, x1 = F.col("lat_e7") - F.col("half_lat"), F.col("lat_e7") + F.col("half_lat"), F.col("lon_e7") - F.col("half_lon"), F.col("lon_e7") + F.col("half_lon")
    edge = lambda a, b, c, d: F.struct(a.alias("ay"), b.alias("ax"), c.alias("by"), d.alias("bx"))
    return table.select(id_column, F.inline(F.array(edge(y0, x0, y0, x1), edge(y0, x1, y1, x1), edge(y1, x1, y1, x0), edge(y1, x0, y0, x0))))


def crosses(py: Column, px: Column, ay: Column, ax: Column, by: Column, bx: Column) -> Column:
    """Whether the ray from the point towards greater longitudes crosses the edge."""
    return ((ay > py) != (by > py)) & (px < (bx - ax) * (py - ay) / F.when(by == ay, F.lit(1)).otherwise(by - ay) + ax)


def points_in_polygons(points: DataFrame, edges: DataFrame, point_id: str, polygon_id: str, at: tuple[str, str], step_e7: int = 50_000) -> DataFrame:
    """`(point_id, polygon_id)` by the even-odd rule over all edges of a polygon, holes included.

    Polygons are filed under the cells of their boxes, points under their own; edges join only after the cells meet.
    """
    boxes = edges.groupBy(polygon_id).agg(
        F.least(F.min("ay"), F.min("by")).alias("south_e7"), F.least(F.min("ax"), F.min("bx")).alias("west_e7"), F.greatest(F.max("ay"), F.max("by")).alias("north_e7"), F.greatest(F.max("ax"), F.max("bx")).alias("east_e7")
    )
    y, x = F.col(at[0]), F.col(at[1])
    filed = points.select(point_id, y.alias("_y"), x.alias("_x"), F.floor(y / step_e7).alias("cell_lat"), F.floor(x / step_e7).alias("cell_lon"))
    met = filed.join(box_cells(boxes, step_e7).hint("merge"), ["cell_lat", "cell_lon"]).where("_y between south_e7 and north_e7 and _x between west_e7 and east_e7")
    hit = met.select(point_id, polygon_id, "_y", "_x").join(edges.hint("merge"), polygon_id)
    n = F.sum(crosses(F.col("_y"), F.col("_x"), F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")).cast("int"))
    return hit.groupBy(point_id, polygon_id).agg(n.alias("_n")).where("_n % 2 = 1").select(point_id, polygon_id)
