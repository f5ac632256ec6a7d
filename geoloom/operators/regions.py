"""Features against areas: overlap shares, containing regions, point profiles, densified lines."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.operators import linear
from geoloom.operators.conflate import line_samples
from geoloom.operators.grids import near_pixels
from geoloom.operators.osm import segments
from geoloom.operators.spatial import box_cells, crosses, points_in_polygons
from geoloom.session import stored

#: The smallest regions that are tried first, and the side of the cells that regions and boxes meet in (1e-7 degrees).
FIRST_REGIONS, REGION_E7 = 4_000, 25_000


def river_widths(points: DataFrame, stretches: DataFrame, widths: DataFrame, reach: float = 600.0, degrees: float = 40.0, least_m: float = 50.0) -> DataFrame:
    """Upper-middle width of the stretches along each line, if at least half of its 3 to 40 samples meet one."""
    count = F.when(F.col("total") >= least_m, F.least(F.greatest(F.floor(F.col("total") / 100), F.lit(3)), F.lit(40))).otherwise(0)
    samples = line_samples(points, "way_id", "seq", count, F.col("total") * (F.col("i") + 0.5) / F.col("n"))
    known = linear.measured(stretches.join(widths.select("seg_id").distinct(), "seg_id", "left_semi"), "seg_id", "seq")
    nearest = linear.nearest_segment(samples.drop("total"), ["way_id", "i"], known, reach, ("s_lat", "s_lon"), ["seg_id", "seq"], "s_bearing", degrees)
    taken = nearest.join(widths, "seg_id")
    whole = Window.partitionBy("way_id")
    ranked = taken.withColumns({"_r": F.row_number().over(whole.orderBy("width_m", "i")) - 1, "_c": F.count("*").over(whole)})
    return ranked.where("_c * 2 >= n and _r = cast(floor(_c / 2) as int)").select("way_id", F.col("width_m").alias("width"))


def overlap_share(cells: DataFrame, edges: DataFrame, body: str, survey: str, least: float = 0.5) -> DataFrame:
    """The survey that holds the largest share of a body's cells (body, cell, y, x), if over `least`."""
    inside = points_in_polygons(cells.withColumn("_p", F.struct(body, "cell")), edges, "_p", survey, ("y", "x"))
    n = cells.groupBy(body).agg(F.count("*").alias("n"))
    shares = inside.groupBy(F.col(f"_p.{body}").alias(body), survey).agg(F.count("*").alias("k")).join(n.hint("merge"), body).withColumn("share", F.col("k") / F.col("n"))
    best = Window.partitionBy(body).orderBy(F.col("share").desc(), survey)
    return shares.where(F.col("share") > least).withColumn("_n", F.row_number().over(best)).where("_n = 1").select(body, survey, "share")


def smallest_holding_all(probes: DataFrame, edges: DataFrame, areas: DataFrame, box: str, region: str) -> DataFrame:
    """The smallest region that holds every probe point (box, probe, y, x) of a box.

    Only regions whose box holds all probes meet it. Small regions are tried first: of n regions the FIRST_REGIONS
    smallest, then four times as many each round, and a box that has found one takes no part any more. So a box meets
    about as many regions in a crowd as where they are sparse. The even-odd rule is an exclusive or over a region's edges,
    a bit for each of up to 60 probes at a time.
    """
    at = F.collect_list(F.struct("y", "x"))
    spans = probes.where("y is not null and x is not null").dropDuplicates([box, "probe"]).groupBy(box).agg(at.alias("_at"), F.min("y").alias("_y0"), F.max("y").alias("_y1"), F.min("x").alias("_x0"), F.max("x").alias("_x1"))
    n = F.ceil(F.size("_at") / 60).cast("int")
    left = stored(spans.withColumns({"cell_lat": F.floor(F.col("_y0") / REGION_E7), "cell_lon": F.floor(F.col("_x0") / REGION_E7), "_parts": n}))
    boxes = edges.groupBy(region).agg(
        F.least(F.min("ay"), F.min("by")).alias("south_e7"), F.least(F.min("ax"), F.min("bx")).alias("west_e7"), F.greatest(F.max("ay"), F.max("by")).alias("north_e7"), F.greatest(F.max("ax"), F.max("bx")).alias("east_e7")
    )
    sized = stored(boxes.join(areas.select(region, "area").hint("merge"), region))
    count = sized.count()
    rounds = max(0, math.ceil(math.log(max(count, 1) / FIRST_REGIONS, 4)))
    limits = sized.agg(F.percentile_approx("area", [4.0 ** (k - rounds) for k in range(rounds)], 10_000).alias("p")).first().p if rounds else None
    parts, low = [], None
    for high in [*sorted(set(limits or [])), None]:
        some = sized
        if high is not None:
            some = some.where(F.col("area").isNull() | (F.col("area") <= high))
        if low is not None:
            some = some.where(F.col("area") > low)
        met = left.join(box_cells(some, REGION_E7).hint("merge"), ["cell_lat", "cell_lon"]).where("_y0 >= south_e7 and _y1 <= north_e7 and _x0 >= west_e7 and _x1 <= east_e7")
        met = met.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).select(box, region, "area", "_parts", "_part", F.slice("_at", F.col("_part") * 60 + 1, F.lit(60)).alias("_at"))
        hit = met.join(edges.select(region, "ay", "ax", "by", "bx").hint("merge"), region)
        over = F.aggregate(F.reverse("_at"), F.lit(0).cast("bigint"), lambda mask, p: mask * 2 + crosses(p["y"], p["x"], F.col("ay"), F.col("ax"), F.col("by"), F.col("bx")).cast("bigint"))
        inside = hit.groupBy(box, region, "_part").agg(F.bit_xor(over).alias("_in"), F.first("area").alias("area"), F.first("_parts").alias("_parts"), F.first(F.size("_at")).alias("_k"))
        whole = inside.where(F.col("_in") == F.expr("shiftleft(1L, _k) - 1")).groupBy(box, region).agg(F.count("*").alias("_c"), F.first("area").alias("area"), F.first("_parts").alias("_parts")).where("_c = _parts")
        best = whole.groupBy(box).agg(F.min_by(region, F.struct("area", region)).alias(region))
        if high is None:
            return reduce(DataFrame.union, [*parts, best])
        parts.append(stored(best))
        left = stored(left.join(parts[-1].select(box).hint("merge"), box, "left_anti").select(*left.columns))
        low = high


def densify(points: DataFrame, line: str, order: str, step_m: float) -> DataFrame:
    """Points every `step_m` metres along each segment, from its start, carrying the segment's order."""
    seg = segments(points, line, order)
    steps = F.greatest(F.ceil(F.col("metres") / step_m), F.lit(1)).cast("int")
    k = seg.withColumn("steps", steps).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("steps") - 1)))
    t = F.col("k") / F.col("steps")
    return k.select(line, order, "k", (F.col("lat_e7") + t * (F.col("lat2_e7") - F.col("lat_e7"))).alias("y"), (F.col("lon_e7") + t * (F.col("lon2_e7") - F.col("lon_e7"))).alias("x"))


def stretch_in_box(points: DataFrame, line: str, order: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """Metres along each line at which it first enters and last leaves a box (parametric clipping of every segment)."""
    seg = segments(points, line, order)
    y0, x0 = F.col("lat_e7").cast("double"), F.col("lon_e7").cast("double")
    dy, dx = F.col("lat2_e7") - y0, F.col("lon2_e7") - x0
    low, high = F.lit(0.0), F.lit(1.0)
    outside = F.lit(False)
    for start, delta, a, b in ((y0, dy, south, north), (x0, dx, west, east)):
        ta, tb = (a - start) / F.when(delta == 0, F.lit(1.0)).otherwise(delta), (b - start) / F.when(delta == 0, F.lit(1.0)).otherwise(delta)
        low = F.when(delta == 0, low).otherwise(F.greatest(low, F.least(ta, tb)))
        high = F.when(delta == 0, high).otherwise(F.least(high, F.greatest(ta, tb)))
        outside = outside | ((delta == 0) & ((start < a) | (start > b)))
    cut = seg.withColumns({"t0": low, "t1": high, "out": outside}).where("not out and t0 <= t1")
    return cut.groupBy(line).agg(F.min(F.col("before") + F.col("t0") * F.col("metres")).alias("enter"), F.max(F.col("before") + F.col("t1") * F.col("metres")).alias("leave"))


def side_by_side(points: DataFrame, layers: DataFrame, reach: float = 12.0, degrees: float = 25.842, step: float = 6.0) -> DataFrame:
    """Pairs of different ways of one layer that run side by side somewhere: samples every `step` metres, the first at 2 m or half way."""
    begin = F.least(F.lit(2.0), F.col("total") / 2)
    samples = line_samples(points, "way_id", "seq", F.floor((F.col("total") - begin) / step) + 1, begin + F.col("i") * step)
    of = lambda key: layers.where("layer is not null").select(F.col("way_id").alias(key), "layer").hint("merge")
    own = samples.select("way_id", "s_lat", "s_lon", "s_bearing").join(of("way_id"), "way_id")
    others = linear.measured(points.withColumnRenamed("way_id", "seg_id"), "seg_id", "seq").join(of("seg_id"), "seg_id")
    hits = linear.near_segments(own, others, reach, ("s_lat", "s_lon"), bearing_of="s_bearing", degrees=degrees, also=("layer",), keep=("way_id", "seg_id"))
    return hits.where("way_id <> seg_id").select("way_id", "seg_id").distinct()


def point_profile(points: DataFrame, layers: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """What is at each point: left joins of cell layers, each with the key columns and one value named like the layer."""
    out = points
    for name, layer in layers.items():
        out = out.join(layer.select(*keys, name), keys, "left")
    return out


def oriented_box(points: DataFrame, line: str = "way_id", order: str = "seq") -> DataFrame:
    """Box along the longest segment of each line: bearing (0 to 180), half length and half width in metres."""
    seg = segments(points, line, order)
    longest = seg.groupBy(line).agg(F.max_by(F.struct("dx", "dy"), F.struct(F.round("metres", 6), -F.col(order))).alias("d"), F.min_by("lat_e7", order).alias("lat0"), F.min_by("lon_e7", order).alias("lon0"))
    longest = longest.withColumn("a", F.atan2("d.dx", "d.dy"))
    scale = 111320.0
    p = points.join(longest, line)
    y, x = (F.col("lat_e7") - F.col("lat0")) / 1e7 * scale, (F.col("lon_e7") - F.col("lon0")) / 1e7 * scale * F.cos(F.radians(F.col("lat0") / 1e7))
    turned = p.withColumns({"u": x * F.sin("a") + y * F.cos("a"), "v": x * F.cos("a") - y * F.sin("a")})
    return turned.groupBy(line).agg(F.pmod(F.degrees(F.first("a")), F.lit(180.0)).alias("bearing"), ((F.max("u") - F.min("u")) / 2).alias("half_length"), ((F.max("v") - F.min("v")) / 2).alias("half_width"))


def best_entry(cells: DataFrame, roads: DataFrame, body: str, reach: int = 4) -> DataFrame:
    """The edge cell of each body that is nearest to a road within `reach` cells: `(body, x, z, d2)`; ties by place."""
    around = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in ((1, 0), (-1, 0), (0, 1), (0, -1))])
    next_to = cells.select(body, "x", "z", F.inline(around)).select(body, "x", "z", (F.col("x") + F.col("a")).alias("nx"), (F.col("z") + F.col("b")).alias("nz"))
    held = cells.select(body, F.col("x").alias("nx"), F.col("z").alias("nz"))
    edge = next_to.join(held.hint("merge"), [body, "nx", "nz"], "left_anti").select(body, "x", "z").distinct()
    met = near_pixels(edge.withColumns({"r": F.col("x"), "c": F.col("z")}), roads.select(F.col("x").alias("pr"), F.col("z").alias("pc")).distinct(), reach)
    scored = met.withColumn("d2", F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))
    return scored.groupBy(body).agg(F.min(F.struct("d2", "x", "z")).alias("best")).select(body, "best.x", "best.z", "best.d2")


def stacked_parts(bands: DataFrame, cell: str) -> DataFrame:
    """The parts (cell, id, bottom, top) that stay in each cell: the newest first, each unless it overlaps one that stays.

    So of a chain where the middle one is the newest, both ends go; where it is the oldest, both ends stay. The parts over
    one cell of a map are few; they are folded as one array.
    """
    newest = F.array_sort(F.collect_list(F.struct((-F.col("id")).alias("turn"), "id", "bottom", "top")))
    none = F.array().cast(f"array<struct<turn:bigint,id:bigint,bottom:{dict(bands.dtypes)['bottom']},top:{dict(bands.dtypes)['top']}>>")
    over = lambda kept, b: F.exists(kept, lambda k: (k["bottom"] < b["top"]) & (b["bottom"] < k["top"]))
    kept = F.aggregate("parts", none, lambda kept, b: F.when(over(kept, b), kept).otherwise(F.array_append(kept, b)))
    return bands.groupBy(cell).agg(newest.alias("parts")).select(cell, F.inline(kept)).select(cell, "id", "bottom", "top")
