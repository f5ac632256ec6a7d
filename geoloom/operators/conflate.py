"""Conflation of independent sources onto mapped features."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geoloom.functions.geometry import METRES_PER_DEGREE, box_distance_metres
from geoloom.operators import linear
from geoloom.operators.spatial import metres_e7, near_pairs, nearest, points_in_polygons, square_edges, turned, with_boxes_near

#: Side of the cells that footprints meet in (1e-7 degrees), about the size of a large one: 220 m.
FOOTPRINT_E7 = 20_000


def heights_by_id_or_place(buildings: DataFrame, points: DataFrame, reach: float = 20.0) -> DataFrame:
    """`(id, height, how)`: the point of the building's id, however far; else the nearest within `reach` metres."""
    buildings = buildings.select("id", "lat_e7", "lon_e7")
    named = points.where("osm_id <> 0").groupBy("osm_id").agg(F.min_by("height", "point_id").alias("height"))
    by_id = buildings.join(named, buildings["id"] == named["osm_id"]).select("id", "height", F.lit("id").alias("how"))
    rest = buildings.join(by_id.select("id"), "id", "left_anti")
    others = points.select("point_id", "height", F.col("lat_e7").alias("p_lat"), F.col("lon_e7").alias("p_lon"))
    pairs = near_pairs(rest, others, reach, ("lat_e7", "lon_e7"), ("p_lat", "p_lon"))
    far = metres_e7(F.col("lat_e7"), F.col("lon_e7"), F.col("p_lat"), F.col("p_lon"))
    close = nearest(pairs.withColumn("d", far).where(F.col("d") < reach), "id", "d", "point_id")
    return by_id.union(close.select("id", "height", F.lit("near").alias("how")))


def tallest_inside(buildings: DataFrame, points: DataFrame) -> DataFrame:
    """`(id, height)`: the tallest point inside each footprint."""
    inside = points_in_polygons(points, square_edges(buildings, "id"), "point_id", "id", ("lat_e7", "lon_e7"))
    return inside.join(points.select("point_id", "height"), "point_id").groupBy("id").agg(F.max("height").alias("height"))


def _names(stem: str) -> tuple[str, str, str, str]:
    return f"{stem}_south", f"{stem}_west", f"{stem}_north", f"{stem}_east"


def _corners(lat: str, lon: str, stem: str) -> list[F.Column]:
    """South, west, north and east of footprints given by centre and half sides, named by `stem`."""
    return [(F.col(c) + s * F.col(h)).alias(n) for (c, h, s), n in zip(((lat, "half_lat", -1), (lon, "half_lon", -1), (lat, "half_lat", 1), (lon, "half_lon", 1)), _names(stem), strict=True)]


def registry_match(buildings: DataFrame, registry: DataFrame, reach: float = 8.0) -> DataFrame:
    """`(id, reg_id, source_order)`: by source in order, the registry building that holds the centre, else the nearest box."""
    own = buildings.select("id", "lat_e7", "lon_e7")
    boxes = registry.select("reg_id", "source_order", *_corners("lat_e7", "lon_e7", "r"))
    pairs = with_boxes_near(own, boxes, reach, ("lat_e7", "lon_e7", "lat_e7", "lon_e7"), _names("r"), FOOTPRINT_E7)
    d = box_distance_metres(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, *[F.col(c) / 1e7 for c in _names("r")])
    good = pairs.withColumn("d", d).where(F.col("d") < reach)
    best = Window.partitionBy("id").orderBy("source_order", F.round("d", 6), "reg_id")
    return good.withColumn("_n", F.row_number().over(best)).where("_n = 1").select("id", "reg_id", "source_order")


def resolved_heights(buildings: DataFrame, registry: DataFrame, matches: DataFrame, atlas: DataFrame, storey: float = 3.0, surface: DataFrame | None = None) -> DataFrame:
    """`(id, height, height_source)` by the cascade tag, levels, surface (id, height), registry (floors without a height), atlas, default."""
    of_registry = matches.join(registry.select("reg_id", F.col("height").alias("r_height"), "floors"), "reg_id").select("id", F.coalesce("r_height", F.when(F.col("floors") > 0, F.col("floors") * storey)).alias("r"))
    tag = F.expr("try_cast(regexp_extract(height, '(-?[0-9]+(?:\\\\.[0-9]+)?)', 1) AS double)")
    levels = F.expr("try_cast(levels AS double)") * storey
    default = F.when(F.col("building") == "church", 12.0).when(F.col("building") == "garage", 3.0).when(F.col("building") == "apartments", 12.0).otherwise(6.0)
    all_of = buildings.join(of_registry, "id", "left").join(atlas.select("id", F.col("height").alias("a")), "id", "left")
    accept = lambda c: F.when(c >= 2, c)
    measured = []
    if surface is not None:
        all_of = all_of.join(surface.select("id", F.col("height").alias("_surface")), "id", "left")
        measured = [("surface", accept(F.col("_surface")))]
    chain = [("tag", accept(tag)), ("levels", accept(levels)), *measured, ("registry", accept(F.col("r"))), ("atlas", accept(F.col("a"))), ("default", default)]
    return all_of.select("id", F.coalesce(*[c for _, c in chain]).alias("height"), F.coalesce(*[F.when(c.isNotNull(), F.lit(n)) for n, c in chain]).alias("height_source"))


def missing_buildings(buildings: DataFrame, others: DataFrame, pad: float = 2.0) -> DataFrame:
    """Footprints of another source, above ground and not of the mapped origin, that come within `pad` metres of no mapped one.

    Footprints are axis-parallel boxes here, so the exact test is the gap between boxes.
    """
    wanted = others.where("not is_underground and geometry_source <> 'OpenStreetMap'")
    mapped = buildings.select(F.col("lat_e7").alias("m_lat"), F.col("lon_e7").alias("m_lon"), F.col("half_lat").alias("m_hy"), F.col("half_lon").alias("m_hx"), *_corners("lat_e7", "lon_e7", "m"))
    pairs = with_boxes_near(wanted.select("*", *_corners("lat_e7", "lon_e7", "o")), mapped, pad, _names("o"), _names("m"), FOOTPRINT_E7)
    gap_y = F.greatest(F.abs(F.col("lat_e7") - F.col("m_lat")) - F.col("half_lat") - F.col("m_hy"), F.lit(0)) / 1e7 * METRES_PER_DEGREE
    gap_x = F.greatest(F.abs(turned(F.col("lon_e7") - F.col("m_lon"))) - F.col("half_lon") - F.col("m_hx"), F.lit(0)) / 1e7 * METRES_PER_DEGREE * F.cos(F.radians(F.col("lat_e7") / 1e7))
    touched = pairs.where(F.sqrt(gap_y * gap_y + gap_x * gap_x) <= pad).select("other_id").distinct()
    return wanted.join(touched, "other_id", "left_anti")


def name_key(name: F.Column) -> F.Column:
    """Lower case; other than letters and digits is one blank."""
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def merge_places(places: DataFrame, features: DataFrame, reach: float = 60.0) -> DataFrame:
    """Places that no feature of the same name key lies within `reach` metres of; places without a key always stay."""
    keyed = places.withColumn("_k", name_key(F.col("name")))
    held = features.select(name_key(F.col("name")).alias("_k"), F.col("lat_e7").alias("f_lat"), F.col("lon_e7").alias("f_lon"))
    met = keyed.where("_k <> ''").join(held, "_k").where(metres_e7(F.col("lat_e7"), F.col("lon_e7"), F.col("f_lat"), F.col("f_lon")) <= reach)
    return keyed.join(met.select("place_id").distinct(), "place_id", "left_anti").drop("_k")


def line_samples(points: DataFrame, line: str, order: str, count: F.Column, place: F.Column) -> DataFrame:
    """Sample points of each line: `(line, i, n, total, s_lat, s_lon, s_bearing)`.

    `count` is a column of the line's metres `total`; `place` one of `i`, `n` and `total` that gives metres along it.
    """
    lines = linear.measured(points, line, order)
    totals = lines.where("last").select(line, "total")
    wanted = totals.withColumn("n", count.cast("int")).where("n > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("at", place)
    return linear.points_at(lines, wanted, line).select(line, "i", "n", "total", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), F.pmod("bearing", F.lit(180.0)).alias("s_bearing"))


def sample_hits(samples: DataFrame, lines: DataFrame, reach: float, degrees: float) -> DataFrame:
    """`(way_id, i, n, seg_id, seq, d)`: each sample with every segment of `lines` (seg_id, seq, lat_e7, lon_e7) within `reach` metres and `degrees`, once."""
    hits = linear.near_segments(samples, linear.measured(lines, "seg_id", "seq"), reach, ("s_lat", "s_lon"), bearing_of="s_bearing", degrees=degrees, keep=("way_id", "i", "n", "seg_id", "seq"))
    return hits.drop("t", "along")


def road_attributes(points: DataFrame, surveyed: DataFrame, attributes: DataFrame, reach: float = 7.0, degrees: float = 35.0) -> DataFrame:
    """Width, lanes and both-ways of each way from the surveyed segments along it.

    One, three or five samples; width and lanes each take their own nearest segment. Width: the upper middle of at least
    two (of one if there is one sample); lanes: the most common, the least of ties; both-ways: any.
    """
    count = F.when(F.col("total") < 12, 1).when(F.col("total") < 60, 3).otherwise(5)
    samples = line_samples(points, "way_id", "seq", count, F.col("total") * (F.col("i") + 1) / (F.col("n") + 1))
    hits = sample_hits(samples, surveyed, reach, degrees).join(attributes.hint("merge"), "seg_id")
    # Hits are read once: a sample takes its own nearest, a way has five samples at most.
    nearest = lambda value, good: F.min(F.when(good, F.struct(F.round("d", 6).alias("d"), "seg_id", "seq", F.col(value).alias("v"))))["v"].alias(value)
    of_sample = hits.groupBy("way_id", "i", "n").agg(nearest("width_m", F.col("width_m").isNotNull()), nearest("lanes", F.col("lanes") > 0), F.bool_or("both_ways").alias("both_ways"))
    of_way = of_sample.groupBy("way_id").agg(F.max("n").alias("n"), F.array_sort(F.collect_list("width_m")).alias("widths"), F.collect_list("lanes").alias("votes"), F.bool_or("both_ways").alias("both_ways"))
    count = F.size("widths")
    width = F.when((count >= 2) | (F.col("n") == 1), F.get("widths", F.floor(count / 2).cast("int")))
    most = F.array_max(F.transform(F.array_distinct("votes"), lambda v: F.struct(F.size(F.filter("votes", lambda x: x == v)).alias("c"), F.negate(v).alias("v"))))
    return of_way.select("way_id", width.alias("width"), F.negate(most["v"]).alias("lanes"), "both_ways")
