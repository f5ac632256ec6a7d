"""Queries that conflate sources by id, place, direction and name."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import conflate, roofs
from geoloom.operators.spatial import points_in_polygons, square_edges
from geoloom.plans.elements import SEGMENTS
from geoloom.plans.measured import samples_sql
from geoloom.plans.register import query

_FAR = "sqrt(((p.lon_e7 - b.lon_e7) / 1e7 * 111320.0 * cos(radians(b.lat_e7 / 1e7))) ** 2 + ((p.lat_e7 - b.lat_e7) / 1e7 * 111320.0) ** 2)"
_ATLAS = f"""named AS (SELECT osm_id AS id, min_by(height, point_id) AS height FROM {{height_points}} WHERE osm_id <> 0 GROUP BY 1),
    byid AS (SELECT b.id, n.height, 'id' AS how FROM {{buildings}} b JOIN named n ON b.id = n.id),
    near AS (SELECT b.id, p.height, 'near' AS how FROM {{buildings}} b JOIN {{height_points}} p ON {_FAR} < 20 WHERE b.id NOT IN (SELECT id FROM byid) QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY round({_FAR}, 6), point_id) = 1),
    atlas AS (SELECT * FROM byid UNION ALL SELECT * FROM near)"""
_BOX = "sqrt((greatest((r.lon_e7 - r.half_lon - b.lon_e7) / 1e7, (b.lon_e7 - r.lon_e7 - r.half_lon) / 1e7, 0) * 111320.0 * cos(radians(b.lat_e7 / 1e7))) ** 2 + (greatest((r.lat_e7 - r.half_lat - b.lat_e7) / 1e7, (b.lat_e7 - r.lat_e7 - r.half_lat) / 1e7, 0) * 111320.0) ** 2)"
_REG = f"reg AS (SELECT b.id, r.reg_id, r.source_order FROM {{buildings}} b JOIN {{registry}} r ON {_BOX} < 8 QUALIFY row_number() OVER (PARTITION BY b.id ORDER BY source_order, round({_BOX}, 6), reg_id) = 1)"


@query("jn06_heights_by_id_or_place", f"WITH {_ATLAS} SELECT * FROM atlas")
def heights(read):
    """JN-06: the point of the id, else the nearest within 20 m."""
    return conflate.heights_by_id_or_place(read("buildings"), read("height_points"))


@query("jn07_tallest_point_inside", "SELECT b.id, max(p.height) AS height FROM {buildings} b JOIN {height_points} p ON p.lat_e7 >= b.lat_e7 - half_lat AND p.lat_e7 < b.lat_e7 + half_lat AND p.lon_e7 >= b.lon_e7 - half_lon AND p.lon_e7 < b.lon_e7 + half_lon GROUP BY b.id")
def tallest(read):
    """JN-07, SC-20: points in polygons by cell, box and even-odd rule."""
    return conflate.tallest_inside(read("buildings"), read("height_points"))


@query("jn08_registry_match", f"WITH {_REG} SELECT * FROM reg")
def registry(read):
    """JN-08: the registry building at the centre, or the nearest box within 8 m; the first source wins."""
    return conflate.registry_match(read("buildings"), read("registry"))


@query(
    "jn09_height_cascade",
    f"""WITH {_ATLAS}, {_REG}, c AS (SELECT b.id, building, try_cast(regexp_extract(b.height, '(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS tag, CAST(levels AS DOUBLE) * 3 AS lev, coalesce(r.height, CASE WHEN floors > 0 THEN floors * 3.0 END) AS rh, a.height AS atl
      FROM {{buildings}} b LEFT JOIN reg USING (id) LEFT JOIN {{registry}} r USING (reg_id) LEFT JOIN atlas a ON a.id = b.id)
    SELECT id, CASE WHEN tag >= 2 THEN tag WHEN lev >= 2 THEN lev WHEN rh >= 2 THEN rh WHEN atl >= 2 THEN atl WHEN building IN ('church', 'apartments') THEN 12.0 WHEN building = 'garage' THEN 3.0 ELSE 6.0 END AS height,
      CASE WHEN tag >= 2 THEN 'tag' WHEN lev >= 2 THEN 'levels' WHEN rh >= 2 THEN 'registry' WHEN atl >= 2 THEN 'atlas' ELSE 'default' END AS height_source FROM c""",
)
def cascade(read):
    """JN-09: height with provenance from tag, levels, registry, atlas or default."""
    b = read("buildings")
    return conflate.resolved_heights(b, read("registry"), conflate.registry_match(b, read("registry")), conflate.heights_by_id_or_place(b, read("height_points")))


@query(
    "jn09_cascade_with_surface",
    f"""WITH {_ATLAS}, {_REG}, {samples_sql(5, 5, 0.7)}, o AS (SELECT id, list(v ORDER BY v) AS o FROM n GROUP BY 1), sf AS (SELECT id, o[CAST(least(floor(len(o) * 0.8), len(o) - 1) AS INTEGER) + 1] AS sh FROM o WHERE len(o) >= 3),
    c AS (SELECT b.id, building, try_cast(regexp_extract(b.height, '(-?[0-9]+(\\.[0-9]+)?)', 1) AS DOUBLE) AS tag, CAST(levels AS DOUBLE) * 3 AS lev, sh, coalesce(r.height, CASE WHEN floors > 0 THEN floors * 3.0 END) AS rh, a.height AS atl
      FROM {{buildings}} b LEFT JOIN reg USING (id) LEFT JOIN {{registry}} r USING (reg_id) LEFT JOIN atlas a ON a.id = b.id LEFT JOIN sf ON sf.id = b.id)
    SELECT id, round(CASE WHEN tag >= 2 THEN tag WHEN lev >= 2 THEN lev WHEN sh >= 2 THEN sh WHEN rh >= 2 THEN rh WHEN atl >= 2 THEN atl WHEN building IN ('church', 'apartments') THEN 12.0 WHEN building = 'garage' THEN 3.0 ELSE 6.0 END, 4) AS height,
      CASE WHEN tag >= 2 THEN 'tag' WHEN lev >= 2 THEN 'levels' WHEN sh >= 2 THEN 'surface' WHEN rh >= 2 THEN 'registry' WHEN atl >= 2 THEN 'atlas' ELSE 'default' END AS height_source FROM c""",
)
def cascade_with_surface(read):
    """JN-09 on AG-08: the surface model comes after the building's own tags."""
    b = read("buildings")
    surface = roofs.surface_heights(read("axis_buildings"), read("surface"))
    got = conflate.resolved_heights(b, read("registry"), conflate.registry_match(b, read("registry")), conflate.heights_by_id_or_place(b, read("height_points")), surface=surface)
    return got.withColumn("height", F.round("height", 4))


@query(
    "jn10_gap_fill_buildings",
    """SELECT other_id, lat_e7, lon_e7 FROM {other_buildings} o WHERE NOT is_underground AND geometry_source <> 'OpenStreetMap' AND NOT EXISTS (SELECT 1 FROM {buildings} b
      WHERE sqrt((greatest(abs(o.lon_e7 - b.lon_e7) - o.half_lon - b.half_lon, 0) / 1e7 * 111320.0 * cos(radians(o.lat_e7 / 1e7))) ** 2 + (greatest(abs(o.lat_e7 - b.lat_e7) - o.half_lat - b.half_lat, 0) / 1e7 * 111320.0) ** 2) <= 2)""",
)
def gap_fill(read):
    """JN-10: footprints of another source that touch no mapped building."""
    return conflate.missing_buildings(read("buildings"), read("other_buildings")).select("other_id", "lat_e7", "lon_e7")


@query(
    "jn11_merge_places",
    r"""WITH k AS (SELECT *, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM {places}), f AS (SELECT *, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS k FROM {named_features})
    SELECT place_id, name FROM k WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.k = k.k AND sqrt(((f.lon_e7 - k.lon_e7) / 1e7 * 111320.0 * cos(radians(k.lat_e7 / 1e7))) ** 2 + ((f.lat_e7 - k.lat_e7) / 1e7 * 111320.0) ** 2) <= 60)""",
)
def places(read):
    """JN-11, SC-30: places without a same-name feature within 60 m."""
    return conflate.merge_places(read("places"), read("named_features")).select("place_id", "name")


_SAMPLES = f"""{SEGMENTS}, pre AS (SELECT *, coalesce(sum(metres) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, (lon2 - lon_e7) / 1e7 * 111320.0 * cos(radians(lat_e7 / 1e7)) AS dx, (lat2 - lat_e7) / 1e7 * 111320.0 AS dy FROM m),
    tot AS (SELECT way_id, sum(metres) AS total FROM m GROUP BY way_id), cnt AS (SELECT *, CASE WHEN total < 12 THEN 1 WHEN total < 60 THEN 3 ELSE 5 END AS n FROM tot),
    pos AS (SELECT *, total * (i + 1) / (n + 1) AS along FROM cnt, range(5) r(i) WHERE i < n),
    smp AS (SELECT p.way_id, i, n, lat_e7 + (along - before) / metres * (lat2 - lat_e7) AS s_lat, lon_e7 + (along - before) / metres * (lon2 - lon_e7) AS s_lon, (degrees(atan2(dx, dy)) + 360) % 180 AS brg FROM pos p JOIN pre s ON p.way_id = s.way_id AND along >= before AND along < before + metres)"""


@query(
    "jn12_road_attributes",
    f"""WITH {_SAMPLES},
    rs AS (SELECT *, lead(lat_e7) OVER w AS lat2, lead(lon_e7) OVER w AS lon2 FROM {{road_segments}} WINDOW w AS (PARTITION BY seg_id ORDER BY seq)),
    rg AS (SELECT *, (lon2 - lon_e7) / 1e7 * 111320.0 * cos(radians(lat_e7 / 1e7)) AS dx, (lat2 - lat_e7) / 1e7 * 111320.0 AS dy FROM rs WHERE lat2 IS NOT NULL),
    c AS (SELECT s.way_id, s.i, s.n, s.brg, r.*, (s_lon - lon_e7) / 1e7 * 111320.0 * cos(radians(lat_e7 / 1e7)) AS px, (s_lat - lat_e7) / 1e7 * 111320.0 AS py FROM smp s JOIN rg r ON abs(s_lat - lat_e7) < 60000 AND abs(s_lon - lon_e7) < 120000),
    t AS (SELECT *, CASE WHEN dx * dx + dy * dy = 0 THEN 0 ELSE least(greatest((px * dx + py * dy) / (dx * dx + dy * dy), 0), 1) END AS t FROM c),
    h AS (SELECT *, sqrt((px - t * dx) ** 2 + (py - t * dy) ** 2) AS d, abs(brg - (degrees(atan2(dx, dy)) + 360) % 180) AS a FROM t),
    hit AS (SELECT * FROM h WHERE d <= 7 AND least(a, 180 - a) <= 35),
    w1 AS (SELECT * FROM hit WHERE width_m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY way_id, i ORDER BY round(d, 6), seg_id, seq) = 1),
    w2 AS (SELECT *, row_number() OVER (PARTITION BY way_id ORDER BY width_m, i) - 1 AS r, count(*) OVER (PARTITION BY way_id) AS c FROM w1),
    w3 AS (SELECT way_id, width_m AS width FROM w2 WHERE (c >= 2 OR n = 1) AND r = CAST(floor(c / 2.0) AS INTEGER)),
    l1 AS (SELECT * FROM hit WHERE lanes > 0 QUALIFY row_number() OVER (PARTITION BY way_id, i ORDER BY round(d, 6), seg_id, seq) = 1),
    l2 AS (SELECT way_id, lanes FROM l1 GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY way_id ORDER BY count(*) DESC, lanes) = 1)
    SELECT way_id, width, lanes, both_ways FROM (SELECT way_id, bool_or(both_ways) AS both_ways FROM hit GROUP BY 1) LEFT JOIN w3 USING (way_id) LEFT JOIN l2 USING (way_id)""",
)
def roads(read):
    """JN-12, SC-19, SC-21: surveyed width, lanes and direction of each way by samples along it."""
    surveyed = read("road_segments")
    return conflate.road_attributes(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7"), surveyed.select("seg_id", "seq", "lat_e7", "lon_e7"), surveyed.select("seg_id", "width_m", "lanes", "both_ways").distinct())


@query("jn13_one_way_half", "SELECT seg_id, CASE WHEN both_ways AND seg_id % 3 = 0 THEN width_m / 2 ELSE width_m END AS width, CASE WHEN both_ways AND seg_id % 3 = 0 AND lanes > 1 THEN CAST(floor(lanes / 2.0) AS INTEGER) ELSE lanes END AS lanes FROM (SELECT DISTINCT seg_id, width_m, lanes, both_ways FROM {road_segments})")
def one_way_half(read):
    """JN-13: a one-way way takes half of what a database of both directions says."""
    own = read("road_segments").select("seg_id", "width_m", "lanes", "both_ways").distinct()
    half = F.col("both_ways") & (F.col("seg_id") % 3 == 0)
    return own.select("seg_id", F.when(half, F.col("width_m") / 2).otherwise(F.col("width_m")).alias("width"), F.when(half & (F.col("lanes") > 1), F.floor(F.col("lanes") / 2).cast("int")).otherwise(F.col("lanes")).alias("lanes"))


@query("jn16_part_in_smallest_outline", """SELECT place_id, min_by(id, (CAST(half_lat AS DOUBLE) * half_lon, id)) AS outline FROM (SELECT p.place_id, b.* FROM {places} p JOIN {buildings} b ON p.lat_e7 >= b.lat_e7 - half_lat AND p.lat_e7 < b.lat_e7 + half_lat AND p.lon_e7 >= b.lon_e7 - half_lon AND p.lon_e7 < b.lon_e7 + half_lon) GROUP BY place_id""")
def part_outline(read):
    """JN-16, JN-17: the smallest outline that holds a point."""
    inside = points_in_polygons(read("places"), square_edges(read("buildings"), "id"), "place_id", "id", ("lat_e7", "lon_e7"))
    sized = inside.join(read("buildings").select("id", (F.col("half_lat").cast("double") * F.col("half_lon")).alias("a")).hint("merge"), "id")
    return sized.groupBy("place_id").agg(F.min_by("id", F.struct("a", "id")).alias("outline"))


@query("jn20_lake_depths", "SELECT lake_id, dmax_m FROM {lakes} JOIN {lake_outlets} ON lake_id = outlet_id WHERE dmax_m > 0")
def lake_depths(read):
    """JN-20, SRC-09: outlets with a depth above zero."""
    return read("lakes").join(read("lake_outlets"), F.col("lake_id") == F.col("outlet_id")).where("dmax_m > 0").select("lake_id", "dmax_m")


@query(
    "jn21_lake_outlet_score",
    """WITH l AS (SELECT *, (half_lat * 2 / 90.0) * (half_lon * 2 / 180.0) / 1e6 AS own FROM {lakes}),
    c AS (SELECT l.lake_id, o.outlet_id, o.area_km2 / own AS ratio, own, sqrt((greatest((l.lon_e7 - half_lon - o.lon_e7) / 1e7, (o.lon_e7 - l.lon_e7 - half_lon) / 1e7, 0) * 111320.0 * cos(radians(o.lat_e7 / 1e7))) ** 2 + (greatest((l.lat_e7 - half_lat - o.lat_e7) / 1e7, (o.lat_e7 - l.lat_e7 - half_lat) / 1e7, 0) * 111320.0) ** 2) AS far
      FROM l JOIN {lake_outlets} o ON abs(l.lat_e7 - o.lat_e7) < 500000 AND abs(l.lon_e7 - o.lon_e7) < 500000)
    SELECT lake_id, outlet_id, round(abs(ln(ratio)) + far / 500, 4) AS score FROM c WHERE ratio BETWEEN 1.0 / 3 AND 3 AND far <= greatest(150, 0.05 * sqrt(own * 1e6))
    QUALIFY row_number() OVER (PARTITION BY lake_id ORDER BY round(abs(ln(ratio)) + far / 500, 6), outlet_id) = 1""",
)
def lake_outlet(read):
    """JN-21: the outlet that fits a lake best by area ratio and distance."""
    from geoloom.functions.geometry import box_distance_metres
    from geoloom.operators.spatial import nearest, with_boxes_near

    own = (F.col("half_lat") * 2 / 90.0) * (F.col("half_lon") * 2 / 180.0) / 1e6
    lakes = read("lakes").withColumn("own", own)
    outlets = read("lake_outlets").select("outlet_id", F.col("lat_e7").alias("o_lat"), F.col("lon_e7").alias("o_lon"), "area_km2")
    boxed = lakes.select("*", *[(F.col(c) + s * F.col(h)).alias(n) for n, c, h, s in (("south", "lat_e7", "half_lat", -1), ("west", "lon_e7", "half_lon", -1), ("north", "lat_e7", "half_lat", 1), ("east", "lon_e7", "half_lon", 1))])
    reach = F.greatest(F.lit(150.0), 0.05 * F.sqrt(F.col("own") * 1e6))
    pairs = with_boxes_near(outlets, boxed, reach, ("o_lat", "o_lon", "o_lat", "o_lon"), ("south", "west", "north", "east")).drop("south", "west", "north", "east")
    side = lambda c, h, s: (F.col(c) + s * F.col(h)) / 1e7
    far = box_distance_metres(F.col("o_lat") / 1e7, F.col("o_lon") / 1e7, side("lat_e7", "half_lat", -1), side("lon_e7", "half_lon", -1), side("lat_e7", "half_lat", 1), side("lon_e7", "half_lon", 1))
    scored = pairs.withColumns({"ratio": F.col("area_km2") / F.col("own"), "far": far})
    good = scored.where((F.col("ratio") >= 1 / 3) & (F.col("ratio") <= 3) & (F.col("far") <= F.greatest(F.lit(150.0), 0.05 * F.sqrt(F.col("own") * 1e6))))
    good = good.where((F.abs(F.col("lat_e7") - F.col("o_lat")) < 500000) & (F.abs(F.col("lon_e7") - F.col("o_lon")) < 500000))
    best = nearest(good.withColumn("score", F.abs(F.log("ratio")) + F.col("far") / 500), "lake_id", "score", "outlet_id")
    return best.select("lake_id", "outlet_id", F.round("score", 4).alias("score"))


@query("ag05_survey_rollup", """WITH r AS (SELECT survey_id, max(thickness) AS deepest, min_by(reading_id, (-thickness, reading_id)) AS deepest_at, count(*) AS n FROM {readings} WHERE thickness > 0 GROUP BY 1)
    SELECT survey_id, greatest(stated_max, deepest) AS max_m, deepest_at, coalesce(n, 0) AS readings FROM {surveys} LEFT JOIN r USING (survey_id) WHERE flag IS NULL AND greatest(coalesce(stated_max, 0), coalesce(deepest, 0)) > 0""")
def survey_rollup(read):
    """AG-05, FL-07, SRC-08: the deepest reading of each survey that isn't flagged."""
    r = read("readings").where("thickness > 0").groupBy("survey_id").agg(F.max("thickness").alias("deepest"), F.min_by("reading_id", F.struct(-F.col("thickness"), F.col("reading_id"))).alias("deepest_at"), F.count("*").alias("n"))
    s = read("surveys").where("flag is null").join(r, "survey_id", "left").where("greatest(coalesce(stated_max, 0), coalesce(deepest, 0)) > 0")
    return s.select("survey_id", F.greatest("stated_max", "deepest").cast("double").alias("max_m"), "deepest_at", F.coalesce("n", F.lit(0)).alias("readings"))


@query("ag06_road_records", "SELECT link, sum(lanes) AS lanes, max(width) AS width, min(part) AS first_part FROM {road_records} GROUP BY link")
def road_records(read):
    """AG-06: lanes summed and width maximal per link."""
    return read("road_records").groupBy("link").agg(F.sum("lanes").alias("lanes"), F.max("width").alias("width"), F.min("part").alias("first_part"))


@query("fl09_thin_coverage", """WITH c AS (SELECT *, CAST(floor(lat_e7 / 500000.0) AS BIGINT) AS y, CAST(floor(lon_e7 / 500000.0) AS BIGINT) AS x FROM {other_buildings} WHERE NOT is_underground)
    SELECT y, x, count(*) AS n, sum(CASE WHEN geometry_source <> 'OpenStreetMap' THEN 1 ELSE 0 END) AS others FROM c GROUP BY 1, 2 HAVING sum(CASE WHEN geometry_source <> 'OpenStreetMap' THEN 1 ELSE 0 END) >= 0.15 * count(*)""")
def thin_coverage(read):
    """FL-09: tiles where another source gives at least 15 % of the buildings."""
    c = read("other_buildings").where("not is_underground").groupBy(F.floor(F.col("lat_e7") / 500000).alias("y"), F.floor(F.col("lon_e7") / 500000).alias("x"))
    return c.agg(F.count("*").alias("n"), F.sum((F.col("geometry_source") != "OpenStreetMap").cast("int")).alias("others")).where("others >= 0.15 * n")


@query("jn45_suppressed_by_landmark", """SELECT id FROM {buildings} b WHERE NOT EXISTS (SELECT 1 FROM {places} p WHERE p.category = 'museum' AND sqrt(((p.lon_e7 - b.lon_e7) / 1e7 * 111320.0 * cos(radians(b.lat_e7 / 1e7))) ** 2 + ((p.lat_e7 - b.lat_e7) / 1e7 * 111320.0) ** 2) <= 400)""")
def suppressed(read):
    """JN-45: features outside the radius of every landmark."""
    from geoloom.operators.spatial import metres_e7, near_pairs

    marks = read("places").where("category = 'museum'").select(F.col("lat_e7").alias("m_lat"), F.col("lon_e7").alias("m_lon"))
    pairs = near_pairs(read("buildings").select("id", "lat_e7", "lon_e7"), marks, 400.0, ("lat_e7", "lon_e7"), ("m_lat", "m_lon"))
    near = pairs.where(metres_e7(F.col("lat_e7"), F.col("lon_e7"), F.col("m_lat"), F.col("m_lon")) <= 400).select("id").distinct()
    return read("buildings").select("id").join(near, "id", "left_anti")
