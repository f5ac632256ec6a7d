"""Queries over areas, regions, profiles of points and files."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import areas, regions
from geoloom.operators.spatial import points_in_polygons, square_edges
from geoloom.plans.elements import SEGMENTS
from geoloom.plans.register import query

_IN = "p.lat_e7 >= b.lat_e7 - b.half_lat AND p.lat_e7 < b.lat_e7 + b.half_lat AND p.lon_e7 >= b.lon_e7 - b.half_lon AND p.lon_e7 < b.lon_e7 + b.half_lon"
_PRE = f"{SEGMENTS}, pre AS (SELECT *, coalesce(sum(metres) OVER (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM m)"


@query("jn14_river_widths")
def rivers(read):
    """JN-14: width of the surveyed stretches along each line, by samples."""
    s = read("road_segments")
    return regions.river_widths(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7"), s.select("seg_id", "seq", "lat_e7", "lon_e7"), s.where("width_m is not null").select("seg_id", "width_m").distinct())


@query("jn19_soundings_in_lakes", f"SELECT lake_id, count(*) AS n, max(p.height) AS deepest FROM {{lakes}} b JOIN {{height_points}} p ON {_IN} GROUP BY lake_id HAVING count(*) >= 8 AND max(p.height) > 0.5")
def soundings(read):
    """JN-19, JN-22: points inside each body, enough of them, one deep enough."""
    inside = points_in_polygons(read("height_points"), square_edges(read("lakes"), "lake_id"), "point_id", "lake_id", ("lat_e7", "lon_e7"))
    return inside.join(read("height_points").select("point_id", "height"), "point_id").groupBy("lake_id").agg(F.count("*").alias("n"), F.max("height").alias("deepest")).where("n >= 8 and deepest > 0.5")


_CELLS = "SELECT b.lake_id, i * 10 + j AS cell, lat_e7 - half_lat + (2 * i + 1) * half_lat / 10.0 AS y, lon_e7 - half_lon + (2 * j + 1) * half_lon / 10.0 AS x FROM {lakes} b, range(10) p(i), range(10) q(j)"


def _lake_cells(read):
    grid = read("lakes").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(9)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(9))))
    return grid.select("lake_id", (F.col("i") * 10 + F.col("j")).alias("cell"), (F.col("lat_e7") - F.col("half_lat") + (2 * F.col("i") + 1) * F.col("half_lat") / 10.0).alias("y"), (F.col("lon_e7") - F.col("half_lon") + (2 * F.col("j") + 1) * F.col("half_lon") / 10.0).alias("x"))


@query("jn18_lake_overlap_share", f"""WITH c AS ({_CELLS}), s AS (SELECT lake_id AS survey_id, lat_e7 + lake_id % 5 * 3000 AS lat_e7, lon_e7, half_lat, half_lon FROM {{lakes}}), k AS (SELECT c.lake_id, s.survey_id, count(*) / 100.0 AS share FROM c JOIN s ON y >= s.lat_e7 - half_lat AND y < s.lat_e7 + half_lat AND x >= s.lon_e7 - half_lon AND x < s.lon_e7 + half_lon GROUP BY 1, 2)
    SELECT lake_id, survey_id, CAST(share AS DOUBLE) AS share FROM k WHERE share > 0.5 QUALIFY row_number() OVER (PARTITION BY lake_id ORDER BY share DESC, survey_id) = 1""")
def overlap(read):
    """JN-18: the survey that holds the largest share of a lake."""
    moved = read("lakes").select(F.col("lake_id").alias("survey_id"), (F.col("lat_e7") + F.col("lake_id") % 5 * 3000).alias("lat_e7"), "lon_e7", "half_lat", "half_lon")
    return regions.overlap_share(_lake_cells(read), square_edges(moved, "survey_id"), "lake_id", "survey_id")


@query("jn23_smallest_region", """WITH r AS (SELECT id AS region, lat_e7, lon_e7, half_lat * 8 AS half_lat, half_lon * 8 AS half_lon FROM {buildings}), p AS (SELECT place_id, i * 3 + j AS probe, lat_e7 + (i - 1) * 2000 AS y, lon_e7 + (j - 1) * 2000 AS x FROM {places}, range(3) a(i), range(3) b(j)),
    h AS (SELECT place_id, region, any_value(CAST(half_lat AS DOUBLE) * half_lon) AS area FROM p JOIN r ON y >= r.lat_e7 - half_lat AND y < r.lat_e7 + half_lat AND x >= r.lon_e7 - half_lon AND x < r.lon_e7 + half_lon GROUP BY 1, 2 HAVING count(DISTINCT probe) = 9)
    SELECT place_id, min_by(region, (area, region)) AS region FROM h GROUP BY place_id""")
def smallest_region(read):
    """JN-23: the smallest region that holds all nine probes of a box."""
    r = read("buildings").select(F.col("id").alias("region"), "lat_e7", "lon_e7", (F.col("half_lat") * 8).alias("half_lat"), (F.col("half_lon") * 8).alias("half_lon"))
    nine = read("places").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(2))))
    probes = nine.select("place_id", (F.col("i") * 3 + F.col("j")).alias("probe"), (F.col("lat_e7") + (F.col("i") - 1) * 2000).alias("y"), (F.col("lon_e7") + (F.col("j") - 1) * 2000).alias("x"))
    return regions.smallest_holding_all(probes, square_edges(r, "region"), r.select("region", (F.col("half_lat").cast("double") * F.col("half_lon")).alias("area")), "place_id", "region")


@query("jn24_preferred_store", "SELECT cell, min_by(id, (pref, id)) AS store FROM (SELECT CAST(floor(lat_e7 / 1e6) AS BIGINT) AS cell, id, CASE WHEN size > 25 THEN 0 ELSE 1 END AS pref FROM {buildings}) GROUP BY cell")
def preferred(read):
    """JN-24: of the stores over a cell, the one whose profile suits."""
    s = read("buildings").select(F.floor(F.col("lat_e7") / 1e6).alias("cell"), "id", F.when(F.col("size") > 25, 0).otherwise(1).alias("pref"))
    return s.groupBy("cell").agg(F.min_by("id", F.struct("pref", "id")).alias("store"))


@query("jn33_snow_depth", """SELECT a.r, a.c, round(CASE WHEN a.class > 0 AND a.r % 3 = 0 THEN a.class * 0.2 WHEN b.class % 3 = 1 THEN greatest(a.c / 100.0, 0.05) WHEN b.class % 3 = 2 THEN greatest(0, a.c / 100.0 - 0.3) ELSE a.c / 100.0 END, 4) AS depth FROM {grid_class} a JOIN {grid_class} b ON b.r = a.c AND b.c = a.r % 64""")
def snow(read):
    """JN-33: a national grid where there is one, else the model corrected by what is seen."""
    from geoloom.functions.physics import corrected_snow

    b = read("grid_class").select(F.col("r").alias("c"), F.col("c").alias("rr"), F.col("class").alias("seen"))
    a = read("grid_class").withColumn("rr", F.col("r") % 64).join(b, ["c", "rr"])
    seen = F.when(F.col("seen") % 3 == 1, "snow").when(F.col("seen") % 3 == 2, "bare")
    national = F.when((F.col("class") > 0) & (F.col("r") % 3 == 0), F.col("class") * 0.2)
    return a.select("r", "c", F.round(F.coalesce(national, corrected_snow(F.col("c") / 100.0, seen)), 4).alias("depth"))


@query("jn41_tiles_over_boxes", "SELECT id, y, x FROM {buildings}, range(11990, 12120) a(y), range(990, 1210) b(x) WHERE y BETWEEN floor((lat_e7 - half_lat) / 50000.0) AND floor((lat_e7 + half_lat) / 50000.0) AND x BETWEEN floor((lon_e7 - half_lon) / 50000.0) AND floor((lon_e7 + half_lon) / 50000.0)")
def tiles_over(read):
    """JN-41, JN-48, SRC-10: tiles of a grid that a box touches."""
    from geoloom.operators.spatial import box_cells

    b = read("buildings").select("id", *[(F.col(c) + s * F.col(h)).alias(n) for n, c, h, s in (("south_e7", "lat_e7", "half_lat", -1), ("west_e7", "lon_e7", "half_lon", -1), ("north_e7", "lat_e7", "half_lat", 1), ("east_e7", "lon_e7", "half_lon", 1))])
    return box_cells(b, 50_000).select("id", F.col("cell_lat").alias("y"), F.col("cell_lon").alias("x"))


@query("jn43_side_by_side")
def side(read):
    """JN-43: ways of one layer that run side by side."""
    moved = read("road_segments").select((F.col("seg_id") + 10_000_000).alias("way_id"), "seq", "lat_e7", "lon_e7")
    ways = read("ways").select("way_id", "layer")
    layers = ways.union(ways.select(F.col("way_id") + 10_000_000, F.col("layer") * F.when(F.col("way_id") % 2 == 0, 1).otherwise(2)))
    return regions.side_by_side(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7").union(moved), layers)


@query("jn46_point_profile", """WITH p AS (SELECT place_id, place_id % 500 AS r, place_id % 64 AS c FROM {places}) SELECT place_id, e.value AS elevation, k.class AS cover, m.n AS cells FROM p LEFT JOIN {grid} e USING (r, c) LEFT JOIN {grid_class} k USING (r, c) LEFT JOIN (SELECT r, c, class * 2 AS n FROM {grid_class} WHERE class > 6) m USING (r, c)""")
def profile(read):
    """JN-46: elevation, cover and more at a point, by left joins on the cell."""
    p = read("places").select("place_id", (F.col("place_id") % 500).alias("r"), (F.col("place_id") % 64).alias("c"))
    layers = {"elevation": read("grid").withColumnRenamed("value", "elevation"), "cover": read("grid_class").withColumnRenamed("class", "cover"), "cells": read("grid_class").where("class > 6").withColumn("cells", F.col("class") * 2)}
    return regions.point_profile(p, layers, ["r", "c"]).select("place_id", "elevation", "cover", "cells")


@query("jn49_lowest_under_footprint", "SELECT b.id, min(g.value) AS lowest FROM {buildings} b JOIN {grid} g ON g.r BETWEEN b.id % 400 AND b.id % 400 + 2 AND g.c BETWEEN b.id % 60 AND b.id % 60 + 2 GROUP BY b.id")
def lowest(read):
    """JN-49: the lowest sampled elevation under a footprint."""
    around = F.sequence(F.lit(0), F.lit(2))
    b = read("buildings").select("id", F.explode(around).alias("dr"), "id").toDF("id", "dr", "k").withColumn("dc", F.explode(around))
    cells = b.select("id", (F.col("k") % 400 + F.col("dr")).alias("r"), (F.col("k") % 60 + F.col("dc")).alias("c"))
    return cells.join(read("grid"), ["r", "c"]).groupBy("id").agg(F.min("value").alias("lowest"))


@query("jn50_name_lookup", "SELECT f.feature_id AS asked, min_by(p.place_id, (p.place_id % 4, p.place_id)) AS found FROM {named_features} f JOIN {places} p ON lower(replace(p.name, '-', ' ')) = f.name GROUP BY 1")
def name_lookup(read):
    """JN-50: places of a name, the best rank first."""
    p = read("places").select(F.lower(F.replace("name", F.lit("-"), F.lit(" "))).alias("name"), "place_id")
    best = p.groupBy("name").agg(F.min_by("place_id", F.struct(F.col("place_id") % 4, F.col("place_id"))).alias("found"))
    return read("named_features").select(F.col("feature_id").alias("asked"), "name").join(best.hint("merge"), "name").groupBy("asked").agg(F.min_by("found", F.struct(F.col("found") % 4, F.col("found"))).alias("found"))


@query("jn51_nearest_selected_cell", """WITH s AS (SELECT z0 AS "row", x0 AS a, x1 AS b FROM {selection_shapes}), p AS (SELECT place_id, place_id * 17 % 480 AS px, CAST(floor(place_id / 150.0) * 50 + place_id * 13 % 70 AS BIGINT) AS pz FROM {places}), d AS (SELECT place_id, "row", least(greatest(px, a), b) AS col, (least(greatest(px, a), b) - px) ** 2 + ("row" - pz) ** 2 AS d FROM p, s)
    SELECT place_id, min_by("row", (d, "row", col)) AS "row", min_by(col, (d, "row", col)) AS col FROM d GROUP BY place_id""")
def nearest_cell(read):
    """JN-51: the nearest selected cell of every place."""
    k = F.col("place_id")
    runs = read("selection_shapes").select(F.col("z0").alias("row"), F.col("x0").alias("start"), F.col("x1").alias("end"))
    p = read("places").select("place_id", (k * 17 % 480).alias("x"), (F.floor(k / 150) * 50 + k * 13 % 70).alias("z"))
    return areas.nearest_cell(p, runs, "place_id")


@query("sc24_stretch_in_box", f"""WITH {_PRE}, t AS (SELECT *, CAST(lat2 - lat_e7 AS DOUBLE) AS dy, CAST(lon2 - lon_e7 AS DOUBLE) AS dx FROM pre), q AS (SELECT *, greatest(0, CASE WHEN dy <> 0 THEN least((601000000 - lat_e7) / dy, (603000000 - lat_e7) / dy) ELSE 0 END, CASE WHEN dx <> 0 THEN least((51000000 - lon_e7) / dx, (56000000 - lon_e7) / dx) ELSE 0 END) AS t0,
      least(1, CASE WHEN dy <> 0 THEN greatest((601000000 - lat_e7) / dy, (603000000 - lat_e7) / dy) ELSE 1 END, CASE WHEN dx <> 0 THEN greatest((51000000 - lon_e7) / dx, (56000000 - lon_e7) / dx) ELSE 1 END) AS t1, (dy = 0 AND lat_e7 NOT BETWEEN 601000000 AND 603000000) OR (dx = 0 AND lon_e7 NOT BETWEEN 51000000 AND 56000000) AS out FROM t)
    SELECT way_id, round(min(before + t0 * metres), 3) AS enter, round(max(before + t1 * metres), 3) AS leave FROM q WHERE NOT out AND t0 <= t1 GROUP BY way_id""")
def stretch(read):
    """SC-24: where a line enters and leaves a box."""
    got = regions.stretch_in_box(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7"), "way_id", "seq", 601000000.0, 51000000.0, 603000000.0, 56000000.0)
    return got.select("way_id", F.round("enter", 3).alias("enter"), F.round("leave", 3).alias("leave"))


@query("sc26_densify", f"WITH {_PRE}, s AS (SELECT *, CAST(greatest(ceil(metres / 5.0), 1) AS INTEGER) AS n FROM pre) SELECT way_id, seq, count(*) AS points, round(max(lat_e7 + k * (lat2 - lat_e7) / CAST(n AS DOUBLE)) / 1e7, 4) AS mark FROM s, range(0, 60) r(k) WHERE k < n GROUP BY 1, 2")
def dense(read):
    """SC-26: points every five metres."""
    d = regions.densify(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7"), "way_id", "seq", 5.0)
    return d.groupBy("way_id", "seq").agg(F.count("*").alias("points"), F.round(F.max("y") / 1e7, 4).alias("mark"))


@query("sc60_soil_texture", "SELECT r, c, CASE WHEN stones >= 40 THEN 'stony' WHEN sand >= 70 THEN 'sandy' WHEN clay >= 35 THEN 'clayey' ELSE 'loamy' END AS texture, CAST(floor(sand / 10.0) * 256 + floor(clay / 10.0) * 16 + floor(stones / 10.0) AS BIGINT) AS code FROM (SELECT r, c, (value + 600) % 100 AS sand, (value * 3 + 2000) % 60 AS clay, (value * 7 + 5000) % 70 AS stones FROM {grid} WHERE value IS NOT NULL)")
def soil(read):
    """SC-60: texture by shares and a packed code."""
    v = F.col("value")
    s = read("grid").where("value is not null").select("r", "c", F.pmod(v + 600, F.lit(100)).alias("sand"), F.pmod(v * 3 + 2000, F.lit(60)).alias("clay"), F.pmod(v * 7 + 5000, F.lit(70)).alias("stones"))
    texture = F.when(F.col("stones") >= 40, "stony").when(F.col("sand") >= 70, "sandy").when(F.col("clay") >= 35, "clayey").otherwise("loamy")
    return s.select("r", "c", texture.alias("texture"), (F.floor(F.col("sand") / 10) * 256 + F.floor(F.col("clay") / 10) * 16 + F.floor(F.col("stones") / 10)).cast("bigint").alias("code"))


@query("sc67_wall_and_roof", "SELECT id, CASE WHEN id % 3 = 0 THEN least(h * 0.4, 4.0) ELSE 0.0 END AS roof, h - CASE WHEN id % 3 = 0 THEN least(h * 0.4, 4.0) ELSE 0.0 END - least(b, h - 1) AS wall, least(b, h - 1) AS bottom FROM (SELECT id, CAST(size + 3 AS DOUBLE) AS h, CAST(id % 4 AS DOUBLE) AS b FROM {buildings})")
def wall(read):
    """SC-67: total height split into bottom, wall and roof."""
    h, b = (F.col("size") + 3).cast("double"), (F.col("id") % 4).cast("double")
    roof = F.when(F.col("id") % 3 == 0, F.least(h * 0.4, F.lit(4.0))).otherwise(0.0)
    bottom = F.least(b, h - 1)
    return read("buildings").select("id", roof.alias("roof"), (h - roof - bottom).alias("wall"), bottom.alias("bottom"))


@query("src06_pruned_box", "SELECT id, lat_e7, lon_e7 FROM {buildings} WHERE lat_e7 - half_lat <= 603000000 AND lat_e7 + half_lat >= 601000000 AND lon_e7 - half_lon <= 56000000 AND lon_e7 + half_lon >= 51000000")
def pruned(read):
    """SRC-06: buildings written along a curve with a nested box, and read by box."""
    from uuid import uuid4

    from geoloom.session import shared_folder
    from geoloom.sources.boxes import read_boxes, write_boxes

    b = read("buildings").withColumns({"s": F.col("lat_e7") - F.col("half_lat"), "w": F.col("lon_e7") - F.col("half_lon"), "n": F.col("lat_e7") + F.col("half_lat"), "e": F.col("lon_e7") + F.col("half_lon")})
    path = f"{shared_folder(b.sparkSession)}/boxes-{uuid4().hex}"
    write_boxes(b, path, ("s", "w", "n", "e"))
    return read_boxes(b.sparkSession, path, 601000000, 51000000, 603000000, 56000000).select("id", "lat_e7", "lon_e7")


@query("src02_overpass_elements", "SELECT way_id, name, count(*) AS points FROM {way_points} JOIN {ways} USING (way_id) GROUP BY 1, 2")
def elements(read):
    """SRC-02: an answer's JSON elements to ways with geometry."""
    from geoloom.sources.readers import read_overpass_json

    w = read("way_points").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))).alias("g")).join(read("ways").select("way_id", "name"), "way_id")
    element = F.struct(F.lit("way").alias("type"), F.col("way_id").alias("id"), F.create_map(F.lit("name"), F.col("name")).alias("tags"), F.transform("g", lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("geometry"))
    answers = w.select(F.to_json(F.struct(F.array(element).alias("elements"))).alias("json"))
    return read_overpass_json(answers).where("kind = 'way'").select(F.col("id").alias("way_id"), F.col("tags")["name"].alias("name"), F.size("geometry").cast("bigint").alias("points"))


@query("fl13_eligible_cells", "SELECT r, c FROM {grid_class} WHERE class NOT IN (0, 3, 5) AND (r + c) % 4 <> 0")
def eligible(read):
    """FL-13: cells of no listed cover, off roads and water."""
    return read("grid_class").where(~F.col("class").isin(0, 3, 5) & ((F.col("r") + F.col("c")) % 4 != 0)).select("r", "c")


@query("st08_largest_part", "SELECT area, max_by(id, (CAST(half_lat AS DOUBLE) * half_lon, id)) AS part FROM (SELECT *, id % 20 AS area FROM {buildings}) GROUP BY area")
def largest(read):
    """ST-08: the largest part of an outline."""
    return read("buildings").groupBy((F.col("id") % 20).alias("area")).agg(F.max_by("id", F.struct(F.col("half_lat").cast("double") * F.col("half_lon"), F.col("id"))).alias("part"))


_BANDS = "SELECT CAST(floor(id / 40.0) AS BIGINT) AS cell, id, CAST(id * 7 % 23 AS DOUBLE) AS bottom, CAST(id * 7 % 23 + 2 + id % 4 AS DOUBLE) AS top FROM {buildings}"


@query("ag32_stacked_parts", f"""WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY cell ORDER BY id DESC) AS k FROM ({_BANDS})),
    s AS (SELECT cell, k, [struct_pack(id := id, bottom := bottom, top := top)] AS kept FROM r WHERE k = 1
      UNION ALL SELECT s.cell, r.k, CASE WHEN len(list_filter(kept, lambda x: x.bottom < r.top AND r.bottom < x.top)) = 0 THEN list_append(kept, struct_pack(id := r.id, bottom := r.bottom, top := r.top)) ELSE kept END FROM s JOIN r ON r.cell = s.cell AND r.k = s.k + 1),
    l AS (SELECT cell, unnest(max_by(kept, k)) AS b FROM s GROUP BY cell) SELECT cell, b.id AS id, b.bottom AS bottom, b.top AS top FROM l""")
def stacked(read):
    """AG-32: bands of a cell that don't overlap stay above each other; of overlapping ones, the newest."""
    bands = read("buildings").select(F.floor(F.col("id") / 40).alias("cell"), "id", (F.col("id") * 7 % 23).cast("double").alias("bottom"), (F.col("id") * 7 % 23 + 2 + F.col("id") % 4).cast("double").alias("top"))
    return regions.stacked_parts(bands, "cell")


@query("ag34_shoulders", """WITH road AS (SELECT r, c, value FROM {grid} WHERE (r + 2 * c) % 13 = 0 AND value IS NOT NULL), g AS (SELECT r, c, value FROM {grid} WHERE (r + 2 * c) % 13 <> 0 AND value IS NOT NULL),
    n AS (SELECT g.r, g.c, g.value, min_by(road.value, ((road.r - g.r) ** 2 + (road.c - g.c) ** 2, road.r, road.c)) AS h, min(sqrt((road.r - g.r) ** 2 + (road.c - g.c) ** 2)) AS d FROM g JOIN road ON road.r BETWEEN g.r - 3 AND g.r + 3 AND road.c BETWEEN g.c - 3 AND g.c + 3 GROUP BY 1, 2, 3)
    SELECT r, c, round(h + (value - h) * least(d / 4.0, 1), 4) AS height FROM n""")
def shoulders(read):
    """AG-34: cells near a graded road blend from its height to the ground."""
    from geoloom.operators.grids import near_pixels

    g = read("grid").where("value is not null")
    on = (F.col("r") + 2 * F.col("c")) % 13 == 0
    road = g.where(on).select(F.col("r").alias("pr"), F.col("c").alias("pc"), F.col("value").alias("h"))
    met = near_pixels(g.where(~on), road, 3).withColumn("d2", F.col("dr") * F.col("dr") + F.col("dc") * F.col("dc"))
    n = met.groupBy("r", "c", "value").agg(F.min_by("h", F.struct("d2", "pr", "pc")).alias("h"), F.sqrt(F.min("d2")).alias("d"))
    return n.select("r", "c", F.round(F.col("h") + (F.col("value") - F.col("h")) * F.least(F.col("d") / 4.0, F.lit(1.0)), 4).alias("height"))


@query("sc22_oriented_boxes")
def oriented(read):
    """SC-22: box along the longest segment."""
    b = regions.oriented_box(read("way_points").select("way_id", "seq", "lat_e7", "lon_e7"))
    return b.select("way_id", F.round("bearing", 3).alias("bearing"), F.round("half_length", 3).alias("half_length"), F.round("half_width", 3).alias("half_width"))


_SHAPES = "cells AS (SELECT shape_order, x, unnest(range(z0, z1)) AS z FROM (SELECT *, unnest(range(x0, x1)) AS x FROM {selection_shapes}))"


@query("ag31_best_entry", f"""WITH {_SHAPES}, e AS (SELECT DISTINCT c.shape_order, c.x, c.z FROM cells c, (VALUES (1, 0), (-1, 0), (0, 1), (0, -1)) o(a, b) WHERE NOT EXISTS (SELECT 1 FROM cells k WHERE k.shape_order = c.shape_order AND k.x = c.x + a AND k.z = c.z + b)), r AS (SELECT DISTINCT x, z FROM (SELECT x, unnest(range(z0 - 4, z1 + 5)) AS z FROM (SELECT *, unnest(range(x0 - 4, x1 + 5)) AS x FROM {{selection_shapes}})) WHERE (x + 2 * z) % 11 = 0 AND x >= 0 AND z >= 0),
    n AS (SELECT e.*, e.x + a AS rx, e.z + b AS rz FROM e, range(-4, 5) p(a), range(-4, 5) q(b)), m AS (SELECT n.*, (n.x - rx) ** 2 + (n.z - rz) ** 2 AS d2 FROM n JOIN r ON r.x = rx AND r.z = rz)
    SELECT shape_order, CAST(min_by(x, (d2, x, z)) AS INTEGER) AS x, CAST(min_by(z, (d2, x, z)) AS INTEGER) AS z, CAST(min(d2) AS INTEGER) AS d2 FROM m GROUP BY 1""")
def entries(read):
    """AG-31: the edge cell of each body nearest to a road."""
    from geoloom.plans.areas import shape_cells

    cells = shape_cells(read)
    around = read("selection_shapes").select(F.explode(F.sequence(F.col("x0") - 4, F.col("x1") + 4)).alias("x"), "z0", "z1").select("x", F.explode(F.sequence(F.col("z0") - 4, F.col("z1") + 4)).alias("z"))
    roads = around.where("(x + 2 * z) % 11 = 0 and x >= 0 and z >= 0").distinct()
    return regions.best_entry(cells, roads, "shape_order")
