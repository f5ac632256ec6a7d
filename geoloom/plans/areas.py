"""Queries over cell sets, runs and rasterised features."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import areas, arrow
from geoloom.operators.components import shared_cells
from geoloom.plans.register import query
from geoloom.session import tasks_for
from geoloom.sources.fixtures import SPREAD_ROWS

_CELLS = "cells AS (SELECT shape_order, x, unnest(range(z0, z1)) AS z, subtract FROM (SELECT *, unnest(range(x0, x1)) AS x FROM {selection_shapes})), sel AS (SELECT x, z FROM (SELECT x, z, max_by(subtract, shape_order) AS gone FROM cells GROUP BY x, z) WHERE NOT gone)"


def shape_cells(read):
    s = read("selection_shapes")
    edge = lambda a, b, c, d: F.struct(F.col(a).cast("double").alias("x1"), F.col(b).cast("double").alias("z1"), F.col(c).cast("double").alias("x2"), F.col(d).cast("double").alias("z2"))
    ring = F.array(edge("x0", "z0", "x1", "z0"), edge("x1", "z0", "x1", "z1"), edge("x1", "z1", "x0", "z1"), edge("x0", "z1", "x0", "z0"))
    edges = s.select("shape_order", F.inline(ring))
    return areas.rasterise_polygons(edges, "shape_order")


def shape_tasks(read):
    """Tasks for the cells of the shapes: as many as the shapes are spread over."""
    return tasks_for(read("selection_shapes"), SPREAD_ROWS)


def selection(read, tasks):
    return areas.select_area(shape_cells(read), read("selection_shapes").select("shape_order", "subtract"), tasks)


@query("ag20_polygon_raster", f"WITH {_CELLS} SELECT shape_order, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM cells")
def polygon_raster(read):
    """AG-20, UD-04: cells whose centre is inside a polygon."""
    return shape_cells(read).select("shape_order", "x", "z")


@query("st01_area_selection", f"WITH {_CELLS} SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z FROM sel")
def area_selection(read):
    """ST-01: shapes added and taken away in order."""
    return selection(read, shape_tasks(read))


@query("st02_set_operations", f"WITH {_CELLS}, o AS (SELECT x + 3 AS x, z + 2 AS z FROM sel) SELECT 'union' AS op, (SELECT count(*) FROM (SELECT * FROM sel UNION SELECT * FROM o)) AS n UNION ALL SELECT 'difference', (SELECT count(*) FROM (SELECT * FROM sel EXCEPT SELECT * FROM o)) UNION ALL SELECT 'common', (SELECT count(*) FROM (SELECT * FROM sel INTERSECT SELECT * FROM o))")
def set_operations(read):
    """ST-02: union, difference and intersection of selections."""
    tasks = shape_tasks(read)
    a = selection(read, tasks)
    b = a.select((F.col("x") + 3).alias("x"), (F.col("z") + 2).alias("z"))
    return areas.set_sizes(a, b, tasks)


_DISC = "d AS (SELECT a, b FROM range(-2, 3) p(a), range(-2, 3) q(b) WHERE a * a + b * b <= 4)"


@query("st03_grow", f"WITH {_CELLS}, {_DISC} SELECT DISTINCT CAST(x + a AS INTEGER) AS x, CAST(z + b AS INTEGER) AS z FROM sel, d")
def grown(read):
    """ST-03: dilation by a round brush of two cells."""
    tasks = shape_tasks(read)
    return areas.grow(selection(read, tasks), 2, tasks)


@query("st03_shrink", f"WITH {_CELLS}, {_DISC} SELECT CAST(x + a AS INTEGER) AS x, CAST(z + b AS INTEGER) AS z FROM sel, d GROUP BY 1, 2 HAVING count(*) = 13")
def shrunk(read):
    """ST-03: erosion by the same brush."""
    tasks = shape_tasks(read)
    return areas.shrink(selection(read, tasks), 2, tasks)


@query("st04_outline", f"WITH {_CELLS}, e AS (SELECT x AS x1, z AS z1, x + 1 AS x2, z AS z2 FROM sel UNION ALL SELECT x, z + 1, x + 1, z + 1 FROM sel UNION ALL SELECT x, z, x, z + 1 FROM sel UNION ALL SELECT x + 1, z, x + 1, z + 1 FROM sel) SELECT CAST(x1 AS INTEGER) AS x1, CAST(z1 AS INTEGER) AS z1, CAST(x2 AS INTEGER) AS x2, CAST(z2 AS INTEGER) AS z2 FROM e GROUP BY ALL HAVING count(*) = 1")
def outlined(read):
    """ST-04: edges of a cell set that are seen once."""
    tasks = shape_tasks(read)
    return areas.outline(selection(read, tasks), tasks)


@query("st07_coverage_level", f"WITH {_CELLS} SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, max(shape_order % 5) AS level FROM cells GROUP BY 1, 2")
def coverage(read):
    """ST-07, AG-16: the highest level that covers a cell."""
    return areas.by_blocks(shape_cells(read), shape_tasks(read)).groupBy("_bx", "_bz", "x", "z").agg(F.max(F.col("shape_order") % 5).alias("level")).drop("_bx", "_bz")


_RUNS = "r AS (SELECT CAST(z0 AS INTEGER) AS \"row\", x0 AS s, x1 AS e FROM {selection_shapes} UNION ALL SELECT CAST(z0 AS INTEGER), x0 + 6, x1 + 9 FROM {selection_shapes} WHERE shape_order % 2 = 0)"


def _runs(read):
    s = read("selection_shapes")
    return s.select(F.col("z0").alias("row"), F.col("x0").alias("start"), F.col("x1").alias("end")).union(s.where("shape_order % 2 = 0").select("z0", F.col("x0") + 6, F.col("x1") + 9))


@query("wn09_interval_union", f"""WITH {_RUNS}, c AS (SELECT DISTINCT "row", unnest(range(s, e + 1)) AS x FROM r) SELECT "row", CAST(min(x) AS INTEGER) AS "start", CAST(max(x) AS INTEGER) AS "end" FROM (SELECT "row", x, x - row_number() OVER (PARTITION BY "row" ORDER BY x) AS i FROM c) GROUP BY "row", i""")
def interval_union(read):
    """WN-09: touching runs merge."""
    return areas.union_runs(_runs(read))


@query("wn10_interval_difference", f"""WITH {_RUNS}, c AS (SELECT DISTINCT "row", x FROM (SELECT "row", unnest(range(s, e + 1)) AS x FROM r) WHERE x % 9 <> 4) SELECT "row", CAST(min(x) AS INTEGER) AS "start", CAST(max(x) AS INTEGER) AS "end" FROM (SELECT "row", x, x - row_number() OVER (PARTITION BY "row" ORDER BY x) AS i FROM c) GROUP BY "row", i""")
def interval_difference(read):
    """WN-10: what one set of runs covers and another doesn't."""
    a = areas.union_runs(_runs(read))
    b = areas.cells_of_runs(a).where("col % 9 = 4").select("row", F.col("col").alias("start"), F.col("col").alias("end"))
    return areas.subtract_runs(a, b)


@query("ag21_line_raster", """WITH s AS (SELECT shape_order, x0 + 0.3 AS x1, z0 + 0.2 AS z1, x1 + 0.6 AS x2, z1 + 0.9 AS z2, range(x0 - 4, x1 + 5) AS xs, range(z0 - 4, z1 + 5) AS zs FROM {selection_shapes}), c AS (SELECT * EXCLUDE (zs), unnest(zs) AS z FROM (SELECT * EXCLUDE (xs), unnest(xs) AS x FROM s)),
    t AS (SELECT *, least(greatest(((x + 0.5 - x1) * (x2 - x1) + (z + 0.5 - z1) * (z2 - z1)) / ((x2 - x1) ** 2 + (z2 - z1) ** 2), 0), 1) AS t FROM c), d AS (SELECT *, sqrt((x + 0.5 - x1 - t * (x2 - x1)) ** 2 + (z + 0.5 - z1 - t * (z2 - z1)) ** 2) AS d FROM t)
    SELECT shape_order, CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, round(d, 5) AS d FROM d WHERE d <= 2.2""")
def line_raster(read):
    """AG-21, SC-21: cells within half a width of a line."""
    s = read("selection_shapes").select("shape_order", (F.col("x0") + 0.3).alias("a"), (F.col("z0") + 0.2).alias("b"), (F.col("x1") + 0.6).alias("c"), (F.col("z1") + 0.9).alias("d")).toDF("shape_order", "x1", "z1", "x2", "z2")
    return areas.rasterise_lines(s, "shape_order", 2.2).withColumn("d", F.round("d", 5))


@query("ag23_layered_overlay", f"WITH {_CELLS} SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, max_by('c' || shape_order, (shape_order % 3, shape_order)) AS class FROM cells GROUP BY 1, 2")
def layered(read):
    """AG-23, SO-01: by priority, then later over earlier."""
    c = shape_cells(read).withColumn("class", F.concat(F.lit("c"), F.col("shape_order").cast("string")))
    return areas.overlay(c, [F.col("shape_order") % 3, F.col("shape_order")], shape_tasks(read))


@query("ag24_gap_fill_overlay", f"WITH {_CELLS}, a AS (SELECT x, z, max(shape_order) AS first FROM cells WHERE shape_order % 2 = 0 GROUP BY 1, 2), b AS (SELECT x, z, max(shape_order) AS second FROM cells WHERE shape_order % 2 = 1 GROUP BY 1, 2) SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, coalesce(first, second) AS class FROM a FULL JOIN b USING (x, z)")
def gap_fill(read):
    """AG-24: a second source where the first has none."""
    c = shape_cells(read)
    a = c.where("shape_order % 2 = 0").groupBy("x", "z").agg(F.max("shape_order").alias("first"))
    b = c.where("shape_order % 2 = 1").groupBy("x", "z").agg(F.max("shape_order").alias("second"))
    return a.join(b, ["x", "z"], "full").select("x", "z", F.coalesce("first", "second").alias("class"))


@query("ag22_connected_components", """WITH RECURSIVE e AS (SELECT DISTINCT a.way_id AS a, b.way_id AS b FROM {way_points} a JOIN {way_points} b ON CAST(floor(a.lat_e7 / 10000.0) AS BIGINT) = CAST(floor(b.lat_e7 / 10000.0) AS BIGINT) AND CAST(floor(a.lon_e7 / 10000.0) AS BIGINT) = CAST(floor(b.lon_e7 / 10000.0) AS BIGINT) AND a.way_id <> b.way_id),
    r(n, m) AS (SELECT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.n) SELECT n AS node, min(m) AS component FROM r GROUP BY n""")
def components(read):
    """AG-22: ways that share a small cell, directly or through others."""
    cell = F.floor(F.col("lat_e7") / 10000) * 1_000_000 + F.floor(F.col("lon_e7") / 10000)
    return shared_cells(read("way_points").select("way_id", "seq", cell.alias("cell")), "way_id", "seq", "cell")


@query("ag25_distance_transform", f"WITH {_CELLS}, c AS (SELECT shape_order, x, z FROM cells), o AS (SELECT a, b FROM range(-5, 6) p(a), range(-5, 6) q(b)) SELECT c.shape_order, CAST(c.x AS INTEGER) AS x, CAST(c.z AS INTEGER) AS z, round(min(sqrt(a * a + b * b)), 5) AS d FROM c, o WHERE NOT EXISTS (SELECT 1 FROM c k WHERE k.shape_order = c.shape_order AND k.x = c.x + a AND k.z = c.z + b) GROUP BY 1, 2, 3")
def distances(read):
    """AG-25: distance of each cell to the outside of its body."""
    return areas.distance_to_outside(shape_cells(read), "shape_order").withColumn("d", F.round("d", 5))


@query("ag33_two_decks", f"WITH {_CELLS}, n AS (SELECT x, z, shape_order, row_number() OVER (PARTITION BY x, z ORDER BY shape_order % 3 DESC, shape_order % 5 DESC, shape_order) AS n FROM cells) SELECT CAST(x AS INTEGER) AS x, CAST(z AS INTEGER) AS z, max(CASE WHEN n = 1 THEN shape_order END) AS top, max(CASE WHEN n = 2 THEN shape_order END) AS under FROM n GROUP BY 1, 2")
def decks(read):
    """AG-33: the top way of a cell and the one under it."""
    c = shape_cells(read).select("x", "z", F.col("shape_order").alias("id"), (F.col("shape_order") % 3).alias("layer"), (F.col("shape_order") % 5).alias("priority"))
    return areas.two_decks(c, shape_tasks(read))


@query("st06_identical_pages", "SELECT lanes, width_m, min(seg_id) AS first FROM (SELECT DISTINCT seg_id, lanes, width_m FROM {road_segments}) GROUP BY ALL")
def identical(read):
    """ST-06, SRC-14: identical records kept once."""
    return read("road_segments").select("seg_id", "lanes", "width_m").distinct().groupBy("lanes", "width_m").agg(F.min("seg_id").alias("first"))


@query("src12_merge_sink", """WITH o AS (SELECT id, 'old' AS origin, size FROM {buildings} WHERE id % 3 <> 0), n AS (SELECT id, 'new' AS origin, size + 1 AS size FROM {buildings} WHERE id % 2 = 0) SELECT * FROM n UNION ALL SELECT * FROM o WHERE id NOT IN (SELECT id FROM n)""")
def merge_sink(read):
    """SRC-12, SRC-13: new rows win per key, old rows of other keys stay."""
    from geoloom.sources.sinks import merge_by_key

    b = read("buildings")
    old = b.where("id % 3 <> 0").select("id", F.lit("old").alias("origin"), "size")
    new = b.where("id % 2 = 0").select("id", F.lit("new").alias("origin"), (F.col("size") + 1).alias("size"))
    return merge_by_key(old, new, ["id"])


@query("sc23_clip_rings", "SELECT id, round(greatest(least(lon_e7 + half_lon, 57000000) - greatest(lon_e7 - half_lon, 52000000), 0) * CAST(greatest(least(lat_e7 + half_lat, 604000000) - greatest(lat_e7 - half_lat, 601000000), 0) AS DOUBLE) / 1e6, 2) AS area FROM {buildings}")
def clipped(read):
    """SC-23: rings clipped to a box; the area left shows the clip."""
    corner = lambda sx, sy: F.array((F.col("lon_e7") + sx * F.col("half_lon")).cast("double"), (F.col("lat_e7") + sy * F.col("half_lat")).cast("double"))
    ring = F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1))
    left = read("buildings").select("id", "lon_e7", "lat_e7", arrow.clip_ring(ring, 52000000.0, 601000000.0, 57000000.0, 604000000.0).alias("p"))
    move = F.transform("p", lambda v: F.array(v[0] - F.col("lon_e7"), v[1] - F.col("lat_e7")))
    q = left.select("id", move.alias("p"))
    turned = F.concat(F.slice("p", 2, F.size("p")), F.slice("p", 1, 1))
    area = F.aggregate(F.zip_with("p", turned, lambda a, b: a[0] * b[1] - b[0] * a[1]), F.lit(0.0), lambda s, v: s + v) / 2
    return q.select("id", F.round(F.abs(F.when(F.size("p") > 2, area).otherwise(0.0)) / 1e6, 2).alias("area"))


@query("sc25_simplify_lines")
def simplified(read):
    """SC-25: Douglas-Peucker of every profile, the points kept."""
    p = read("grid").select(F.col("r").alias("line"), F.col("c"), F.coalesce("value", F.lit(0)).alias("v"))
    lines = p.groupBy("line").agg(F.array_sort(F.collect_list(F.struct("c", "v"))).alias("s")).select("line", F.transform("s", lambda x: F.array(x["c"].cast("double"), x["v"].cast("double"))).alias("pts"))
    return arrow.simplify(lines, "line", "pts", 60.0).select("line", F.size("kept").alias("kept"))


@query("ag19_ring_assembly")
def rings(read):
    """AG-19: the member ways of each relation joined end to end."""
    from pyspark.sql import Window

    w = Window.partitionBy("way_id")
    ends = read("way_points").withColumns({"a": F.min("seq").over(w), "b": F.max("seq").over(w)})
    point = F.concat_ws(",", F.floor(F.col("lat_e7") / 200000).cast("string"), F.floor(F.col("lon_e7") / 200000).cast("string"))
    f = ends.groupBy("way_id").agg(F.max(F.when(F.col("seq") == F.col("a"), point)).alias("first"), F.max(F.when(F.col("seq") == F.col("b"), point)).alias("last"))
    return arrow.assemble_rings(read("ways").select("rel_id", "role", "way_id").join(f, "way_id"), ["rel_id", "role"])


@query("ag26_smooth_surface")
def surface(read):
    """AG-26: a smooth bed through the fixed cells of each body."""
    c = shape_cells(read).withColumn("fixed", F.when((F.col("x") + F.col("z")) % 7 == 0, (F.col("x") % 5).cast("double")))
    return arrow.relax_surface(c, "shape_order").withColumn("level", F.round("level", 4))
