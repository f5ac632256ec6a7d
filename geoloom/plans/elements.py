"""Queries over element tables: geometry, cells, imports."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import osm
from geoloom.plans.register import query

SEGMENTS = """seg AS (SELECT *, lead(lat_e7) OVER w AS lat2, lead(lon_e7) OVER w AS lon2 FROM {way_points} WINDOW w AS (PARTITION BY way_id ORDER BY seq)),
    m AS (SELECT *, sqrt(((lon2 - lon_e7) / 1e7 * 111320.0 * cos(radians(lat_e7 / 1e7))) ** 2 + ((lat2 - lat_e7) / 1e7 * 111320.0) ** 2) AS metres FROM seg WHERE lat2 IS NOT NULL)"""


def ways_with_refs(read):
    refs = read("nodes").groupBy("way_id").agg(F.array_sort(F.collect_list(F.struct("seq", "node_id"))).alias("s"))
    return read("ways").join(refs.select("way_id", F.col("s.node_id").alias("refs")), "way_id")


def resolved(read):
    return osm.resolve_ways(ways_with_refs(read), read("nodes"))


def members_of(read):
    return read("ways").select("rel_id", F.col("way_id").alias("ref"), "role")


@query(
    "street_lengths_by_cell",
    f"""WITH {SEGMENTS}, l AS (SELECT way_id, sum(metres) AS metres, count(*) + 1 AS n FROM m GROUP BY way_id),
    b AS (SELECT way_id, min(lat_e7) AS s, min(lon_e7) AS w, max(lat_e7) AS n_, max(lon_e7) AS e FROM {{way_points}} GROUP BY way_id)
    SELECT CAST(floor(s / 1e6) AS BIGINT) AS cell_lat, CAST(floor(w / 1e6) AS BIGINT) AS cell_lon, highway, count(*) AS streets, sum(n) AS vertices, round(sum(metres), 3) AS metres, min(s) AS south_e7, max(n_) AS north_e7
    FROM l JOIN b USING (way_id) JOIN {{ways}} USING (way_id) GROUP BY 1, 2, 3""",
)
def street_lengths(read):
    """JN-01, WN-01, SC-05, SC-14, SC-17: streets, vertices and metres by 0.1 degree cell and class."""
    points = resolved(read)
    lengths = osm.segments(points).groupBy("way_id").agg(F.sum("metres").alias("metres"), (F.count("*") + 1).alias("n"))
    boxed = osm.way_boxes(points).join(lengths, "way_id").join(read("ways").select("way_id", "highway"), "way_id")
    cells = boxed.groupBy(F.floor(F.col("south_e7") / 1e6).alias("cell_lat"), F.floor(F.col("west_e7") / 1e6).alias("cell_lon"), "highway")
    return cells.agg(F.count("*").alias("streets"), F.sum("n").alias("vertices"), F.round(F.sum("metres"), 3).alias("metres"), F.min("south_e7").alias("south_e7"), F.max("north_e7").alias("north_e7"))


@query("jn01_resolve_ways", "SELECT way_id, CAST(row_number() OVER (PARTITION BY way_id ORDER BY seq) - 1 AS INTEGER) AS pos, lat_e7, lon_e7 FROM {way_points} QUALIFY count(*) OVER (PARTITION BY way_id) >= 2")
def resolve(read):
    """JN-01, SRC-01: ordered refs to coordinates."""
    return resolved(read)


@query("wn01_segment_table", f"WITH {SEGMENTS} SELECT way_id, CAST(row_number() OVER w - 1 AS INTEGER) AS pos, round(metres, 4) AS metres, round(coalesce(sum(metres) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS before FROM m WINDOW w AS (PARTITION BY way_id ORDER BY seq)")
def segment_table(read):
    """WN-01, SC-18: length and running length of every segment."""
    return osm.segments(resolved(read)).select("way_id", "pos", F.round("metres", 4).alias("metres"), F.round("before", 4).alias("before"))


BOXES = "box AS (SELECT way_id, min(lat_e7) AS s, min(lon_e7) AS w, max(lat_e7) AS n, max(lon_e7) AS e FROM {way_points} GROUP BY way_id HAVING count(*) >= 2)"


@query("jn04_cells_of_ways", f"WITH {BOXES} SELECT way_id, y AS cell_lat, x AS cell_lon FROM box, range(590, 620) a(y), range(40, 70) b(x) WHERE y BETWEEN floor(s / 1e6) AND floor(n / 1e6) AND x BETWEEN floor(w / 1e6) AND floor(e / 1e6)")
def cells_of_ways(read):
    """JN-04, FL-05, SRC-03: every way under the cells its box touches."""
    return osm.file_under_cells(osm.way_boxes(resolved(read))).select("way_id", "cell_lat", "cell_lon")


@query("src04_read_cells", f"WITH {BOXES} SELECT way_id, s AS south_e7, w AS west_e7 FROM box WHERE s <= 602500000 AND n >= 600500000 AND w <= 55500000 AND e >= 51000000")
def cells_of_box(read):
    """SRC-04, ST-05, FL-03: features that touch a box, once each, from a cell-filed table."""
    filed = osm.file_under_cells(osm.way_boxes(resolved(read)))
    return osm.read_cells(filed, "way_id", 600500000, 51000000, 602500000, 55500000).select("way_id", "south_e7", "west_e7")


@query("src05_ag15_import_summary", f"WITH {BOXES} SELECT count(*) AS features, min(s) AS south_e7, min(w) AS west_e7, max(n) AS north_e7, max(e) AS east_e7, (SELECT count(DISTINCT (y, x)) FROM box, range(590, 620) a(y), range(40, 70) b(x) WHERE y BETWEEN floor(s / 1e6) AND floor(n / 1e6) AND x BETWEEN floor(w / 1e6) AND floor(e / 1e6)) AS cells FROM box")
def summary(read):
    """SRC-05, AG-15: the catalogue row of an import."""
    boxes = osm.way_boxes(resolved(read))
    return osm.import_summary(osm.file_under_cells(boxes), boxes)


@query("jn02_ways_and_members", """WITH k AS (SELECT * FROM {ways} WHERE highway IN ('motorway', 'primary')), r AS (SELECT DISTINCT rel_id FROM {ways} WHERE rel_id % 2 = 0)
    SELECT way_id, false AS by_relation FROM k UNION ALL SELECT way_id, true FROM {ways} WHERE rel_id IN (SELECT rel_id FROM r) AND way_id NOT IN (SELECT way_id FROM k)""")
def ways_and_members(read):
    """JN-02, FL-01, FL-02: ways of the profile and untagged members of kept relations."""
    relations = read("ways").select("rel_id").where("rel_id % 2 = 0").distinct()
    return osm.kept_ways(read("ways"), members_of(read), relations, "highway in ('motorway', 'primary')").select("way_id", "by_relation")


@query("jn03_area_import", """WITH i AS (SELECT DISTINCT way_id FROM {way_points} WHERE lat_e7 BETWEEN 600500000 AND 602500000 AND lon_e7 BETWEEN 51000000 AND 55500000),
    r AS (SELECT DISTINCT rel_id FROM {ways} WHERE way_id IN (SELECT way_id FROM i))
    SELECT way_id, 'inside' AS how FROM i UNION ALL SELECT DISTINCT way_id, 'relation' FROM {ways} WHERE rel_id IN (SELECT rel_id FROM r) AND way_id NOT IN (SELECT way_id FROM i)""")
def import_area(read):
    """JN-03: ways of an area and the outside pieces of the relations they belong to."""
    refs = read("way_points").select("way_id", "node_id")
    return osm.area_import(read("nodes"), refs, members_of(read), 600500000, 51000000, 602500000, 55500000)


@query("jn05_relation_geometry", "SELECT rel_id, way_id, role = 'inner' AS \"inner\", count(*) AS points, min(lat_e7) AS south_e7 FROM {ways} JOIN (SELECT way_id, lat_e7, count(*) OVER (PARTITION BY way_id) AS n FROM {way_points}) p USING (way_id) WHERE n >= 2 GROUP BY ALL")
def relation_points(read):
    """JN-05: members' geometry with the inner flag."""
    got = osm.relation_geometry(members_of(read), resolved(read))
    return got.groupBy("rel_id", "way_id", "inner").agg(F.count("*").alias("points"), F.min("lat_e7").alias("south_e7"))


@query("jn44_street_junctions", "SELECT CAST(floor(lat_e7 / 20000.0) AS BIGINT) AS y, CAST(floor(lon_e7 / 20000.0) AS BIGINT) AS x, count(DISTINCT name) AS names FROM {way_points} JOIN {ways} USING (way_id) GROUP BY 1, 2 HAVING count(DISTINCT name) >= 2")
def junctions(read):
    """JN-44: place keys (0.002 degrees here) shared by streets of two names or more."""
    met = read("way_points").join(read("ways").select("way_id", "name"), "way_id")
    return met.groupBy(F.floor(F.col("lat_e7") / 20000).alias("y"), F.floor(F.col("lon_e7") / 20000).alias("x")).agg(F.countDistinct("name").alias("names")).where("names >= 2")


@query("sc16_sc17_way_centroids", "SELECT way_id, round(avg(lat), 7) AS lat, round(avg(lon), 7) AS lon, min(lat_e7) AS south_e7, max(lon_e7) AS east_e7 FROM {way_points} GROUP BY way_id")
def centroids(read):
    """SC-16, SC-17: mean of the vertices and box."""
    return read("way_points").groupBy("way_id").agg(F.round(F.avg("lat"), 7).alias("lat"), F.round(F.avg("lon"), 7).alias("lon"), F.min("lat_e7").alias("south_e7"), F.max("lon_e7").alias("east_e7"))


@query("sc15_ring_area", """WITH p AS (SELECT way_id, lat, lon, seq, first_value(lat) OVER w AS lat0, first_value(lon) OVER w AS lon0, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM {way_points} WINDOW w AS (PARTITION BY way_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
    SELECT way_id, round(abs(sum((lon * coalesce(lat2, lat0) - coalesce(lon2, lon0) * lat) / 2)), 10) AS degrees2, round(abs(sum(((lon - lon0) * 111320.0 * cos(radians(lat0)) * (coalesce(lat2, lat0) - lat0) * 111320.0 - (coalesce(lon2, lon0) - lon0) * 111320.0 * cos(radians(lat0)) * (lat - lat0) * 111320.0) / 2)), 2) AS metres2 FROM p GROUP BY way_id""")
def ring_area(read):
    """SC-15: shoelace area of the ring that each way closes to, in square degrees and on the local scale."""
    from pyspark.sql import Window

    ring = Window.partitionBy("way_id").orderBy("seq")
    p = read("way_points").withColumns({"lat0": F.first("lat").over(ring), "lon0": F.first("lon").over(ring)})
    p = p.withColumns({"lat2": F.coalesce(F.lead("lat").over(ring), "lat0"), "lon2": F.coalesce(F.lead("lon").over(ring), "lon0")})
    x, y = lambda c: (F.col(c) - F.col("lon0")) * 111320.0 * F.cos(F.radians("lat0")), lambda c: (F.col(c) - F.col("lat0")) * 111320.0
    flat = (F.col("lon") * F.col("lat2") - F.col("lon2") * F.col("lat")) / 2
    metric = (x("lon") * y("lat2") - x("lon2") * y("lat")) / 2
    return p.groupBy("way_id").agg(F.round(F.abs(F.sum(flat)), 10).alias("degrees2"), F.round(F.abs(F.sum(metric)), 2).alias("metres2"))
