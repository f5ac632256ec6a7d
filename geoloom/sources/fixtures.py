"""Feature tables derived from the given tables, in SQL that Spark and DuckDB both read.

Each text names its inputs in braces: given tables or other derived ones. Spark substitutes DataFrames, an oracle the
names of common table expressions, so both engines see the same rows. Where the dialects differ, there are two texts.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from geoloom.session import tasks_for

TABLES = "region nation customer supplier part orders lineitem events documents embeddings".split()

_BASE = "600000000 + (CAST({k} AS BIGINT) * 7919 % 4999) * 1000 AS lat_e7, 50000000 + (CAST({k} AS BIGINT) * 104729 % 9973) * 1000 AS lon_e7"


def _base(key: str) -> str:
    return _BASE.replace("{k}", key)


SQL: dict[str, str] = {
    "nodes": """SELECT node_id, way_id, seq,
        600000000 + (way_id * 7919 % 4999) * 1000 + seq * 900 * CASE way_id % 4 WHEN 0 THEN 0 WHEN 3 THEN -1 ELSE 1 END AS lat_e7,
        50000000 + (way_id * 104729 % 9973) * 1000 + seq * 1500 * CASE way_id % 4 WHEN 1 THEN 0 ELSE 1 END AS lon_e7
        FROM (SELECT DISTINCT CAST(l_orderkey AS BIGINT) * 16 + l_linenumber AS node_id, CAST(l_orderkey AS BIGINT) AS way_id, CAST(l_linenumber AS BIGINT) AS seq FROM {lineitem}) t""",
    "ways": """SELECT CAST(o_orderkey AS BIGINT) AS way_id, CAST(o_custkey AS BIGINT) AS rel_id,
        CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'motorway' WHEN '2' THEN 'primary' WHEN '3' THEN 'secondary' WHEN '4' THEN 'residential' ELSE 'footway' END AS highway,
        CASE WHEN o_orderstatus = 'P' THEN 'yes' END AS bridge, CAST(o_orderkey % 3 AS INT) AS layer, concat('Street ', CAST(o_custkey % 500 AS STRING)) AS name,
        CASE o_orderkey % 5 WHEN 0 THEN concat(CAST(o_orderkey % 9 + 3 AS STRING), ' m') WHEN 1 THEN concat(CAST(o_orderkey % 9 + 3 AS STRING), ' ft') END AS width,
        CASE WHEN o_orderkey % 4 = 0 THEN 'inner' ELSE 'outer' END AS role FROM {orders}""",
    "way_points": "SELECT w.way_id, n.seq, n.node_id, n.lat_e7, n.lon_e7, n.lat_e7 / 1e7 AS lat, n.lon_e7 / 1e7 AS lon FROM {ways} w JOIN {nodes} n ON n.way_id = w.way_id",
    "buildings": f"""SELECT CAST(p_partkey AS BIGINT) AS id, {_base("p_partkey")}, (CAST(p_size AS BIGINT) + 12) * 90 AS half_lat, (CAST(p_size AS BIGINT) + 12) * 180 AS half_lon,
        CASE p_partkey % 5 WHEN 0 THEN 'house' WHEN 1 THEN 'apartments' WHEN 2 THEN 'church' WHEN 3 THEN 'garage' ELSE 'yes' END AS building,
        CASE WHEN p_partkey % 4 = 0 THEN concat(CAST(p_size + 3 AS STRING), ' m') END AS height, CASE WHEN p_partkey % 4 = 1 THEN CAST(p_size % 12 + 1 AS STRING) END AS levels, CAST(p_size AS BIGINT) AS size FROM {{part}}""",
    "height_points": f"""SELECT CAST(p_partkey AS BIGINT) * 2 AS point_id, CASE WHEN p_partkey % 3 = 0 THEN CAST(p_partkey AS BIGINT) ELSE 0 END AS osm_id, lat_e7 + k % 40 * 100 AS lat_e7, lon_e7, round(CAST(p_retailprice AS DOUBLE) - 895, 1) AS height
        FROM (SELECT p_partkey, p_retailprice, CAST(p_partkey AS BIGINT) AS k, {_base("p_partkey")} FROM {{part}}) t WHERE k % 3 <> 2
        UNION ALL SELECT CAST(p_partkey AS BIGINT) * 2 + 1, 0, lat_e7, lon_e7 + k % 30 * 150, round(CAST(p_retailprice AS DOUBLE) - 895, 1) + 3
        FROM (SELECT p_partkey, p_retailprice, CAST(p_partkey AS BIGINT) AS k, {_base("p_partkey")} FROM {{part}}) t WHERE k % 5 = 0""",
    "registry": """SELECT id AS reg_id, lat_e7, lon_e7 + id % 30 * 200 AS lon_e7, half_lat, half_lon, CASE WHEN id % 2 = 0 THEN NULL ELSE CAST(size + 4 AS DOUBLE) END AS height, CAST(size % 12 AS INT) AS floors, id % 7 = 0 AS flat,
        CASE WHEN id % 3 = 0 THEN 1 ELSE 2 END AS source_order FROM {buildings}""",
    "other_buildings": """SELECT id + 1000000 AS other_id, lat_e7, lon_e7 + id % 5 * 6000 AS lon_e7, half_lat, half_lon, CASE WHEN id % 4 = 1 THEN 'OpenStreetMap' ELSE 'Other' END AS geometry_source, id % 11 = 0 AS is_underground
        FROM {buildings} WHERE id % 3 = 0""",
    "road_segments": """SELECT p.way_id AS seg_id, p.seq, p.lat_e7 + p.way_id % 12 * 90 AS lat_e7, p.lon_e7, CASE WHEN p.way_id % 6 = 0 THEN NULL ELSE CAST(4 + p.way_id % 10 AS DOUBLE) END AS width_m, CAST(p.way_id % 4 AS INT) AS lanes, p.way_id % 2 = 0 AS both_ways FROM {way_points} p""",
    "places": f"""SELECT CAST(c_custkey AS BIGINT) AS place_id, {_base("c_custkey")}, concat(c_mktsegment, '-', CAST(c_custkey % 300 AS STRING)) AS name, CAST(c_custkey % 100 AS DOUBLE) / 100 AS confidence,
        CASE c_nationkey % 6 WHEN 0 THEN 'restaurant' WHEN 1 THEN 'cafe' WHEN 2 THEN 'hotel' WHEN 3 THEN 'pharmacy' WHEN 4 THEN 'museum' ELSE 'school' END AS category FROM {{customer}}""",
    "named_features": "SELECT place_id AS feature_id, lat_e7 + place_id % 10 * 1100 AS lat_e7, lon_e7, lower(replace(name, '-', ' ')) AS name FROM {places} WHERE place_id % 2 = 0",
    "observations": f"""SELECT CAST(event_id AS BIGINT) AS event_id, concat('S', CAST(user_id AS STRING)) AS station, CAST(user_id AS BIGINT) AS user_id, {_base("user_id")}, ts,
        CASE event_type WHEN 'view' THEN '-RA' WHEN 'purchase' THEN 'VCSH' WHEN 'signup' THEN 'TSRA' WHEN 'error' THEN 'SN' ELSE '' END AS wx, CASE WHEN event_id % 13 = 0 THEN NULL ELSE CAST(value AS DOUBLE) / 10 - 15 END AS temp_c FROM {{events}}""",
    "radar": f"""SELECT CAST(event_id AS BIGINT) AS event_id, {_base("user_id")}, ts, CAST(value AS DOUBLE) / 1000 AS rate, event_id % 17 = 0 AS lightning FROM {{events}} WHERE event_id % 3 = 0""",
    "forecast": f"""SELECT CAST(event_id AS BIGINT) AS event_id, {_base("user_id")}, ts, CASE event_id % 5 WHEN 0 THEN 'clearsky_day' WHEN 1 THEN 'rain' WHEN 2 THEN 'heavyrainandthunder' WHEN 3 THEN 'lightsnow' ELSE 'cloudy' END AS symbol, CAST(value AS DOUBLE) / 20 AS temp_c FROM {{events}} WHERE event_id % 3 = 1""",
    "daily_weather": """SELECT CAST(l_suppkey AS BIGINT) AS station, CAST(l_shipdate AS DATE) AS day, avg(CAST(l_quantity AS DOUBLE) / 2 - 10) AS temp, avg(CAST(l_discount AS DOUBLE) * 100) AS precip FROM {lineitem} GROUP BY 1, 2""",
    "surveys": """SELECT CAST(o_orderkey AS BIGINT) AS survey_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE floor(CAST(o_totalprice AS DOUBLE) / 1000.0) END AS stated_max, CASE WHEN o_orderstatus = 'P' THEN 'x' END AS flag FROM {orders}""",
    "readings": """SELECT CAST(l_orderkey AS BIGINT) AS survey_id, CAST(l_orderkey AS BIGINT) * 16 + l_linenumber AS reading_id, CAST(max(l_quantity) AS DOUBLE) - 5 AS thickness FROM {lineitem} GROUP BY 1, 2""",
    "road_records": "SELECT CAST(l_orderkey AS BIGINT) AS link, CAST(l_linenumber AS INT) AS part, CAST(l_linenumber % 4 AS INT) AS lanes, CAST(l_quantity AS DOUBLE) AS width FROM {lineitem}",
    "selection_shapes": """SELECT k AS shape_order, k % 3 = 0 AS subtract, CAST(k * 7 % 40 + block % 8 * 60 AS INT) AS x0, CAST(k * 11 % 30 + floor(k / 200.0) * 50 AS INT) AS z0,
        CAST(k * 7 % 40 + block % 8 * 60 + 4 + k % 9 AS INT) AS x1, CAST(k * 11 % 30 + floor(k / 200.0) * 50 + 3 + k % 7 AS INT) AS z1
        FROM (SELECT CAST(p_partkey AS INT) AS k, CAST(floor(CAST(p_partkey AS INT) / 25.0) AS INT) AS block FROM {part}) t""",
    "files": "SELECT concat(source, '_', lang, '_', CAST(doc_id AS STRING)) AS path, CAST(n_chars AS BIGINT) AS size FROM {documents}",
    "data_sources": "SELECT DISTINCT source AS prefix FROM {documents} UNION ALL SELECT DISTINCT concat(source, '_fr') FROM {documents} WHERE lang = 'fr'",
    "lakes": f"""SELECT CAST(s_suppkey AS BIGINT) AS lake_id, {_base("s_suppkey")}, (200 + CAST(s_suppkey AS BIGINT) % 400) * 45 AS half_lat, (200 + CAST(s_suppkey AS BIGINT) % 400) * 90 AS half_lon FROM {{supplier}}""",
    "lake_outlets": "SELECT lake_id AS outlet_id, lat_e7, lon_e7 + half_lon + lake_id % 9 * 500 AS lon_e7, (half_lat * 2 / 90.0) * (half_lon * 2 / 180.0) / 1e6 * (1 + lake_id % 5) AS area_km2, CASE WHEN lake_id % 4 = 0 THEN 0.0 ELSE CAST(lake_id % 60 AS DOUBLE) END AS dmax_m FROM {lakes}",
}
_P = "SELECT way_id, max(CASE WHEN seq = 1 THEN lat_e7 END) AS y0, max(CASE WHEN seq = 1 THEN lon_e7 END) AS x0, max(CASE WHEN seq = 2 THEN lat_e7 END) AS y1, max(CASE WHEN seq = 2 THEN lon_e7 END) AS x1 FROM {way_points} GROUP BY way_id HAVING max(seq) >= 2"
# Ways of three layers: those of `ways`, one across each first segment, one from its start (a shared end) and one 3 m beside it.
SQL |= {
    "bridge_points": f"""SELECT way_id, seq, lat_e7, lon_e7, CASE WHEN way_id % 41 = 0 AND seq = 1 THEN NULL ELSE CAST((lat_e7 + lon_e7) % 4700 AS DOUBLE) / 100 END AS z FROM (
        SELECT way_id * 10 AS way_id, seq, lat_e7, lon_e7 FROM {{way_points}}
        UNION ALL SELECT way_id * 10 + 1 + CAST(floor(j / 2.0) AS BIGINT), CAST(j % 2 AS BIGINT),
          CASE j WHEN 0 THEN CAST(floor((y0 + y1) / 2.0) AS BIGINT) - 2000 WHEN 1 THEN CAST(floor((y0 + y1) / 2.0) AS BIGINT) + 2100 WHEN 2 THEN y0 WHEN 3 THEN y1 + 200 WHEN 4 THEN y0 + 250 ELSE y1 + 250 END,
          CASE j WHEN 0 THEN CAST(floor((x0 + x1) / 2.0) AS BIGINT) + 1500 WHEN 1 THEN CAST(floor((x0 + x1) / 2.0) AS BIGINT) - 1600 WHEN 2 THEN x0 WHEN 3 THEN x1 + 300 WHEN 4 THEN x0 + 150 ELSE x1 + 150 END
          FROM ({_P}) p CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5)) v(j) WHERE CASE WHEN j < 2 THEN way_id % 2 = 0 WHEN j < 4 THEN way_id % 3 = 0 ELSE way_id % 5 < 3 END) t""",
    "bridge_ways": """SELECT way_id, CASE way_id % 10 WHEN 0 THEN CAST(floor(way_id / 10.0) AS INT) % 3 WHEN 1 THEN CAST(floor(way_id / 10.0) AS INT) % 2 * 2 ELSE 1 END AS layer, CAST(2 + way_id % 3 AS DOUBLE) AS half_width,
        way_id % 7 <> 0 AS carries, CAST(CASE way_id % 4 WHEN 0 THEN 6 WHEN 1 THEN 5 ELSE 3 END AS DOUBLE) AS room FROM (SELECT DISTINCT way_id FROM {bridge_points}) t""",
}
# For each supplier a block of 16 by 16 cells with a coast: an island, a lake, a slanted shore, a ring of both directions, a diamond through corners.
_RINGS = {0: ((3.5, 11.5), (3.5, 3.5), (11.5, 3.5), (11.5, 11.5), (3.5, 11.5)), 1: ((3.5, 3.5), (3.5, 11.5), (11.5, 11.5), (11.5, 3.5), (3.5, 3.5)), 2: ((2.3, -0.5), (13.7, 16.5)), 4: ((2.0, 8.0), (8.0, 2.0), (14.0, 8.0), (8.0, 14.0), (2.0, 8.0))}
_COAST = [(kind, *a, *b) for kind, ring in _RINGS.items() for a, b in zip(ring, ring[1:], strict=False)] + [(3, 3.5, 11.5, 3.5, 3.5), (3, 3.5, 3.5, 11.5, 3.5), (3, 11.5, 11.5, 11.5, 3.5), (3, 11.5, 11.5, 3.5, 11.5)]
SQL |= {
    "coast_cells": """SELECT k * 20 + i AS r, j AS c, CASE WHEN (k + i * 3 + j) % 19 = 0 THEN NULL ELSE CAST((k + i * 7 + j * 5) % 9 - 4 AS DOUBLE) END AS elevation
        FROM (SELECT CAST(s_suppkey AS BIGINT) AS k FROM {supplier}) s CROSS JOIN (VALUES NUMBERS) a(i) CROSS JOIN (VALUES NUMBERS) b(j)""".replace("NUMBERS", ", ".join(f"({k})" for k in range(16))),
    "coast_lines": f"""SELECT k * 20 + CAST(ay AS DOUBLE) + shift AS ay, CAST(ax AS DOUBLE) + shift AS ax, k * 20 + CAST(ey AS DOUBLE) + shift AS ey, CAST(ex AS DOUBLE) + shift AS ex
        FROM (SELECT CAST(s_suppkey AS BIGINT) AS k, CASE WHEN s_suppkey % 5 = 4 THEN 0 ELSE s_suppkey % 3 * 0.25 END AS shift FROM {{supplier}}) s CROSS JOIN (VALUES {", ".join(map(str, _COAST))}) v(kind, ay, ax, ey, ex) WHERE k % 5 = kind""",
}
# Map tiles of 16 by 16 pixels in the colours of a legend, with grey lines, soft edges, colours near none and clear parts; blocks of one colour are 4 wide.
SQL |= {
    "map_legend": "SELECT DISTINCT class * 20 * 65536 + (255 - class * 17) * 256 + 90 AS rgb, class + 1 AS class FROM (SELECT class FROM {grid_class} WHERE class BETWEEN 1 AND 11) t WHERE class % 5 <> 0",
    "map_pixels": """SELECT CAST(floor(r / 16.0) AS BIGINT) * 4 + CAST(floor(c / 16.0) AS BIGINT) AS tile, r, c, CASE WHEN (r * 7 + c * 3) % 10 = 0 OR r % 16 BETWEEN 5 AND 7 AND c % 16 > 8 THEN 100 * 65536 + 103 * 256 + 101 WHEN (r * 7 + c * 3) % 10 = 1 THEN (k * 20 + 10) * 65536 + (255 - k * 17 - 12) * 256 + 95 WHEN (r * 7 + c * 3) % 10 = 2 THEN 250 * 65536 + 10 * 256 + 250
          ELSE k * 20 * 65536 + (255 - k * 17) * 256 + 90 END AS rgb, CASE WHEN (r + c) % 23 = 0 THEN 0 ELSE 255 END AS alpha
        FROM (SELECT g.r, g.c, (CAST(floor(g.r / 4.0) AS BIGINT) * 5 + CAST(floor(g.c / 4.0) AS BIGINT) * 3 + CAST(floor(g.r / 16.0) AS BIGINT)) % 11 + 1 AS k FROM {grid_class} g) t""",
}
# Footprints cut at tiles of 5,000 units, every other row of tiles in two, so that corners of one piece lie on edges of its neighbour.
_PARTS = "(VALUES " + ", ".join(f"({i}, {j})" for i in range(6) for j in range(12)) + ") v(i, j)"
SQL |= {
    "cut_footprints": f"""SELECT id, flat, floors, s, n, w, e FROM (SELECT id, flat, floors, greatest(s0, ty * 5000) AS s, least(n0, ty * 5000 + 5000) AS n, greatest(w0, tx * half) AS w, least(e0, tx * half + half) AS e FROM (
        SELECT *, y0 + i AS ty, CASE WHEN (y0 + i) % 2 = 0 THEN 5000 ELSE 2500 END AS half, CAST(floor(w0 / CASE WHEN (y0 + i) % 2 = 0 THEN 5000.0 ELSE 2500.0 END) AS BIGINT) + j AS tx
        FROM (SELECT reg_id AS id, flat, floors, lat_e7 - half_lat AS s0, lat_e7 + half_lat AS n0, lon_e7 - half_lon AS w0, lon_e7 + half_lon AS e0, CAST(floor((lat_e7 - half_lat) / 5000.0) AS BIGINT) AS y0 FROM {{registry}}) r CROSS JOIN {_PARTS}) c) d WHERE s < n AND w < e""",
}
# Pixels of three zooms of tiles of 8: the finest lacks some tiles and holds wrong values in others, the next lacks some.
SQL["zoom_pixels"] = """SELECT 3 AS z, r, c, CASE WHEN (tr + tc) % 11 = 0 AND r % 8 = 0 AND c % 8 = 0 THEN 99999.0 ELSE v END AS value FROM (SELECT r, c, CAST(coalesce(value, 0) AS DOUBLE) AS v, CAST(floor(r / 8.0) AS BIGINT) AS tr, CAST(floor(c / 8.0) AS BIGINT) AS tc FROM {grid}) a WHERE (tr * 5 + tc * 3) % 7 <> 0
    UNION ALL SELECT 2, CAST(floor(r / 2.0) AS BIGINT), CAST(floor(c / 2.0) AS BIGINT), CAST(coalesce(value, 0) + 100 AS DOUBLE) FROM {grid} WHERE r % 2 = 0 AND c % 2 = 0 AND CAST(floor(r / 16.0) + floor(c / 16.0) AS BIGINT) % 3 <> 0
    UNION ALL SELECT 1, CAST(floor(r / 4.0) AS BIGINT), CAST(floor(c / 4.0) AS BIGINT), CAST(coalesce(value, 0) + 200 AS DOUBLE) FROM {grid} WHERE r % 4 = 0 AND c % 4 = 0"""
# Bores along ways: a first and a second piece that meet (or miss by height, or lack the second), the other tube, one across, one that forks off.
SQL |= {
    "bores": """SELECT way_id * 10 + 1 AS bore_id, seq, lat_e7 + 120 AS lat_e7, lon_e7 + 90 AS lon_e7, CAST(10 + seq AS DOUBLE) AS z FROM {way_points} WHERE seq <= 3
        UNION ALL SELECT way_id * 10 + 2, seq, lat_e7 + 130, lon_e7 + 100, CAST(10 + seq + CASE way_id % 3 WHEN 1 THEN 1 ELSE 5 END AS DOUBLE) FROM {way_points} WHERE seq >= 3 AND way_id % 3 <> 0
        UNION ALL SELECT way_id * 10 + 3, seq, lat_e7 + 450, lon_e7 + 450, CASE WHEN way_id % 7 = 0 AND seq = 2 THEN NULL ELSE CAST(40 AS DOUBLE) END FROM {way_points} WHERE way_id % 4 <> 2
        UNION ALL SELECT way_id * 10 + 4, seq, lat_e7 + CASE WHEN way_id % 4 = 0 THEN seq * 900 ELSE 0 END, lon_e7 - CASE WHEN way_id % 4 = 0 THEN 0 ELSE seq * 1500 END, CAST(20 AS DOUBLE) FROM {way_points} WHERE way_id % 2 = 0 AND seq <= 2
        UNION ALL SELECT way_id * 10 + 5, CAST(seq + 10 AS BIGINT), lat_e7 + 125 + CASE WHEN seq = 4 THEN 400 ELSE 0 END, lon_e7 + 95, CAST(9 + seq AS DOUBLE) FROM {way_points} WHERE way_id % 5 = 0 AND seq BETWEEN 3 AND 4""",
}
# Buildings with an axis, and a surface round each: flat, gabled (along or across), hipped or uneven, with noise and holes.
SQL |= {
    "axis_buildings": """SELECT id, id * 64.0 + 32.25 AS cy, 32.75 AS cx, CASE id % 3 WHEN 0 THEN 0.6 WHEN 1 THEN 1.0 ELSE 0.8 END AS ay, CASE id % 3 WHEN 0 THEN 0.8 WHEN 1 THEN 0.0 ELSE -0.6 END AS ax,
        CAST(2 + size % 10 AS DOUBLE) + 0.5 AS half_a, CAST(2 + size % 6 AS DOUBLE) AS half_b, CAST(100 + id % 50 AS DOUBLE) AS base, CASE WHEN id % 11 = 0 THEN 1 ELSE CAST(4 + size % 8 AS BIGINT) END AS eave, CAST(id % 6 AS INT) AS kind FROM {buildings}""",
    "surface": """SELECT r, c, CASE WHEN (r * 11 + c * 5) % 13 = 0 OR (id % 17 = 0 AND c % 5 <> 0) THEN NULL ELSE base + eave + (r * 7 + c * 3) % 5 / 20.0 + CASE kind WHEN 0 THEN 0.0 WHEN 1 THEN 4.0 * greatest(1 - abs(v) / half_b, 0.0) WHEN 2 THEN 4.0 * greatest(least(1 - abs(v) / half_b, 1.5 - 1.5 * abs(u) / half_a), 0.0)
          WHEN 3 THEN 5.0 * greatest(1 - abs(u) / half_a, 0.0) WHEN 4 THEN CAST((r * 5 + c * 11) % 7 AS DOUBLE) ELSE 3.0 * CASE WHEN v > 0 THEN 1 ELSE 0 END END END AS value
        FROM (SELECT *, (r + 0.5 - cy) * ay + (c + 0.5 - cx) * ax AS u, (r + 0.5 - cy) * ax - (c + 0.5 - cx) * ay AS v FROM (SELECT b.*, CAST(floor(cy) AS BIGINT) - 14 + i.k AS r, CAST(floor(cx) AS BIGINT) - 14 + j.k AS c
          FROM {axis_buildings} b CROSS JOIN (VALUES NUMBERS) i(k) CROSS JOIN (VALUES NUMBERS) j(k)) p) q""".replace("NUMBERS", ", ".join(f"({k})" for k in range(29))),
}
SQL["grid"] = "SELECT CAST(vec_id AS BIGINT) AS r, CAST(c AS BIGINT) AS c, CASE WHEN (vec_id * 7 + c * 3) % 11 = 0 THEN NULL ELSE CAST(floor(CAST(e AS DOUBLE) * 1000) AS BIGINT) END AS value FROM (SELECT vec_id, posexplode(embedding) AS (c, e) FROM {embeddings}) t"
# Bodies of water with 3 to 99 shore vertices over the grid; every ninth lies off it, every seventh has its middle there only.
SQL |= {
    "water_bodies": """SELECT lake_id AS area_id, CASE lake_id % 9 WHEN 0 THEN 'lake' WHEN 1 THEN 'reservoir' WHEN 2 THEN 'pond' WHEN 3 THEN 'river' WHEN 4 THEN 'basin' WHEN 5 THEN 'swimming_pool' WHEN 6 THEN 'stream' WHEN 7 THEN 'sea' ELSE 'lake' END AS kind,
        lake_id % 10 = 3 AS tidal, (half_lat * 2 / 90.0) * (half_lon * 2 / 180.0) * (1 + lake_id % 4 * 3) AS area_m2, CAST(lake_id * 3 % 200 + CASE WHEN lake_id % 9 = 8 AND lake_id % 2 = 0 THEN -1000 ELSE 0 END AS DOUBLE) + 0.5 AS mid_r, CAST(lake_id * 11 % 64 AS DOUBLE) + 0.5 AS mid_c FROM {lakes}""",
    "water_shores": """SELECT lake_id AS area_id, CAST(10 * a.k + b.k AS BIGINT) AS seq, CAST(lake_id * 3 % 200 + (10 * a.k + b.k) % 7 + CASE WHEN lake_id % 9 = 8 OR lake_id % 7 = 2 THEN -1000 ELSE 0 END AS DOUBLE) + 0.25 AS r, CAST((lake_id + (10 * a.k + b.k) * 5) % 64 AS DOUBLE) + 0.75 AS c
        FROM {lakes} CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) a(k) CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7), (8), (9)) b(k) WHERE 10 * a.k + b.k < 3 + lake_id * 37 % 97""",
}
DUCK: dict[str, str] = {
    "grid": SQL["grid"].replace("(SELECT vec_id, posexplode(embedding) AS (c, e) FROM {embeddings})", "(SELECT vec_id, unnest(range(len(embedding))) AS c, unnest(embedding) AS e FROM {embeddings})"),
}
for name in ("grid_class",):
    SQL[name] = "SELECT r, c, CASE WHEN value IS NULL THEN 0 ELSE CAST(floor((value + 600) / 100.0) AS BIGINT) END AS class FROM {grid}"


#: Tables whose texts make many rows of one, so that what they read is spread first; of SPREAD the rows are made many by the queries.
MULTIPLIED, SPREAD = {"surface", "coast_cells", "coast_lines", "cut_footprints", "water_shores"}, {"selection_shapes"}
#: Rows of a spread table that one task takes, about.
SPREAD_ROWS = 10_000


def spread(df: DataFrame) -> DataFrame:
    """`df` dealt by its first column over tasks of SPREAD_ROWS rows: a small file is one task, and so is all that comes of its rows."""
    return df.repartition(tasks_for(df, SPREAD_ROWS), df.columns[0])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one derived from them by its text."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = SQL[name]
    inputs = {n: table(spark, sf_dir, n) for n in sorted(set(re.findall(r"\{([a-z]\w+)\}", text)))}
    made = spark.sql(text, **({n: spread(df) for n, df in inputs.items()} if name in MULTIPLIED else inputs))
    return spread(made) if name in SPREAD else made


def oracle(body: str) -> str:
    """DuckDB SQL of a body that names derived tables in braces; the body may begin with its own WITH."""
    found: dict[str, str] = {}

    def need(text: str) -> None:
        for n in re.findall(r"\{([a-z]\w+)\}", text):
            if n not in TABLES and n not in found:
                inner = DUCK.get(n, SQL[n])
                need(inner)
                found[n] = inner

    need(body)
    plain = lambda text: re.sub(r"\{([a-z]\w+)\}", lambda m: m[1], text)
    ctes = ", ".join(f"{n} AS MATERIALIZED ({plain(t)})" for n, t in found.items())
    body = plain(body).strip()
    if not ctes:
        return body
    if body.startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes}, {body[15:]}"
    return f"WITH {ctes}, {body[5:]}" if body.upper().startswith("WITH ") else f"WITH {ctes} {body}"
