"""Queries on coasts, zooms and blends of rasters."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import coast, dissolve, legends, pyramids
from geoloom.plans.register import query

_CLIP = """p AS (SELECT s.*, CAST(floor(least(ay, ey)) AS BIGINT) + i AS r, CAST(floor(least(ax, ex)) AS BIGINT) + j AS c FROM {coast_lines} s, range(20) y(i), range(20) x(j) WHERE floor(least(ay, ey)) + i <= greatest(ay, ey) AND floor(least(ax, ex)) + j <= greatest(ax, ex)),
    q AS (SELECT *, CASE WHEN ey = ay THEN 0 ELSE least((r - ay) / (ey - ay), (r + 1 - ay) / (ey - ay)) END AS y0, CASE WHEN ey = ay THEN 1 ELSE greatest((r - ay) / (ey - ay), (r + 1 - ay) / (ey - ay)) END AS y1,
      CASE WHEN ex = ax THEN 0 ELSE least((c - ax) / (ex - ax), (c + 1 - ax) / (ex - ax)) END AS x0, CASE WHEN ex = ax THEN 1 ELSE greatest((c - ax) / (ex - ax), (c + 1 - ax) / (ex - ax)) END AS x1 FROM p),
    k AS (SELECT *, (r - ay) / (ey - ay) AS t FROM p WHERE ey <> ay AND ex <> ax AND r > least(ay, ey) AND c > least(ax, ex)),
    edge AS MATERIALIZED (SELECT r, c FROM q WHERE least(y1, x1, 1.0) - greatest(y0, x0, 0.0) > 1e-9 UNION SELECT CASE WHEN ey > ay THEN r - 1 ELSE r END, CASE WHEN ex > ax THEN c ELSE c - 1 END FROM k WHERE abs(ax + t * (ex - ax) - c) < 1e-9)"""


def _coast(read):
    return read("coast_lines").select("ay", "ax", F.col("ey").alias("by"), F.col("ex").alias("bx"))


@query("ag21_thin_line_cells", f"WITH {_CLIP} SELECT r, c FROM edge")
def thin(read):
    """AG-21: all cells that a line passes through, joined side to side."""
    return coast.line_cells(_coast(read))


@query(
    "ag09_coast_vote",
    f"""WITH RECURSIVE {_CLIP}, free AS MATERIALIZED (SELECT *, CAST(floor(r / 20.0) AS BIGINT) AS k, (r % 20) * 16 + c AS n FROM {{coast_cells}} a WHERE NOT EXISTS (SELECT 1 FROM edge e WHERE e.r = a.r AND e.c = a.c)),
    e AS MATERIALIZED (SELECT a.k, a.n AS a, b.n AS b FROM free a JOIN free b ON a.k = b.k AND abs(a.r - b.r) + abs(a.c - b.c) = 1),
    reach(k, n, piece) AS (SELECT k, n, n FROM free WHERE n % 16 = 0 OR n % 16 = 7 OR NOT EXISTS (SELECT 1 FROM e WHERE e.k = free.k AND e.b = free.n AND e.a = free.n - 1) UNION SELECT w.k, e.b, piece FROM reach w JOIN e ON e.k = w.k AND e.a = w.n),
    label AS MATERIALIZED (SELECT k, n, min(piece) AS piece FROM reach GROUP BY 1, 2),
    l AS (SELECT *, sqrt((ey - ay) ** 2 + (ex - ax) ** 2) AS len FROM {{coast_lines}}), m AS (SELECT *, greatest(floor(len / 2.0), 1) AS n FROM l), s AS (SELECT *, unnest(range(CAST(n AS BIGINT) + 1)) / n AS t FROM m),
    v AS (SELECT CAST(floor(ay + (ey - ay) * t + sign * ((ex - ax) / len * 1.6)) AS BIGINT) AS r, CAST(floor(ax + (ex - ax) * t + sign * (-(ey - ay) / len * 1.6)) AS BIGINT) AS c, sign FROM s, (VALUES (1), (-1)) g(sign)),
    o AS (SELECT k, piece, sum(sign) AS lead FROM v JOIN free USING (r, c) JOIN label USING (k, n) GROUP BY 1, 2)
    SELECT r, c, CASE WHEN coalesce(lead, 0) = 0 THEN coalesce(elevation < 0, false) ELSE lead > 0 END AS sea FROM free JOIN label USING (k, n) LEFT JOIN o USING (k, piece) UNION ALL SELECT r, c, true FROM {{coast_cells}} JOIN edge USING (r, c)""",
)
def coast_vote(read):
    """AG-09: land and sea by votes on either side of the coastline, piece by piece; ties by elevation."""
    return coast.sea_cells(read("coast_cells"), _coast(read))


def _up(z: int, below: str, missing: str, columns: int) -> str:
    """Pixels of missing tiles, bilinear from the zoom below."""
    return f"""SELECT tr, tc, t.r, t.c, sum(w * coalesce(a.value, b.value)) AS value FROM (
      SELECT tr, tc, r, c, y0 + dy AS py, (x0 + dx + {columns}) % {columns} AS px, least(greatest(y0 + dy, floor(tr / 2.0) * 8), floor(tr / 2.0) * 8 + 7) AS ey, least(greatest(x0 + dx, floor(tc / 2.0) * 8), floor(tc / 2.0) * 8 + 7) AS ex, y0 + dy AS qy, x0 + dx AS qx,
        CASE WHEN dy = 1 THEN fy ELSE 1 - fy END * CASE WHEN dx = 1 THEN fx ELSE 1 - fx END AS w
      FROM (SELECT *, CAST(floor((r + 0.5) / 2 - 0.5) AS BIGINT) AS y0, CAST(floor((c + 0.5) / 2 - 0.5) AS BIGINT) AS x0, (r + 0.5) / 2 - 0.5 - floor((r + 0.5) / 2 - 0.5) AS fy, (c + 0.5) / 2 - 0.5 - floor((c + 0.5) / 2 - 0.5) AS fx FROM (SELECT tr, tc, tr * 8 + i AS r, tc * 8 + j AS c FROM {missing}, range(8) y(i), range(8) x(j))), range(2) p(dy), range(2) q(dx)) t
      LEFT JOIN {below} a ON a.r = py AND a.c = px LEFT JOIN {below} b ON a.value IS NULL AND b.r = ey AND b.c = ex AND (ey <> qy OR ex <> qx) GROUP BY 1, 2, 3, 4 HAVING count(coalesce(a.value, b.value)) = 4"""


@query(
    "jn31_finest_ancestor",
    f"""WITH t AS (SELECT *, CAST(floor(r / 8.0) AS BIGINT) AS tr, CAST(floor(c / 8.0) AS BIGINT) AS tc FROM {{zoom_pixels}}), good AS MATERIALIZED (SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.z = t.z AND b.tr = t.tr AND b.tc = t.tc AND b.value NOT BETWEEN -9000 AND 9000)),
    w3 AS (SELECT DISTINCT CAST(floor(r / 8.0) AS BIGINT) AS tr, CAST(floor(c / 8.0) AS BIGINT) AS tc FROM {{grid}}), w2 AS (SELECT DISTINCT CAST(floor(tr / 2.0) AS BIGINT) + d AS tr, e AS tc FROM w3, range(-1, 2) a(d), range(4) b(e)),
    m3 AS (SELECT * FROM w3 WHERE NOT EXISTS (SELECT 1 FROM good g WHERE z = 3 AND g.tr = w3.tr AND g.tc = w3.tc)), m2 AS (SELECT * FROM w2 WHERE tr >= 0 AND NOT EXISTS (SELECT 1 FROM good g WHERE z = 2 AND g.tr = w2.tr AND g.tc = w2.tc)),
    f1 AS MATERIALIZED (SELECT r, c, value FROM good WHERE z = 1), u2 AS ({_up(2, "f1", "m2", 16)}), f2 AS MATERIALIZED (SELECT r, c, value, 2 AS z FROM good WHERE z = 2 UNION ALL SELECT r, c, value, 1 FROM u2), u3 AS ({_up(3, "f2", "m3", 32)})
    SELECT r, c, CAST(round(value * 256) AS BIGINT) AS value, z FROM good WHERE z = 3 UNION ALL SELECT r, c, CAST(round(value * 256) AS BIGINT), CASE WHEN EXISTS (SELECT 1 FROM good g WHERE g.z = 2 AND g.tr = CAST(floor(u3.tr / 2.0) AS BIGINT) AND g.tc = CAST(floor(u3.tc / 2.0) AS BIGINT)) THEN 2 ELSE 1 END FROM u3""",
)
def ancestors(read):
    """JN-31: every pixel of the finest zoom; tiles that lack or can't be right are made from their parents, across the parents' seams (in 256ths, which are exact)."""
    wanted = read("grid").select(F.floor(F.col("r") / 8).alias("tr"), F.floor(F.col("c") / 8).alias("tc"))
    return pyramids.finest(read("zoom_pixels"), wanted, 3, 1, 8, -9000.0, 9000.0, 64).withColumn("value", F.round(F.col("value") * 256).cast("bigint"))


@query(
    "jn32_feathered_blend",
    """WITH t AS (SELECT r, c, value / 100.0 AS m, CASE WHEN (r + c) % 9 <> 0 THEN value / 100.0 + 3 END AS g, CAST(floor(r / 16.0) AS BIGINT) AS tr, CAST(floor(c / 16.0) AS BIGINT) AS tc FROM {grid} WHERE value IS NOT NULL),
    s AS (SELECT DISTINCT tr, tc FROM t WHERE (tr * 3 + tc) % 5 = 0),
    n AS (SELECT p.tr, p.tc, p.tr + d AS sr, p.tc + e AS sc FROM (SELECT DISTINCT tr, tc FROM t) p, range(-2, 3) a(d), range(-2, 3) b(e) WHERE EXISTS (SELECT 1 FROM s WHERE s.tr = p.tr + d AND s.tc = (p.tc + e + 4) % 4)),
    f AS (SELECT r, c, any_value(m) AS m, any_value(g) AS g, min(greatest(sc - (c + 0.5) / 16, (c + 0.5) / 16 - (sc + 1), 0.0) ** 2 + greatest(sr - (r + 0.5) / 16, (r + 0.5) / 16 - (sr + 1), 0.0) ** 2) AS d2 FROM t LEFT JOIN n USING (tr, tc) GROUP BY 1, 2),
    w AS (SELECT *, coalesce(least(1.0, sqrt(d2) * 200.0 / 400.0), 1.0) AS t FROM f)
    SELECT r, c, round(CASE WHEN abs(m) <= 0.5 OR g IS NULL OR t <= 0 THEN m WHEN m > 0.5 THEN greatest(m + t * t * (3 - 2 * t) * (g - m), 0.51) ELSE m + t * t * (3 - 2 * t) * (g - m) END, 5) AS value FROM w""",
)
def blend(read):
    """JN-32: drawn towards a model by distance from the nearest surveyed tile, round the globe; near-zero kept, land stays land."""
    g = read("grid").where("value is not null")
    pixels = g.select("r", "c", (F.col("value") / 100.0).alias("value"))
    tiles = g.select(F.floor(F.col("r") / 16).alias("tr"), F.floor(F.col("c") / 16).alias("tc")).distinct()
    model = g.where("(r + c) % 9 <> 0").select("r", "c", (F.col("value") / 100.0 + 3).alias("model"))
    return pyramids.feathered(pixels, tiles.where("(tr * 3 + tc) % 5 = 0"), model, 16, 200.0, 4, rings=2).withColumn("value", F.round("value", 5))


_RGB = lambda c: (f"(({c} >> 16) & 255)", f"(({c} >> 8) & 255)", f"({c} & 255)")
_SPREAD = "abs({0} - {1}) < 6 AND abs({1} - {2}) < 6 AND abs({0} - {2}) < 6".format(*_RGB("rgb"))
_D2 = " + ".join(f"({a} - {b}) ** 2" for a, b in zip(_RGB("u.rgb"), _RGB("l.rgb"), strict=True))
_ROUND = """w{n} AS (SELECT tile, r, c, min(class) AS class FROM (SELECT u.tile, u.r, u.c, p.class, count(*) AS v, max(count(*)) OVER (PARTITION BY u.tile, u.r, u.c) AS most FROM s{m} u JOIN s{m} p ON p.tile = u.tile AND p.class IS NOT NULL AND u.class IS NULL AND p.r BETWEEN u.r - 1 AND u.r + 1 AND p.c BETWEEN u.c - 1 AND u.c + 1 GROUP BY 1, 2, 3, 4) WHERE v = most GROUP BY 1, 2, 3),
    s{n} AS MATERIALIZED (SELECT s.tile, s.r, s.c, coalesce(s.class, w.class) AS class FROM s{m} s LEFT JOIN w{n} w USING (tile, r, c))"""


@query(
    "jn52_legend_colours",
    f"""WITH q AS MATERIALIZED (SELECT *, {_SPREAD} AS grey FROM {{map_pixels}} WHERE alpha >= 128), l AS (SELECT DISTINCT q.tile, q.rgb, m.class FROM q JOIN {{map_legend}} m USING (rgb) WHERE NOT grey),
    u AS (SELECT DISTINCT tile, rgb FROM q WHERE NOT grey AND rgb NOT IN (SELECT rgb FROM {{map_legend}})), n AS (SELECT u.tile, u.rgb, min_by(l.class, ({_D2}, l.rgb)) AS class FROM u JOIN l ON l.tile = u.tile WHERE {_D2} < 3600 GROUP BY 1, 2),
    k AS (SELECT * FROM l UNION ALL SELECT * FROM n), s0 AS MATERIALIZED (SELECT q.tile, r, c, class FROM q LEFT JOIN k ON k.tile = q.tile AND k.rgb = q.rgb AND NOT grey),
    {", ".join(_ROUND.format(n=n, m=n - 1) for n in range(1, 9))}
    SELECT tile, r, c, coalesce(class, 0) AS class FROM s8 UNION ALL SELECT tile, r, c, 0 FROM {{map_pixels}} WHERE alpha < 128""",
)
def legend(read):
    """JN-52: classes by exact colour, by the nearest colour of the tile, and for lines and labels by the pixels around."""
    return legends.classify(read("map_pixels"), read("map_legend"))


@query("ud07_cells_of", "SELECT shape_order, CAST(z AS INTEGER) AS z, CAST(x AS INTEGER) AS x FROM (SELECT shape_order, x, unnest(range(z0, z1)) AS z FROM (SELECT *, unnest(range(x0, x1)) AS x FROM {selection_shapes}))")
def cells_of(read):
    """UD-07: the cells of each shape by a table function in SQL."""
    from geoloom.functions import tables

    shapes = read("selection_shapes")
    tables.register(shapes.sparkSession)
    return shapes.sparkSession.sql("SELECT s.shape_order, c.z, c.x FROM {shapes} s, LATERAL cells_of(array(z0, z0, z1, z1), array(x0, x1, x1, x0)) c", shapes=shapes)


@query(
    "ag30_pieces_merged",
    """WITH p AS (SELECT id, count(*) AS pieces FROM {cut_footprints} GROUP BY 1)
    SELECT reg_id AS id, pieces, 1 AS rings, CAST(8 * half_lat * half_lon AS BIGINT) AS area, flat, floors, lat_e7 - half_lat AS south, lat_e7 + half_lat AS north FROM {registry} JOIN p ON id = reg_id""",
)
def merged(read):
    """AG-30: footprints cut at tile borders, put together again: rings and twice the area are those of the whole."""
    cut = read("cut_footprints")
    edge = lambda a, b, c, d: F.struct(F.col(a).alias("ay"), F.col(b).alias("ax"), F.col(c).alias("by"), F.col(d).alias("bx"))
    edges = cut.select("id", F.inline(F.array(edge("s", "w", "s", "e"), edge("s", "e", "n", "e"), edge("n", "e", "n", "w"), edge("n", "w", "s", "w"))))
    rings = dissolve.dissolve(edges, "id", 2500)
    sides = rings.groupBy("id").agg(F.min("y").alias("south"), F.max("y").alias("north"))
    areas = dissolve.ring_areas(rings, "id").groupBy("id").agg(F.count("*").cast("int").alias("rings"), F.sum("area").alias("area"))
    facts = cut.groupBy("id").agg(F.count("*").alias("pieces"), F.bool_or("flat").alias("flat"), F.max("floors").alias("floors"))
    return facts.join(areas, "id").join(sides, "id").select("id", "pieces", "rings", "area", "flat", "floors", "south", "north")
