"""Queries over rasters in long form."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import grids
from geoloom.plans.register import query

_POINTS = "pts AS (SELECT r * 100 + c AS k, r + 0.37 AS y, c + 0.21 AS x, r, c FROM {grid})"


def _points(read):
    return read("grid").select((F.col("r") * 100 + F.col("c")).alias("k"), (F.col("r") + 0.37).alias("y"), (F.col("c") + 0.21).alias("x"), "r", "c")


@query("ag01_mode_pooling", """WITH v AS (SELECT CAST(floor(r / 4.0) AS BIGINT) AS r, CAST(floor(c / 4.0) AS BIGINT) AS c, class, count(*) AS n FROM {grid_class} GROUP BY 1, 2, 3)
    SELECT r, c, coalesce(max_by(class, (n, -class)) FILTER (class > 0), 0) AS class FROM v GROUP BY r, c""")
def mode_pooling(read):
    """AG-01: most common class of 4 x 4 blocks."""
    return grids.pool_mode(read("grid_class"), 4)


@query("ag02_masked_mean_pooling", "SELECT CAST(floor(r / 4.0) AS BIGINT) AS r, CAST(floor(c / 4.0) AS BIGINT) AS c, round(avg(CASE WHEN value > -300 THEN value + 0.0065 * (r * 3) END), 8) AS mean, count(CASE WHEN value > -300 THEN 1 END) AS n FROM {grid} GROUP BY 1, 2")
def mean_pooling(read):
    """AG-02: mean over land pixels with a lapse correction before it."""
    v = F.when(F.col("value") > -300, F.col("value") + 0.0065 * (F.col("r") * 3))
    return grids.pool_mean(read("grid"), 4, v).withColumn("mean", F.round("mean", 8))


@query("ag03_filled_mean_pooling", "SELECT CAST(floor(r / 8.0) AS BIGINT) AS r, CAST(floor(c / 8.0) AS BIGINT) AS c, round(sum(coalesce(value, 0)) / 64.0, 4) AS mean FROM {grid} GROUP BY 1, 2 HAVING max(coalesce(value, 0)) > 0")
def filled_pooling(read):
    """AG-03: mean with no-data as 0, empty blocks left out."""
    return grids.pool_filled(read("grid"), 8).withColumn("mean", F.round("mean", 4))


@query("ag04_pyramid_level", "SELECT CAST(floor(r / 8.0) AS BIGINT) AS r, CAST(floor(c / 8.0) AS BIGINT) AS c, CAST(greatest(floor((sum(value) + floor(count(*) / 2.0)) / count(*)), 1) AS BIGINT) AS value FROM {grid} WHERE value > 0 GROUP BY 1, 2")
def pyramid(read):
    """AG-04: integer average of the drawn pixels of 8 x 8 blocks."""
    return grids.pyramid_level(read("grid"), 3).withColumn("value", F.col("value").cast("bigint"))


_HOLED = "holed AS (SELECT r, c, CASE WHEN (CAST(floor(r / 5.0) AS BIGINT) + CAST(floor(c / 5.0) AS BIGINT)) % 4 <> 0 AND (r < 20 OR r > 29 OR c > 15) THEN value END AS value FROM {grid})"


@query("jn26_bilinear", f"""WITH {_POINTS}, {_HOLED}, n AS (SELECT k, g.value, (CASE WHEN dr = 1 THEN y - p.r ELSE 1 - (y - p.r) END) * (CASE WHEN dc = 1 THEN x - p.c ELSE 1 - (x - p.c) END) AS w FROM pts p, range(2) a(dr), range(2) b(dc), holed g WHERE g.r = p.r + dr AND g.c = p.c + dc AND g.value IS NOT NULL),
    f AS (SELECT k, sum(w * value) / sum(w) AS v FROM n GROUP BY k HAVING sum(w) > 1e-6),
    h AS (SELECT k, min_by(g.value, (greatest(abs(a), abs(b)), a, b)) AS v FROM pts p, range(-3, 4) q(a), range(-3, 4) s(b), holed g WHERE g.r = p.r + a AND g.c = p.c + b AND g.value IS NOT NULL GROUP BY k)
    SELECT k, round(coalesce(f.v, h.v), 4) AS value FROM pts LEFT JOIN f USING (k) LEFT JOIN h USING (k)""")
def bilinear(read):
    """JN-26: four pixels, the weights of those present renormalised; in holes the nearest within three rings."""
    block = F.floor(F.col("r") / 5) + F.floor(F.col("c") / 5)
    there = (block % 4 != 0) & ((F.col("r") < 20) | (F.col("r") > 29) | (F.col("c") > 15))
    holed = read("grid").select("r", "c", F.when(there, F.col("value")).alias("value"))
    return grids.bilinear(_points(read), holed, "k").withColumn("value", F.round("value", 4))


def _cubic(t, d):
    return f"CASE {d} WHEN -1 THEN ((2 - {t}) * {t} - 1) * {t} / 2 WHEN 0 THEN ({t} * {t} * (3 * {t} - 5) + 2) / 2 WHEN 1 THEN ((4 - 3 * {t}) * {t} + 1) * {t} / 2 ELSE ({t} - 1) * {t} * {t} / 2 END"


@query("jn27_bicubic", f"""WITH {_POINTS}, d AS (SELECT unnest(range(-1, 3)) AS d), n AS (SELECT k, g.value, ({_cubic("(x - p.c)", "b.d")}) * ({_cubic("(y - p.r)", "a.d")}) AS w
      FROM pts p, d a, d b, {{grid}} g WHERE g.r = least(greatest(p.r + a.d, 0), (SELECT max(r) FROM {{grid}})) AND g.c = (p.c + b.d + 64) % 64 AND g.value IS NOT NULL)
    SELECT k, round(v, 4) AS value FROM pts LEFT JOIN (SELECT k, sum(w * value) AS v FROM n GROUP BY k HAVING count(*) = 16) USING (k)""")
def bicubic(read):
    """JN-27: sixteen pixels with Catmull-Rom weights, columns wrapping round."""
    height = read("grid").agg(F.max("r")).first()[0] + 1
    return grids.bicubic(_points(read), read("grid"), "k", 64, height).withColumn("value", F.round("value", 4))


@query("jn25_pixel_at_point", f"WITH {_POINTS} SELECT k, class FROM pts p JOIN {{grid_class}} g ON g.r = p.r AND g.c = p.c")
def pixel(read):
    """JN-25: the class of the pixel that holds a point."""
    return _points(read).join(read("grid_class"), ["r", "c"]).select("k", "class")


@query("jn28_nearest_class", f"""WITH {_POINTS}, q AS MATERIALIZED (SELECT k, r + a AS rr, c + b AS cc, a, b FROM pts, range(-5, 6) x(a), range(-5, 6) y(b)), h AS (SELECT k, class, greatest(abs(a), abs(b)) AS ring, a, b FROM q JOIN {{grid_class}} g ON g.r = rr AND g.c = cc WHERE class > 5)
    SELECT k, class FROM pts LEFT JOIN (SELECT k, min_by(class, (ring, a, b)) AS class FROM h GROUP BY k) USING (k)""")
def nearest_class(read):
    """JN-28: the nearest pixel of a class above 5 within five rings."""
    return grids.nearest_class(_points(read), read("grid_class").where("class > 5"), "k", 5)


@query("ag17_majority_filter", """WITH n AS (SELECT a.r, a.c, b.class, count(*) AS n FROM {grid_class} a JOIN {grid_class} b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 WHERE a.class <> 0 GROUP BY 1, 2, 3)
    SELECT r, c, max_by(class, (n, -class)) AS class FROM n GROUP BY r, c""")
def majority(read):
    """AG-17: 3 x 3 vote of classified pixels."""
    return grids.majority3(read("grid_class"))


@query("ag18_stand_type", """WITH n AS (SELECT a.r, a.c, sum(CASE WHEN b.class IN (4, 5) THEN 1 ELSE 0 END) AS needle, sum(CASE WHEN b.class IN (6, 7) THEN 1 ELSE 0 END) AS broad FROM {grid_class} a JOIN {grid_class} b ON b.r BETWEEN a.r - 1 AND a.r + 1 AND b.c BETWEEN a.c - 1 AND a.c + 1 GROUP BY 1, 2)
    SELECT r, c, CASE WHEN needle + broad = 0 THEN 'unknown' WHEN needle >= 2 * broad THEN 'conifer' WHEN broad >= 2 * needle THEN 'broad' ELSE 'mixed' END AS stand FROM n""")
def stand_type(read):
    """AG-18: conifer, broad or mixed by 3 x 3 counts."""
    g = read("grid_class")
    near = grids.offsets(g.select("r", "c"), grids.square(1)).join(g.select(F.col("r").alias("pr"), F.col("c").alias("pc"), "class").hint("merge"), ["pr", "pc"])
    n = near.groupBy("r", "c").agg(F.sum(F.col("class").isin(4, 5).cast("int")).alias("needle"), F.sum(F.col("class").isin(6, 7).cast("int")).alias("broad"))
    stand = F.when(F.col("needle") + F.col("broad") == 0, "unknown").when(F.col("needle") >= 2 * F.col("broad"), "conifer").when(F.col("broad") >= 2 * F.col("needle"), "broad").otherwise("mixed")
    return n.select("r", "c", stand.alias("stand"))


@query("ag27_local_maxima", """WITH t AS (SELECT r, c, value, least(greatest(CAST(floor(value / 30.0 / 3 + 0.5) AS BIGINT), 1), 4) AS rad FROM {grid} WHERE value BETWEEN 75 AND 600),
    m AS (SELECT t.r, t.c, t.value, sum(CASE WHEN g.value > t.value OR (g.value = t.value AND (g.r < t.r OR (g.r = t.r AND g.c < t.c))) THEN 1 ELSE 0 END) AS beaten, sum(CASE WHEN abs(g.r - t.r) <= 1 AND abs(g.c - t.c) <= 1 AND g.value >= 0.4 * t.value THEN 1 ELSE 0 END) AS company
      FROM t JOIN {grid} g ON g.r BETWEEN t.r - 4 AND t.r + 4 AND g.c BETWEEN t.c - 4 AND t.c + 4 AND abs(g.r - t.r) <= rad AND abs(g.c - t.c) <= rad AND NOT (g.r = t.r AND g.c = t.c) AND g.value IS NOT NULL GROUP BY 1, 2, 3)
    SELECT r, c, value FROM m WHERE beaten = 0 AND company >= 3""")
def maxima(read):
    """AG-27: local maxima within a radius that follows the height."""
    return grids.local_maxima(read("grid"), 75, 600, 30.0)


@query("wn12_ag29_slopes", """WITH d AS (SELECT r, c, value, (coalesce(lead(value) OVER a, value) - coalesce(lag(value) OVER a, value)) / 2.0 AS dx, (coalesce(lead(value) OVER b, value) - coalesce(lag(value) OVER b, value)) / 2.0 AS dy FROM {grid} WINDOW a AS (PARTITION BY r ORDER BY c), b AS (PARTITION BY c ORDER BY r))
    SELECT r, c, dx, dy, round(least(greatest((1 - (dx + dy) * 0.01) / sqrt(1 + (dx * dx + dy * dy) * 0.0001), 0), 1), 6) AS shade FROM d""")
def slopes(read):
    """WN-12, AG-29: central differences and hillshade."""
    return grids.slopes(read("grid")).select("r", "c", "dx", "dy", F.round("shade", 6).alias("shade"))


@query("wn13_northern_shade", "SELECT r, c, CASE WHEN value - lag(value) OVER w + CASE WHEN (r + c) % 2 = 0 THEN 10 ELSE -10 END > 60 THEN 2 WHEN value - lag(value) OVER w + CASE WHEN (r + c) % 2 = 0 THEN 10 ELSE -10 END < -60 THEN 0 ELSE 1 END AS shade FROM {grid} WINDOW w AS (PARTITION BY c ORDER BY r)")
def northern_shade(read):
    """WN-13: shade by the difference to the northern neighbour, dithered."""
    from pyspark.sql import Window

    d = F.col("value") - F.lag("value").over(Window.partitionBy("c").orderBy("r")) + F.when((F.col("r") + F.col("c")) % 2 == 0, 10).otherwise(-10)
    return read("grid").select("r", "c", F.when(d > 60, 2).when(d < -60, 0).otherwise(1).alias("shade"))


_RUNS = """runs AS (SELECT r, class, min(c) AS "start", max(c) + 1 AS "end" FROM (SELECT r, c, class, c - row_number() OVER (PARTITION BY r, class ORDER BY c) AS i FROM {grid_class} WHERE class <> 0) GROUP BY r, class, i)"""


@query("wn08_run_length_encode", f'WITH {_RUNS} SELECT r, class, "start", "end" FROM runs')
def runs(read):
    """WN-08: runs of equal classes."""
    return grids.run_length(read("grid_class"))


@query("jn35_run_lookup", f'WITH {_RUNS}, p AS (SELECT r, c FROM {{grid_class}}) SELECT p.r, p.c, coalesce(class, 0) AS class FROM p LEFT JOIN runs ON runs.r = p.r AND p.c >= "start" AND p.c < "end"')
def lookup(read):
    """JN-35: which run holds a column, by row and bucket."""
    return grids.run_lookup(read("grid_class").select("r", "c"), grids.run_length(read("grid_class")))


@query("ag11_gaussian_disc", f"""WITH {_POINTS}, o AS (SELECT a, b, exp(-(a * a + b * b) / 4.5) AS w FROM range(-3, 4) x(a), range(-3, 4) y(b) WHERE a * a + b * b <= 9)
    SELECT k, round(sum(w * greatest(coalesce(value, 0), 0)) / sum(w), 4) AS mean FROM pts p CROSS JOIN o LEFT JOIN {{grid}} g ON g.r = p.r + a AND g.c = p.c + b GROUP BY k""")
def disc(read):
    """AG-11: Gaussian mean of a disc, sea as 0."""
    return grids.gaussian_disc(_points(read), read("grid"), "k", 3, 1.5).withColumn("mean", F.round("mean", 4))


@query("jn39_lightning_near", f"""WITH {_POINTS} SELECT k, max(value) AS highest FROM pts p JOIN {{grid}} g ON g.r BETWEEN p.r - 2 AND p.r + 2 AND g.c BETWEEN p.c - 2 AND p.c + 2 GROUP BY k""")
def near_maximum(read):
    """JN-39: the largest value within two cells."""
    pixels = read("grid").select(F.col("r").alias("pr"), F.col("c").alias("pc"), "value")
    return grids.near_pixels(_points(read), pixels, 2).groupBy("k").agg(F.max("value").alias("highest"))


@query("jn29_priority_sources", "SELECT a.r, a.c, coalesce(a.value, CASE WHEN b.class > 0 THEN b.class * 100 END, -1) AS value, CASE WHEN a.value IS NOT NULL THEN 'first' WHEN b.class > 0 THEN 'second' ELSE 'last' END AS source FROM {grid} a JOIN {grid_class} b ON b.r = a.c AND b.c = a.r % 64")
def priority(read):
    """JN-29, UD-01, UD-03: the first covering source with a value, with its name."""
    b = read("grid_class").select(F.col("r").alias("c"), F.col("c").alias("rr"), "class")
    a = read("grid").withColumn("rr", F.col("r") % 64).join(b, ["c", "rr"])
    second = F.when(F.col("class") > 0, F.col("class") * 100)
    return a.select("r", "c", F.coalesce("value", second, F.lit(-1)).alias("value"), F.when(F.col("value").isNotNull(), "first").when(second.isNotNull(), "second").otherwise("last").alias("source"))


@query("jn30_land_sea_merge", """WITH s AS (SELECT a.r, a.c, a.value / 100.0 AS land, CASE WHEN (a.r + a.c) % 3 <> 0 THEN -abs(coalesce(a.value, 300)) / 10.0 ELSE 5.0 END AS depth FROM {grid} a)
    SELECT r, c, round(CASE WHEN (land IS NULL OR land <= 0.5) AND depth < 0 THEN CASE WHEN land < -1 AND depth > land - 20 THEN land ELSE greatest(depth, coalesce(least(0, land), 0) - 30) END ELSE land END, 4) AS height FROM s""")
def land_sea(read):
    """JN-30: sea floor under water, polders keep their height, depths are limited."""
    v = F.col("value")
    land, depth = v / 100.0, F.when((F.col("r") + F.col("c")) % 3 != 0, -F.abs(F.coalesce(v, F.lit(300))) / 10.0).otherwise(5.0)
    s = read("grid").select("r", "c", land.alias("land"), depth.alias("depth"))
    surface = F.when(F.col("land").isNull(), 0.0).otherwise(F.least(F.lit(0.0), F.col("land")))
    wet = F.when((F.col("land") < -1) & (F.col("depth") > F.col("land") - 20), F.col("land")).otherwise(F.greatest("depth", surface - 30))
    return s.select("r", "c", F.round(F.when((F.col("land").isNull() | (F.col("land") <= 0.5)) & (F.col("depth") < 0), wet).otherwise(F.col("land")), 4).alias("height"))


@query("fl08_plausible_tiles", "SELECT CAST(floor(r / 4.0) AS BIGINT) AS r, CAST(floor(c / 4.0) AS BIGINT) AS c, max(value) AS top FROM {grid} GROUP BY 1, 2 HAVING bool_and(coalesce(value BETWEEN -350 AND 350, true))")
def plausible(read):
    """FL-08: tiles all of whose pixels are plausible."""
    t = read("grid").groupBy(F.floor(F.col("r") / 4).alias("r"), F.floor(F.col("c") / 4).alias("c"))
    return t.agg(F.max("value").alias("top"), F.bool_and(F.coalesce(F.col("value").between(-350, 350), F.lit(True))).alias("good")).where("good").drop("good")


@query("fl12_fl14_gates", "SELECT CAST(floor(r / 8.0) AS BIGINT) AS r, CAST(floor(c / 8.0) AS BIGINT) AS c, bool_and(coalesce(value < 200, true)) AS open_sea, round(avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END), 4) AS known FROM {grid} GROUP BY 1, 2 HAVING avg(CASE WHEN value IS NOT NULL THEN 1.0 ELSE 0 END) >= 0.3")
def gates(read):
    """FL-12, FL-14: open sea of a chunk and the coverage gate."""
    known = F.avg(F.col("value").isNotNull().cast("double"))
    t = read("grid").groupBy(F.floor(F.col("r") / 8).alias("r"), F.floor(F.col("c") / 8).alias("c"))
    return t.agg(F.bool_and(F.coalesce(F.col("value") < 200, F.lit(True))).alias("open_sea"), F.round(known, 4).alias("known")).where("known >= 0.3")


@query("ag10_water_surfaces", """WITH s AS (SELECT *, count(*) OVER (PARTITION BY area_id) AS n FROM {water_shores}), p AS (SELECT area_id, CAST(floor(r) AS BIGINT) AS r, CAST(floor(c) AS BIGINT) AS c FROM s WHERE seq % greatest(CAST(floor(n / 24.0) AS BIGINT), 1) = 0 AND seq < 24 * greatest(CAST(floor(n / 24.0) AS BIGINT), 1)),
    v AS (SELECT area_id, value, row_number() OVER (PARTITION BY area_id ORDER BY value) - 1 AS k, count(*) OVER (PARTITION BY area_id) AS m FROM p JOIN {grid} USING (r, c) WHERE value IS NOT NULL), o AS (SELECT area_id, any_value(m) AS samples, max(CASE WHEN k = CAST(floor(m / 2.0) AS BIGINT) THEN value END) AS med FROM v GROUP BY 1),
    f AS (SELECT w.*, coalesce(samples, 0) AS samples, CAST(coalesce(med, g.value, 0) AS DOUBLE) AS found FROM {water_bodies} w LEFT JOIN o USING (area_id) LEFT JOIN {grid} g ON g.r = floor(mid_r) AND g.c = floor(mid_c)),
    t AS (SELECT *, kind = 'sea' OR tidal OR found <= 1 AS at_sea FROM f), u AS (SELECT * REPLACE (CASE WHEN at_sea AND kind NOT IN ('swimming_pool', 'fountain_basin', 'basin') THEN 'sea' ELSE kind END AS kind) FROM t)
    SELECT area_id, kind, CASE WHEN at_sea THEN 0.0 ELSE floor(found + 0.5) END::DOUBLE AS surface, CAST(CASE kind WHEN 'sea' THEN 6 WHEN 'lake' THEN CASE WHEN area_m2 > 1000000 THEN 12 WHEN area_m2 > 100000 THEN 7 ELSE 4 END WHEN 'reservoir' THEN CASE WHEN area_m2 > 500000 THEN 10 ELSE 6 END WHEN 'river' THEN 3 WHEN 'stream' THEN 1 ELSE 2 END AS INTEGER) AS depth, at_sea, CAST(samples AS INTEGER) AS samples FROM u""")
def water_surfaces(read):
    """AG-10: one surface for each body of water, the sea where it is no higher."""
    from geoloom.operators import waters

    return waters.water_surfaces(read("water_bodies"), read("water_shores"), read("grid"), 0.0)
