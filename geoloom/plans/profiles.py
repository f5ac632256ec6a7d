"""Queries over profiles along lines, rankings and running totals."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from geoloom.operators import lines
from geoloom.plans.register import query

_P = "p AS (SELECT r AS line, c AS i, value / 100.0 AS value FROM {grid})"
_Q = "p AS (SELECT r AS line, c AS i, coalesce(value, 0) / 100.0 AS value FROM {grid})"


def _profile(read, filled=True):
    v = F.coalesce("value", F.lit(0)) if filled else F.col("value")
    return read("grid").select(F.col("r").alias("line"), F.col("c").alias("i"), (v / 100.0).alias("value"))


@query("wn02_moving_average", """WITH p AS (SELECT r AS line, c AS i, coalesce(value, 0) AS value FROM {grid}), a AS (SELECT *, avg(value) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS m FROM p)
    SELECT line, i, round((value + (least(greatest(m, value - 100), value + 100) - value) * least(least(i, 63 - i) / 4.0, 1)) / 100.0, 8) AS smooth FROM a""")
def moving_average(read):
    """WN-02: centred average, clamped to the raw value, blended to the pinned ends; over whole hundredths, whose sums have no order."""
    p = read("grid").select(F.col("r").alias("line"), F.col("c").alias("i"), F.coalesce("value", F.lit(0)).alias("value"))
    return lines.smooth(p, 4, 100.0).select("line", "i", F.round(F.col("smooth") / 100.0, 8).alias("smooth"))


@query("wn03_ramp_cone", f"""WITH {_Q} SELECT line, i, round(greatest(max(value + 0.125 * i) OVER (PARTITION BY line ORDER BY i) - 0.125 * i, max(value - 0.125 * i) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 0.125 * i), 5) AS ramp FROM p""")
def ramp_cone(read):
    """WN-03: cones of grade 1/8 over every need."""
    return lines.ramp_up(_profile(read), "value", 0.125).select("line", "i", F.round("ramp", 5).alias("ramp"))


@query("wn04_tunnel_cap", f"""WITH {_Q} SELECT line, i, round(least(min(value - 0.125 * i) OVER (PARTITION BY line ORDER BY i) + 0.125 * i, min(value + 0.125 * i) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 0.125 * i), 5) AS cap FROM p""")
def tunnel_cap(read):
    """WN-04: the same from above."""
    return lines.ramp_down(_profile(read), "value", 0.125).select("line", "i", F.round("cap", 5).alias("cap"))


@query("wn05_deck_profile", f"""WITH {_Q}, s AS (SELECT line, i, first_value(value) OVER w + (last_value(value) OVER w - first_value(value) OVER w) * i / 63.0 AS s, CASE WHEN i % 16 = 8 THEN value + 3 END AS need FROM p WINDOW w AS (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
    n AS (SELECT line, i, greatest(s, coalesce(need, s)) AS n FROM s)
    SELECT line, i, round(greatest(max(n + 0.125 * i) OVER (PARTITION BY line ORDER BY i) - 0.125 * i, max(n - 0.125 * i) OVER (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) + 0.125 * i), 5) AS deck FROM n""")
def deck(read):
    """WN-05: bridge deck over crossing needs."""
    p = _profile(read).withColumns({"ground": F.col("value"), "need": F.when(F.col("i") % 16 == 8, F.col("value") + 3)})
    return lines.deck(p, 0.125).select("line", "i", F.round("deck", 5).alias("deck"))


@query("wn06_fill_gaps", f"""WITH {_P}, k AS (SELECT *, last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER b AS i0, last_value(value IGNORE NULLS) OVER b AS v0, first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER a AS i1, first_value(value IGNORE NULLS) OVER a AS v1 FROM p
      WINDOW b AS (PARTITION BY line ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), a AS (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT line, i, round(coalesce(CASE WHEN i0 = i1 THEN v0 ELSE v0 + (v1 - v0) * (i - i0) / (i1 - i0) END, v0, v1), 5) AS filled FROM k""")
def gaps(read):
    """WN-06: linear between known values, held at the ends."""
    return lines.fill_gaps(_profile(read, filled=False)).select("line", "i", F.round("filled", 5).alias("filled"))


@query("wn07_slope_limit")
def slope_limit(read):
    """WN-07: no step steeper than the grade (an envelope, not the iterative evening)."""
    return lines.slope_limited(_profile(read), 0.5).select("line", "i", F.round("limited", 5).alias("limited"))


@query("wn15_every_nth", f"WITH {_Q} SELECT line, i FROM p WHERE i % 6 = 0")
def nth(read):
    """WN-15: every sixth cell along a line."""
    return lines.every_nth(_profile(read), 6).select("line", "i")


@query("wn17_delta_coding", f"WITH q AS (SELECT r AS line, c AS i, coalesce(value, 0) AS value FROM {{grid}}) SELECT line, i, value - coalesce(lag(value) OVER (PARTITION BY line ORDER BY i), 0) AS delta, value AS value FROM q")
def deltas(read):
    """WN-17: differences, and their running sum back."""
    p = read("grid").select(F.col("r").alias("line"), F.col("c").alias("i"), F.coalesce("value", F.lit(0)).alias("value"))
    return lines.undelta(lines.delta(p).drop("value")).select("line", "i", "delta", "value")


@query("wn20_flattest_strip", f"""WITH {_Q}, s AS (SELECT line, i, min(value) OVER w AS lo, max(value) OVER w AS hi, list_sort(list(value) OVER w) AS l FROM p WINDOW w AS (PARTITION BY line ORDER BY i ROWS BETWEEN CURRENT ROW AND 6 FOLLOWING)),
    t AS (SELECT *, hi - lo + 0.25 * abs(i + 3 - 31.5) AS score FROM s WHERE i + 6 <= 63)
    SELECT line, i AS "start", round(score, 5) AS score, l[4] AS level FROM t QUALIFY row_number() OVER (PARTITION BY line ORDER BY round(score, 6), i) = 1""")
def strip(read):
    """WN-20: the flattest strip of seven positions and its median."""
    return lines.flattest_strip(_profile(read), 7).withColumn("score", F.round("score", 5))


@query("wn11_top_landmarks", """WITH l AS (SELECT place_id, name, category, place_id % 7 AS score, round(sqrt((lat_e7 / 1e7 - 60.25) ** 2 + (lon_e7 / 1e7 - 5.5) ** 2), 6) AS far, CAST(floor(lat_e7 / 1e6) AS BIGINT) AS area FROM {places}),
    a AS (SELECT * FROM l QUALIFY row_number() OVER (PARTITION BY area, split_part(name, '-', 2) ORDER BY score DESC, far, place_id) = 1),
    b AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY area, category ORDER BY score DESC, far, place_id) <= 12)
    SELECT area, place_id FROM b QUALIFY row_number() OVER (PARTITION BY area ORDER BY score DESC, far, place_id) <= 36""")
def landmarks(read):
    """WN-11: best landmarks of an area: one per name, twelve per kind, thirty-six in all."""
    p = read("places").withColumns({"score": F.col("place_id") % 7, "far": F.round(F.sqrt(F.pow(F.col("lat_e7") / 1e7 - 60.25, 2) + F.pow(F.col("lon_e7") / 1e7 - 5.5, 2)), 6), "area": F.floor(F.col("lat_e7") / 1e6), "key": F.split("name", "-")[1]})
    order = [F.col("score").desc(), F.col("far"), F.col("place_id")]
    for keys, most in ((["area", "key"], 1), (["area", "category"], 12), (["area"], 36)):
        p = p.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_n") <= most)
    return p.select("area", "place_id")


@query("wn14_wn18_label_dedupe", """SELECT place_id FROM {places} QUALIFY row_number() OVER (PARTITION BY name, CAST(floor(lat_e7 / 125000.0) AS BIGINT), CAST(floor(lon_e7 / 125000.0) AS BIGINT) ORDER BY place_id % 5, place_id) = 1""")
def labels(read):
    """WN-14, WN-18: one label of a name per cell, of the best rank."""
    w = Window.partitionBy("name", F.floor(F.col("lat_e7") / 125000), F.floor(F.col("lon_e7") / 125000)).orderBy(F.col("place_id") % 5, "place_id")
    return read("places").withColumn("_n", F.row_number().over(w)).where("_n = 1").select("place_id")


@query("wn16_budgeted_prefix", """SELECT path FROM (SELECT path, sum(size) OVER (PARTITION BY split_part(path, '_', 1) ORDER BY size, path ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS t FROM {files}) WHERE t <= 40000""")
def budget(read):
    """WN-16, SO-03: smallest first until a source's budget is used."""
    f = read("files").withColumn("source", F.split("path", "_")[0])
    return lines.budgeted(f, F.struct("size", "path"), "size", 40000, "source").select("path")


@query("wn19_months_ranked", """WITH m AS (SELECT station, month(day) AS m, avg(temp) AS t FROM {daily_weather} GROUP BY 1, 2) SELECT station, m, CAST(rank() OVER (PARTITION BY station ORDER BY round(t, 6), m) AS INTEGER) AS coldness FROM m""")
def months(read):
    """WN-19: months from the coldest to the warmest."""
    m = read("daily_weather").groupBy("station", F.month("day").cast("bigint").alias("m")).agg(F.avg("temp").alias("t"))
    return m.select("station", "m", F.rank().over(Window.partitionBy("station").orderBy(F.round("t", 6), "m")).alias("coldness"))


@query("so05_eight_nearest", """WITH n AS (SELECT l.lake_id, p.place_id, round(sqrt(((p.lon_e7 - l.lon_e7) / 1e7 * 111320.0 * cos(radians(l.lat_e7 / 1e7))) ** 2 + ((p.lat_e7 - l.lat_e7) / 1e7 * 111320.0) ** 2), 3) AS d FROM {lakes} l JOIN {places} p  ON true) SELECT lake_id, place_id, d FROM n WHERE d <= 10000 QUALIFY row_number() OVER (PARTITION BY lake_id ORDER BY d, place_id) <= 8""")
def eight_nearest(read):
    """SO-05: the eight nearest places within 10 km of a lake."""
    from geoloom.operators.spatial import nearest_within

    p = read("places").select("place_id", F.col("lat_e7").alias("p_lat"), F.col("lon_e7").alias("p_lon"))
    near = nearest_within(read("lakes").select("lake_id", "lat_e7", "lon_e7"), p, "lake_id", 10_000.0, ("lat_e7", "lon_e7"), ("p_lat", "p_lon"), ["place_id"], k=8)
    return near.select("lake_id", "place_id", F.round("d", 3).alias("d"))


@query("ag13_monthly_normals", """SELECT station, month(day) AS m, round(avg(temp), 1) AS temp, round(avg(precip) * avg(day(last_day(day))), 6) AS rain, count(*) AS days FROM {daily_weather} GROUP BY 1, 2""")
def normals(read):
    """AG-13: mean temperature to one decimal, and mean daily rain times the length of the month; nulls are skipped."""
    from geoloom.plans.statistics import rounded, steady_mean

    return read("daily_weather").groupBy("station", F.month("day").cast("bigint").alias("m")).agg(rounded(steady_mean(F.col("temp")), 1).alias("temp"), F.round(steady_mean(F.col("precip")) * F.avg(F.dayofmonth(F.last_day("day"))), 6).alias("rain"), F.count("*").alias("days"))


@query("ag14_winter_precipitation", """SELECT station, round(sum(CASE WHEN station % 3 = 0 AND month(day) IN (10, 11, 12, 1, 2, 3, 4) THEN precip WHEN station % 3 = 1 AND month(day) BETWEEN 4 AND 10 THEN precip WHEN station % 3 = 2 THEN precip * 7 / 12 ELSE 0 END), 4) AS winter FROM {daily_weather} GROUP BY 1""")
def winter(read):
    """AG-14: winter precipitation by hemisphere, a share of all in the tropics."""
    m, k, p = F.month("day"), F.col("station") % 3, F.col("precip")
    v = F.when((k == 0) & ((m >= 10) | (m <= 4)), p).when((k == 1) & m.between(4, 10), p).when(k == 2, p * 7 / 12).otherwise(0.0)
    return read("daily_weather").groupBy("station").agg(F.round(F.sum(v), 4).alias("winter"))


@query("ag12_area_heights", """WITH v AS (SELECT CAST(floor(r / 10.0) AS BIGINT) AS area, r, c, value, row_number() OVER (PARTITION BY CAST(floor(r / 10.0) AS BIGINT) ORDER BY value, r, c) - 1 AS k, count(*) OVER (PARTITION BY CAST(floor(r / 10.0) AS BIGINT)) AS n FROM {grid} WHERE value IS NOT NULL)
    SELECT area, min(value) AS low, max(value) AS high, max(CASE WHEN k = CAST(floor(n * 0.05) AS BIGINT) THEN value END) AS p5, max_by(r, (value, -r, -c)) AS peak_r, count(*) AS n FROM v GROUP BY area HAVING count(*) >= 16""")
def area_heights(read):
    """AG-12: least, fifth percentile, greatest height of an area, with the place of the peak."""
    from geoloom.plans.statistics import ranked

    v = ranked(read("grid").where("value is not null").withColumn("area", F.floor(F.col("r") / 10)), ["area"], "value", ["r", "c"])
    return v.groupBy("area").agg(F.min("value").alias("low"), F.max("value").alias("high"), F.max(F.when(F.col("k") == F.floor(F.col("n") * 0.05), F.col("value"))).alias("p5"), F.max_by("r", F.struct(F.col("value"), -F.col("r"), -F.col("c"))).alias("peak_r"), F.count("*").alias("n")).where("n >= 16")


@query("ag07_median_and_trimmed_mean", """WITH v AS (SELECT CAST(floor(r / 2.0) AS BIGINT) AS b, value, row_number() OVER (PARTITION BY CAST(floor(r / 2.0) AS BIGINT) ORDER BY value, r, c) - 1 AS k, count(*) OVER (PARTITION BY CAST(floor(r / 2.0) AS BIGINT)) AS n FROM {grid} WHERE value IS NOT NULL)
    SELECT b, max(CASE WHEN k = CAST(floor(n / 2.0) AS BIGINT) THEN value END) AS median, round(avg(CASE WHEN k >= CAST(floor(n / 5.0) AS BIGINT) AND k < CAST(floor(n * 4 / 5.0) AS BIGINT) THEN value END), 4) AS trimmed, max(CASE WHEN k = CAST(floor(n * 0.8) AS BIGINT) THEN value END) AS p80 FROM v GROUP BY b HAVING count(*) >= 60""")
def medians(read):
    """AG-07, AG-08, AG-10: upper-middle median, trimmed mean of the middle three fifths, p80 by floor index."""
    from geoloom.plans.statistics import ranked

    v = ranked(read("grid").where("value is not null").withColumn("b", F.floor(F.col("r") / 2)), ["b"], "value", ["r", "c"])
    at = lambda q: F.max(F.when(F.col("k") == F.floor(q), F.col("value")))
    middle = (F.col("k") >= F.floor(F.col("n") / 5)) & (F.col("k") < F.floor(F.col("n") * 4 / 5))
    return v.groupBy("b").agg(at(F.col("n") / 2).alias("median"), F.round(F.avg(F.when(middle, F.col("value"))), 4).alias("trimmed"), at(F.col("n") * 0.8).alias("p80"), F.count("*").alias("m")).where("m >= 60").drop("m")
