"""Queries over observations; streaming jobs are registered on the same rows as tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.operators import weather
from geoloom.plans.register import query
from geoloom.streaming import observations as stream
from geoloom.streaming import state


def _events(read, table="observations"):
    return read(table).withColumn("ts", F.col("ts").cast("timestamp"))


_FAR = "sqrt(((s.lon_e7 - a.lon_e7) / 1e7 * 111320.0 * cos(radians(a.lat_e7 / 1e7))) ** 2 + ((s.lat_e7 - a.lat_e7) / 1e7 * 111320.0) ** 2)"
_STATION = f"""ask AS (SELECT event_id AS k, lat_e7, lon_e7, ts AS at_ts, rate, lightning FROM {{radar}}),
    st AS (SELECT k, s.event_id AS report, wx, temp_c FROM ask a JOIN {{observations}} s ON {_FAR} <= 30000 AND s.ts <= at_ts AND epoch(at_ts) - epoch(s.ts) <= 4500 QUALIFY row_number() OVER (PARTITION BY k ORDER BY round({_FAR}, 3), epoch(at_ts) - epoch(s.ts), s.event_id) = 1)"""


def _asked(read):
    return _events(read, "radar").select(F.col("event_id").alias("k"), "lat_e7", "lon_e7", F.col("ts").alias("at"), "rate", "lightning")


@query("jn36_nearest_station", f"WITH {_STATION} SELECT k, report, wx, temp_c FROM st")
def station(read):
    """JN-36, FL-11: the nearest report within 30 km and 75 minutes."""
    return weather.nearest_station(_asked(read), _events(read), "k").select("k", "report", "wx", "temp_c")


@query(
    "jn37_weather_fusion",
    f"""WITH {_STATION}, j AS (SELECT a.k, CASE WHEN a.k % 2 = 0 THEN rate END AS rate, lightning, wx, report IS NOT NULL AS has, st.temp_c AS s_temp, CASE a.k % 4 WHEN 0 THEN 'rain' WHEN 1 THEN 'clearsky' WHEN 2 THEN 'rainandthunder' END AS symbol, 4.5 AS f_temp FROM ask a LEFT JOIN st USING (k)),
    w AS (SELECT *, coalesce(CASE WHEN rate IS NOT NULL THEN rate >= 0.1 END, CASE WHEN has THEN wx IN ('-RA', 'TSRA', 'SN') END, symbol <> 'clearsky', false) AS wet, CASE WHEN lightning THEN true WHEN has THEN wx = 'TSRA' ELSE coalesce(symbol = 'rainandthunder', false) END AS thunder FROM j)
    SELECT k, CASE WHEN thunder THEN 'THUNDER' WHEN wet THEN 'RAIN' ELSE 'CLEAR' END AS sky, CAST(coalesce(s_temp, f_temp) AS DOUBLE) AS temp, concat_ws('+', CASE WHEN rate IS NOT NULL THEN 'radar' END, CASE WHEN has THEN 'station' END, CASE WHEN symbol IS NOT NULL THEN 'forecast' END) AS source FROM w""",
)
def fusion(read):
    """JN-37: radar, station and forecast fused, with provenance."""
    asked = _asked(read)
    near = weather.nearest_station(asked, _events(read), "k").select("k", "wx", F.col("temp_c").alias("s_temp"), F.lit(True).alias("has_station"))
    m = F.col("k") % 4
    symbol = F.when(m == 0, "rain").when(m == 1, "clearsky").when(m == 2, "rainandthunder")
    rows = asked.join(near, "k", "left").withColumns({"has_station": F.coalesce("has_station", F.lit(False)), "rate": F.when(F.col("k") % 2 == 0, F.col("rate")), "symbol": symbol, "f_temp": F.lit(4.5)})
    return weather.fuse(rows).select("k", "sky", "temp", "source")


@query("jn38_radar_provider", """WITH b(provider, ord, s, w, n, e) AS (VALUES ('north', 1, 602000000, 50000000, 606000000, 60000000), ('west', 2, 600000000, 50000000, 602000000, 53000000), ('all', 3, 590000000, 40000000, 610000000, 70000000))
    SELECT event_id, min_by(provider, ord) AS provider FROM {observations}, b WHERE lat_e7 BETWEEN s AND n AND lon_e7 BETWEEN w AND e GROUP BY event_id""")
def provider(read):
    """JN-38, FL-10, SRC-71: the first of ordered regional boxes that holds a place, as one expression."""
    boxes = [("north", 602000000, 50000000, 606000000, 60000000), ("west", 600000000, 50000000, 602000000, 53000000), ("all", 590000000, 40000000, 610000000, 70000000)]
    rule = F.coalesce(*[F.when(F.col("lat_e7").between(s, n) & F.col("lon_e7").between(w, e), F.lit(p)) for p, s, w, n, e in boxes])
    return read("observations").select("event_id", rule.alias("provider"))


@query("jn40_reading_or_mean", """WITH r AS (SELECT event_id AS reading_id, lat_e7, lon_e7, temp_c AS temp FROM {observations} WHERE temp_c IS NOT NULL),
    n AS (SELECT place_id, min_by(temp, (round(sqrt(((r.lon_e7 - p.lon_e7) / 1e7 * 111320.0 * cos(radians(p.lat_e7 / 1e7))) ** 2 + ((r.lat_e7 - p.lat_e7) / 1e7 * 111320.0) ** 2), 3), reading_id)) AS near FROM {places} p JOIN r ON sqrt(((r.lon_e7 - p.lon_e7) / 1e7 * 111320.0 * cos(radians(p.lat_e7 / 1e7))) ** 2 + ((r.lat_e7 - p.lat_e7) / 1e7 * 111320.0) ** 2) <= 2500 GROUP BY place_id)
    SELECT place_id, round(coalesce(near, (SELECT avg(temp) FROM r)), 4) AS temp, near IS NOT NULL AS measured FROM {places} LEFT JOIN n USING (place_id)""")
def reading(read):
    """JN-40, SM-07: the nearest reading within reach, else the mean."""
    r = read("observations").where("temp_c is not null").select(F.col("event_id").alias("reading_id"), "lat_e7", "lon_e7", F.col("temp_c").alias("temp"))
    return weather.reading_or_mean(read("places").select("place_id", "lat_e7", "lon_e7"), r, "place_id", 2500).withColumn("temp", F.round("temp", 4))


@query("sm03_latest_per_cell_window", """SELECT CAST(floor(lat_e7 / 100000.0) AS BIGINT) AS cell_lat, CAST(floor(lon_e7 / 100000.0) AS BIGINT) AS cell_lon, CAST(floor(epoch(ts) / 21600) * 21600 AS BIGINT) AS "start", max_by(event_id, (ts, event_id)) AS newest, count(*) AS n FROM {observations} GROUP BY 1, 2, 3""")
def latest(read):
    """SM-03, SM-04: the newest value of a cell in tumbling windows of six hours."""
    e = _events(read).withColumn("newest", F.col("event_id"))
    return weather.latest_by_cell(e, "newest", "6 hours", 100_000).withColumn("start", F.unix_timestamp("start"))


@query("sm05_trailing_rate", """SELECT CAST(s AS BIGINT) AS "start", count(*) AS n FROM (SELECT unnest([floor(epoch(ts) / 1800) * 1800, floor(epoch(ts) / 1800) * 1800 - 1800]) AS s FROM {observations}) GROUP BY 1""")
def rate(read):
    """SM-05: events in sliding windows."""
    return stream.trailing_rate(_events(read), "60 minutes", "30 minutes").withColumn("start", F.unix_timestamp("start"))


@query("sm05_progress", """WITH s AS (SELECT station, CAST(floor(epoch(ts)) AS BIGINT) AS second, count(*) AS n FROM {observations} WHERE ts IS NOT NULL GROUP BY 1, 2), t AS (SELECT station, count(*) + min(user_id) % 5 - 2 AS total FROM {observations} GROUP BY 1),
    w AS (SELECT station, second, CAST(sum(n) OVER (PARTITION BY station ORDER BY second) AS BIGINT) AS done, sum(n) OVER (PARTITION BY station ORDER BY second RANGE BETWEEN 86399 PRECEDING AND CURRENT ROW) / 86400.0 AS rate FROM s)
    SELECT station, second, done, round(CAST(rate AS DOUBLE), 8) AS rate, round(greatest((total - done) / CAST(rate AS DOUBLE), 0.0), 6) AS left_s FROM w JOIN t USING (station)""")
def left(read):
    """SM-05: work done, its rate over the last day, and the time left to a total."""
    totals = read("observations").groupBy("station").agg((F.count("*") + F.min("user_id") % 5 - 2).alias("total"))
    return state.progress(_events(read), totals, "station", 86_400).withColumns({"rate": F.round("rate", 8), "left_s": F.round("left_s", 6)})


@query("sm07_current_readings", """WITH now AS (SELECT max(ts) AS t FROM {observations}), r AS (SELECT CAST(floor(lat_e7 / 500000.0) AS BIGINT) AS y, CAST(floor(lon_e7 / 500000.0) AS BIGINT) AS x, max_by(struct_pack(k := event_id, ts := ts, lat := lat_e7, lon := lon_e7, temp := temp_c), (ts, event_id)) AS v FROM {observations} WHERE temp_c IS NOT NULL GROUP BY 1, 2),
    l AS (SELECT v.k AS k, v.lat AS lat, v.lon AS lon, v.temp AS temp FROM r, now WHERE epoch_us(v.ts) + 172800000000 > epoch_us(t)),
    d AS (SELECT place_id, k, temp, sqrt(((lon - lon_e7) / 1e7 * 111320.0 * cos(radians(lat_e7 / 1e7))) ** 2 + ((lat - lat_e7) / 1e7 * 111320.0) ** 2) AS d FROM {places}, l),
    n AS (SELECT place_id, min_by(temp, (round(d, 3), k)) AS near FROM d WHERE d <= 30000 GROUP BY place_id)
    SELECT place_id, round(coalesce(near, (SELECT avg(temp) FROM l)), 4) AS temp, near IS NOT NULL AS measured FROM {places} LEFT JOIN n USING (place_id)""")
def current(read):
    """SM-07: each area's newest reading while it is fresh; a place takes the nearest within 30 km, else the mean."""
    e = _events(read)
    newest = e.agg(F.max("ts")).first()[0]
    return state.temperature_at(read("places"), state.current_readings(e, F.lit(newest), 2880), "place_id").withColumn("temp", F.round("temp", 4))


@query("sm06_held_weather", """WITH g AS (SELECT station, ts, CASE WHEN epoch(ts) - epoch(lag(ts) OVER w) < 1800 THEN 0 ELSE 1 END AS n FROM {observations} WINDOW w AS (PARTITION BY station ORDER BY ts)), s AS (SELECT *, sum(n) OVER (PARTITION BY station ORDER BY ts ROWS UNBOUNDED PRECEDING) AS i FROM g)
    SELECT station, CAST(floor(epoch(min(ts))) AS BIGINT) AS "start", count(*) AS n FROM s GROUP BY station, i""")
def held(read):
    """SM-06: sessions that end 30 minutes after the last report."""
    return stream.held_weather(_events(read)).select("station", F.unix_timestamp("start").alias("start"), "n")


@query("sm09_enriched_events", """WITH g AS (SELECT CAST(floor(lat_e7 / 500000.0) AS BIGINT) AS y, CAST(floor(lon_e7 / 500000.0) AS BIGINT) AS x, min(place_id) AS place_group FROM {places} GROUP BY 1, 2)
    SELECT event_id, place_group FROM {observations} o LEFT JOIN g ON CAST(floor(o.lat_e7 / 500000.0) AS BIGINT) = y AND CAST(floor(o.lon_e7 / 500000.0) AS BIGINT) = x""")
def enriched(read):
    """SM-09: events with the place group of their cell."""
    return stream.enriched(_events(read), read("places")).select("event_id", "place_group")


@query("sm14_readiness", """WITH l AS (SELECT station, max_by(lat_e7, (ts, event_id)) AS lat, max_by(lon_e7, (ts, event_id)) AS lon FROM {observations} GROUP BY 1), r AS (SELECT DISTINCT CAST(floor(lat_e7 / 1000000.0) AS BIGINT) AS y, CAST(floor(lon_e7 / 1000000.0) AS BIGINT) AS x FROM {places}),
    n AS (SELECT station, CAST(floor(lat / 1000000.0) AS BIGINT) + a AS y, CAST(floor(lon / 1000000.0) AS BIGINT) + b AS x FROM l, range(-2, 3) p(a), range(-2, 3) q(b))
    SELECT station, count(*) AS needed, count(r.y) AS ready, count(r.y) = count(*) AS complete FROM n LEFT JOIN r USING (y, x) GROUP BY station""")
def readiness(read):
    """SM-14, JN-47: ready against needed cells round the latest position."""
    ready = read("places").select(F.floor(F.col("lat_e7") / 1_000_000).alias("cell_lat"), F.floor(F.col("lon_e7") / 1_000_000).alias("cell_lon"))
    return stream.readiness(_events(read), ready)


@query("src15_newest_day", "SELECT event_id FROM {observations} WHERE CAST(ts AS DATE) = (SELECT max(CAST(ts AS DATE)) FROM {observations})")
def newest(read):
    """SRC-15: only the newest day of a dated grid."""
    from geoloom.sources.sinks import newest_day

    return newest_day(read("observations").withColumn("day", F.to_date("ts"))).select("event_id")


@query(
    "sc59_seasons",
    """WITH m AS (SELECT station, month(day) - 1 AS i, avg(temp) AS t, avg(precip) * 30 AS r FROM {daily_weather} GROUP BY 1, 2), l AS (SELECT station, list(round(t, 6) ORDER BY i) AS ts, list(round(r, 6) ORDER BY i) AS rs FROM m GROUP BY 1 HAVING count(*) = 12), x AS (SELECT station, i, ts, rs, ts[i + 1] AS t, rs[i + 1] AS r FROM l, range(12) q(i))
    SELECT station, i AS "month", CASE WHEN t < 0 THEN 'winter' WHEN t < 3 THEN 'thaw' WHEN t >= 10 AND r < 2 * t AND list_max(rs) >= 60 THEN 'dry' WHEN len(list_filter(ts, lambda u: u < t)) < 3 AND t < 12 THEN 'winter' WHEN t >= 16 OR list_min(ts) >= 16 THEN 'summer' WHEN ts[(i + 1) % 12 + 1] >= ts[(i + 11) % 12 + 1] THEN 'spring' ELSE 'autumn' END AS season FROM x""",
)
def seasons(read):
    """SC-59: the season of each month from twelve normals."""
    m = read("daily_weather").groupBy("station", (F.month("day") - 1).alias("i")).agg(F.round(F.avg("temp"), 6).alias("t"), F.round(F.avg("precip") * 30, 6).alias("r"))
    year = m.groupBy("station").agg(F.array_sort(F.collect_list(F.struct("i", "t", "r"))).alias("s")).where("size(s) = 12")
    named = year.select("station", F.posexplode(weather.season_of_months(F.col("s.t"), F.col("s.r"))).alias("month", "season"))
    return named.withColumn("month", F.col("month").cast("bigint"))


@query("sc69_synthetic_year", "SELECT id, m AS \"month\", round((size - 10) - (((size - 10) - (size - 22)) / 0.911) * cos((m - CASE WHEN id % 2 = 0 THEN 6 ELSE 0 END) * pi() / 6), 5) AS temp FROM {buildings}, range(12) t(m)")
def synthetic(read):
    """SC-69: twelve months from a mean and a coldest quarter."""
    s = F.col("size").cast("double")
    return read("buildings").select("id", F.posexplode(weather.synthetic_year(s - 10, s - 22, F.col("id") % 2 == 0)).alias("month", "t")).select("id", F.col("month").cast("bigint").alias("month"), F.round("t", 5).alias("temp"))


@query("jn34_nearest_grid_cell", """WITH c AS (SELECT id AS cell_id, lat_e7 + 37000 AS y, lon_e7 + 21000 AS x, size AS value FROM {buildings}), p AS (SELECT place_id, lat_e7 AS py, lon_e7 AS px, CAST(floor(lat_e7 / 100000.0) AS BIGINT) + a AS cy, CAST(floor(lon_e7 / 100000.0) AS BIGINT) + b AS cx FROM {places}, range(-1, 2) u(a), range(-1, 2) v(b)),
    m AS (SELECT place_id, cell_id, value, round(CAST(y - py AS DOUBLE) ** 2 + ((x - px) * cos(radians(py / 1e7))) ** 2, 2) AS d2 FROM p JOIN c ON CAST(floor(y / 100000.0) AS BIGINT) = cy AND CAST(floor(x / 100000.0) AS BIGINT) = cx)
    SELECT place_id, min_by(cell_id, (d2, cell_id)) AS cell_id, min_by(value, (d2, cell_id)) AS value FROM m GROUP BY place_id""")
def grid_cell(read):
    """JN-34: the nearest cell of a grid of points."""
    cells = read("buildings").select(F.col("id").alias("cell_id"), (F.col("lat_e7") + 37_000).alias("lat_e7"), (F.col("lon_e7") + 21_000).alias("lon_e7"), F.col("size").alias("value"))
    return weather.nearest_grid_cell(read("places"), cells, "place_id")
