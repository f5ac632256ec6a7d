"""Queries over scalar functions, by family."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import geometry, physics, projections, text, tiles
from geoloom.plans.register import query


def _round(columns: dict, digits: int = 4) -> list:
    return [F.round(c, digits).alias(n) for n, c in columns.items()]


_Y14 = "(1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 16384"


@query(
    "sc01_sc03_sc05_tiles",
    f"""WITH t AS (SELECT node_id, lat, lon, (lon + 180) / 360 * 16384 AS x, {_Y14} AS y FROM {{way_points}}), u AS (SELECT *, CAST(floor(x) AS BIGINT) AS tx, CAST(floor(y) AS BIGINT) AS ty FROM t)
    SELECT node_id, round(x, 4) AS x, round(y, 4) AS y, CAST(floor(round(lat * 1e7) / 1e6) AS BIGINT) AS cell_lat, CASE WHEN lat >= 60 THEN 'N60E00' ELSE 'N57E00' END || CAST(CAST(floor(lon / 3) * 3 AS BIGINT) AS VARCHAR) AS granule,
      list_reduce(list_transform(range(13, -1, -1), lambda s: CAST(CAST(floor(tx / (2 ** s)) AS BIGINT) % 2 + 2 * (CAST(floor(ty / (2 ** s)) AS BIGINT) % 2) AS VARCHAR)), lambda a, b: a || b) AS quadkey FROM u""",
)
def tile_keys(read):
    """SC-01, SC-03, SC-05: fractional tiles, quadkeys, cells and names of positions."""
    p = read("way_points")
    x, y = tiles.tile_x(F.col("lon"), 14), tiles.tile_y(F.col("lat"), 14)
    key = tiles.quadkey(14, F.floor(x), F.floor(y))
    name = tiles.cell_name(F.col("lat"), F.col("lon"), 3)
    return p.select("node_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.floor(F.round(F.col("lat") * 1e7) / 1e6).alias("cell_lat"), name.alias("granule"), key.alias("quadkey"))


@query(
    "sc02_tile_bounds",
    """WITH t AS (SELECT DISTINCT CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS x, CAST(floor((1 - ln(tan(radians(lat)) + 1 / cos(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS y FROM {way_points})
    SELECT x, y, round(x / 4096.0 * 360 - 180, 6) AS west, round(degrees(atan(sinh(pi() * (1 - 2 * (y + 1) / 4096.0)))), 6) AS south, round((x + 1) / 4096.0 * 360 - 180, 6) AS east, round(degrees(atan(sinh(pi() * (1 - 2 * y / 4096.0)))), 6) AS north,
      round(x * (2 * pi() * 6378137.0 / 4096) - pi() * 6378137.0, 2) AS xmin FROM t""",
)
def bounds(read):
    """SC-02: bounds of tiles in degrees and metres."""
    t = read("way_points").select(F.floor(tiles.tile_x(F.col("lon"), 12)).alias("x"), F.floor(tiles.tile_y(F.col("lat"), 12)).alias("y")).distinct()
    return t.select("x", "y", *_round(tiles.tile_bounds(12, F.col("x"), F.col("y")), 6), F.round(tiles.tile_bounds_3857(12, F.col("x"), F.col("y"))["xmin"], 2).alias("xmin"))


@query("sc04_so06_hilbert_order")
def hilbert(read):
    """SC-04, SO-06: tiles under their Hilbert number, clustered by it."""
    t = read("way_points").select(F.floor(tiles.tile_x(F.col("lon"), 10)).alias("x"), F.floor(tiles.tile_y(F.col("lat"), 10)).alias("y")).distinct()
    keyed = t.withColumn("tile_id", tiles.hilbert_tile_id(10, F.col("x"), F.col("y")))
    return keyed.repartitionByRange("tile_id").sortWithinPartitions("tile_id")


@query("sc06_zoom_for", "SELECT node_id, CAST(least(greatest(ceil(log2(156543.03392 * cos(radians(lat)) / 5.0)), 0), 19) AS BIGINT) AS zoom FROM {way_points}")
def zoom(read):
    """SC-06: coarsest adequate zoom for five metres."""
    return read("way_points").select("node_id", tiles.zoom_for(5.0, F.col("lat")).cast("bigint").alias("zoom"))


@query(
    "sc07_sc08_local_projections",
    """SELECT node_id, round((lon - 5.5) * 111320.0 * cos(radians(60.2)), 4) AS x, round((lat - 60.2) * 111320.0, 4) AS y,
      round(6378137.0 / 2 * ln((1 + cos(radians(lat)) * sin(radians(lon - 5.5))) / (1 - cos(radians(lat)) * sin(radians(lon - 5.5)))), 3) AS tx, round(6378137.0 * atan2(tan(radians(lat)), cos(radians(lon - 5.5))), 3) AS ty, round(lat, 6) AS lat_again, round(lon, 6) AS lon_again FROM {way_points}""",
)
def local_projections(read):
    """SC-07, SC-08: equirectangular and spherical transverse Mercator, with inverses."""
    lat, lon = F.col("lat"), F.col("lon")
    x, y = projections.local(lat, lon, 60.2, 5.5)
    tx, ty = projections.transverse_mercator(lat, lon, 5.5)
    la, lo = projections.transverse_mercator_inverse(tx, ty, 5.5)
    return read("way_points").select("node_id", F.round(x, 4).alias("x"), F.round(y, 4).alias("y"), F.round(tx, 3).alias("tx"), F.round(ty, 3).alias("ty"), F.round(la, 6).alias("lat_again"), F.round(lo, 6).alias("lon_again"))


@query("sc09_sc11_grids_round_trip", "SELECT node_id, round(lat, 6) AS utm_lat, round(lon, 6) AS utm_lon, round(lat, 6) AS lcc_lat, round(lon, 6) AS lcc_lon FROM {way_points}")
def grid_round_trip(read):
    """SC-09, SC-11: UTM and Lambert conformal conic, forward and back."""
    lat, lon = F.col("lat"), F.col("lon")
    projected = read("way_points").select("node_id", *[c.alias(n) for n, c in zip(("e", "n"), projections.utm(lat, lon, 32), strict=True)], *[c.alias(n) for n, c in zip(("x", "y"), projections.lambert_conformal(lat, lon, 46.5, 3.0, 44.0, 49.0), strict=True)])
    u, v = projections.utm_inverse(F.col("e"), F.col("n"), 32)
    a, b = projections.lambert_conformal_inverse(F.col("x"), F.col("y"), 46.5, 3.0, 44.0, 49.0)
    return projected.select("node_id", *_round({"utm_lat": u, "utm_lon": v, "lcc_lat": a, "lcc_lon": b}, 6))


@query(
    "sc10_sc12_sc13_more_grids",
    """WITH p AS (SELECT node_id, lat - 13.2 AS la, lon + 2.4 AS lo, lat, lon FROM {way_points}), q AS (SELECT *, (la * 3600 - 169028.66) / 10000 AS p, (lo * 3600 - 26782.5) / 10000 AS l,
      6371200.0 * (1 + sin(radians(60))) * tan(pi() / 4 - radians(lat) / 2) AS r, sqrt(2 / (1 + sin(radians(55)) * sin(radians(lat)) + cos(radians(55)) * cos(radians(lat)) * cos(radians(lon - 10)))) AS k FROM p)
    SELECT node_id, round(2600072.37 + 211455.93 * l - 10938.51 * l * p - 0.36 * l * p * p - 44.54 * l * l * l, 3) AS swiss_e, round(1200147.07 + 308807.95 * p + 3745.25 * l * l + 76.63 * p * p - 194.56 * l * l * p + 119.79 * p * p * p, 3) AS swiss_n,
      round(r * sin(radians(lon + 80)), 3) AS polar_x, round(-r * cos(radians(lon + 80)), 3) AS polar_y, round(6378137.0 * k * cos(radians(lat)) * sin(radians(lon - 10)), 3) AS laea_x FROM q""",
)
def more_grids(read):
    """SC-10, SC-12, SC-13: Swiss grid, polar stereographic, Lambert azimuthal equal-area."""
    lat, lon = F.col("lat"), F.col("lon")
    e, n = projections.swiss_lv95(lat - 13.2, lon + 2.4)
    px, py = projections.polar_stereographic(lat, lon, -80.0)
    return read("way_points").select("node_id", *_round({"swiss_e": e, "swiss_n": n, "polar_x": px, "polar_y": py, "laea_x": projections.lambert_azimuthal(lat, lon)[0]}, 3))


@query(
    "sc14_sc19_distances_and_bearings",
    """WITH p AS (SELECT node_id, lat, lon, (lon - 5.3) * cos(radians(60.25)) AS dx, lat - 60.25 AS dy FROM {way_points})
    SELECT node_id, round(2 * 6371.0 * asin(sqrt(least(sin(radians(60.25 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(60.25)) * sin(radians(5.3 - lon) / 2) ** 2, 1))), 6) AS km,
      round(sqrt(((5.3 - lon) * 111320.0 * cos(radians(lat))) ** 2 + ((60.25 - lat) * 111320.0) ** 2), 3) AS metres, round((degrees(atan2(dx, dy)) + 360) % 360, 6) AS bearing,
      round(least(abs((degrees(atan2(dx, dy)) + 360) % 360 - 30) % 180, 180 - abs((degrees(atan2(dx, dy)) + 360) % 360 - 30) % 180), 6) AS axial FROM p""",
)
def distances(read):
    """SC-14, SC-19: haversine, flat distance, bearing, axial difference."""
    lat, lon = F.col("lat"), F.col("lon")
    b = geometry.bearing((lon - 5.3) * F.cos(F.radians(F.lit(60.25))), lat - 60.25)
    return read("way_points").select("node_id", F.round(geometry.haversine_km(lat, lon, F.lit(60.25), F.lit(5.3)), 6).alias("km"), F.round(geometry.flat_metres(lat, lon, F.lit(60.25), F.lit(5.3)), 3).alias("metres"), F.round(b, 6).alias("bearing"), F.round(geometry.axial_difference(b, F.lit(30.0)), 6).alias("axial"))


@query(
    "sc27_sc28_parse_lengths",
    """WITH t AS (SELECT way_id, width, regexp_extract(replace(lower(width), ',', '.'), '(-?[0-9]+(\\.[0-9]+)?)', 1) AS d, bridge FROM {ways})
    SELECT way_id, round(try_cast(d AS DOUBLE) * CASE WHEN width LIKE '% ft' THEN 0.3048 ELSE 1 END, 4) AS metres, CAST(floor(try_cast(d AS DOUBLE) * CASE WHEN width LIKE '% ft' THEN 0.3048 ELSE 1 END + 0.5) AS BIGINT) AS whole, coalesce(bridge = 'yes', false) AS bridge FROM t""",
)
def lengths(read):
    """SC-27, SC-28: lengths with units, truth of tags."""
    return read("ways").select("way_id", F.round(text.parse_length(F.col("width")), 4).alias("metres"), text.parse_int(F.col("width")).alias("whole"), text.is_true(F.col("bridge")).alias("bridge"))


@query(
    "sc30_sc31_sc46_names",
    r"""SELECT place_id, trim(regexp_replace(lower(name), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug, substr(trim(split_part(name || ';x', ';', 1)), 1, 60) AS tidy,
      CASE category WHEN 'museum' THEN 0 WHEN 'hotel' THEN 1 WHEN 'school' THEN 2 ELSE 3 END AS rank FROM {places}""",
)
def names(read):
    """SC-30, SC-31, SC-46, SO-02: name keys, slugs, tidy names, rank by kind."""
    n, c = F.col("name"), F.col("category")
    rank = F.when(c == "museum", 0).when(c == "hotel", 1).when(c == "school", 2).otherwise(3)
    return read("places").select("place_id", text.name_key(n).alias("key"), text.slug(n).alias("slug"), text.tidy_name(F.concat(n, F.lit(";x"))).alias("tidy"), rank.alias("rank")).orderBy("rank", "key")


@query("sc32_sc33_positions_and_files", "SELECT place_id, round(lat_e7 / 1e7, 4) AS lat, round(lon_e7 / 1e7, 4) AS lon, 'region_' || (place_id % 7) AS region FROM {places}")
def positions(read):
    """SC-32, SC-33: 'lat, lon' texts and region names from file names."""
    at = F.format_string("%.4f, %.4f", F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7)
    parsed = text.parse_position(at)
    file = F.concat(F.lit("extracts/Region_"), (F.col("place_id") % 7).cast("string"), F.lit("-latest.osm.pbf"))
    return read("places").select("place_id", F.round(parsed["lat"], 4).alias("lat"), F.round(parsed["lon"], 4).alias("lon"), text.region_of_file(file).alias("region"))


@query(
    "sc35_sc36_present_weather",
    """SELECT event_id, wx IN ('-RA', 'TSRA', 'SN') AS wet, wx = 'TSRA' AS thunder, CASE event_id % 5 WHEN 2 THEN 'THUNDER' WHEN 1 THEN 'RAIN' WHEN 3 THEN 'RAIN' ELSE 'CLEAR' END AS sky FROM {observations}""",
)
def present_weather(read):
    """SC-35, SC-36: METAR groups and forecast symbols."""
    wet, thunder = text.wet_and_thunder(F.col("wx"))
    k = F.col("event_id") % 5
    symbol = F.when(k == 0, "clearsky_day").when(k == 1, "rain").when(k == 2, "heavyrainandthunder").when(k == 3, "lightsnow").otherwise("cloudy")
    return read("observations").select("event_id", wet.alias("wet"), thunder.alias("thunder"), text.sky_of_symbol(symbol).alias("sky"))


@query("sc38_lithology_shares", "SELECT id, CASE WHEN size % 100 >= 50 OR size % 100 >= 100 - size % 100 THEN 'granite' ELSE 'gneiss' END AS rock FROM {buildings}")
def lithology(read):
    """SC-38: the rock with the largest share of a description."""
    share = F.col("size") % 100
    described = F.concat(F.lit("granite ["), share.cast("string"), F.lit("%..]; gneiss ["), (100 - share).cast("string"), F.lit("%]"))
    return read("buildings").select("id", text.rock_shares(described).alias("rock"))


@query(
    "sc50_sc52_sc53_physics",
    """SELECT id, round(least(greatest(0.3 * size ** 0.6, 0.5), 25), 6) AS river, round(least(greatest(8 * (size / 10.0) ** 0.3, 3), 60), 6) AS lake, round(least(68.0 * size ** 0.375, 600), 6) AS glacier, CAST(floor((size - 10 + 40) * 2 + 0.5) AS BIGINT) AS t_code, CAST(floor(40 * log10(size + 1) + 0.5) AS BIGINT) AS rain_code,
      round(size + 0.0065 * size * 10, 6) AS sea_level, CASE WHEN size / 10.0 - 0.0065 * (size * 20 - 300) >= 2 THEN 'rain' WHEN size / 10.0 - 0.0065 * (size * 20 - 300) <= 0 THEN 'snow' ELSE 'unknown' END AS falls, round(20 * least(size / 30.0, 1) ** 0.8, 6) AS bowl,
      CASE WHEN id % 3 = 0 THEN greatest(size / 100.0, 0.05) WHEN id % 3 = 1 THEN greatest(size / 100.0 - 0.3, 0) ELSE size / 100.0 END AS snow, CASE id % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE CASE WHEN size / 100.0 >= 0.3 THEN true END END AS ice FROM {buildings}""",
)
def water_and_climate(read):
    """SC-50, SC-52, SC-53, SC-54, SC-55, SC-56: depths, thickness, codecs, lapse, snow, ice."""
    s, k = F.col("size").cast("double"), F.col("id")
    seen = F.when(k % 3 == 0, "snow").when(k % 3 == 1, "bare")
    ice = F.when(k % 4 == 0, "ice").when(k % 4 == 1, "open")
    return read("buildings").select(
        "id", *_round({"river": physics.river_depth(s), "lake": physics.lake_depth(s / 10), "glacier": physics.glacier_thickness(s)}, 6), physics.code_temperature(s - 10).alias("t_code"), physics.code_rain(s).alias("rain_code"),
        F.round(physics.to_sea_level(s, s * 10), 6).alias("sea_level"), physics.precipitation_at(s / 10, F.lit(300.0), s * 20).alias("falls"), F.round(physics.bowl(F.lit(20.0), s, F.lit(30.0)), 6).alias("bowl"),
        physics.corrected_snow(s / 100, seen).alias("snow"), physics.ice_on_water(ice, s / 100).alias("ice"),
    )


@query(
    "sc47_sc48_sc62_sc68_colours",
    """WITH c AS (SELECT r, c, (value + 1000) % 256 AS red, (value * 3 + 4000) % 256 AS green, (value * 7 + 9000) % 256 AS blue, value FROM {grid} WHERE value IS NOT NULL)
    SELECT r, c, CAST(floor(red / 8.0) * 2048 + floor(green / 4.0) * 32 + floor(blue / 8.0) AS BIGINT) AS rgb565, (red - 120) ** 2 + (green - 110) ** 2 + (blue - 100) ** 2 AS distance, round(red * 256 + green + blue / 256.0 - 32768, 6) AS elevation,
      round((10 + value * 2.0 ** -3) / 10.0 ** 2, 6) AS packed, round(CASE WHEN value < -100 THEN 0 + 50 * (greatest(value, -400) + 400) / 300.0 WHEN value < 200 THEN 50 + 150 * (value + 100) / 300.0 WHEN value < 400 THEN 200 + 55 * (value - 200) / 200.0 ELSE 255 END, 6) AS tint,
      round(CASE WHEN greatest(red, green, blue) = 0 THEN 0 ELSE (greatest(red, green, blue) - least(red, green, blue)) / CAST(greatest(red, green, blue) AS DOUBLE) END, 6) AS saturation FROM c""",
)
def colours(read):
    """SC-11 of sources, SC-47, SC-48, SC-62, SC-68: packed colours, ramps, HSV, palette distance, encoded pixels."""
    v = F.col("value")
    c = read("grid").where("value is not null").select("r", "c", "value", F.pmod(v + 1000, F.lit(256)).alias("red"), F.pmod(v * 3 + 4000, F.lit(256)).alias("green"), F.pmod(v * 7 + 9000, F.lit(256)).alias("blue"))
    r, g, b = F.col("red"), F.col("green"), F.col("blue")
    return c.select(
        "r", "c", physics.rgb565(r, g, b).cast("bigint").alias("rgb565"), physics.palette_distance(r, g, b, F.lit(120), F.lit(110), F.lit(100)).cast("double").alias("distance"), F.round(physics.elevation_of_rgb(r, g, b), 6).alias("elevation"),
        F.round(physics.packed_value(F.lit(10.0), F.lit(-3.0), F.lit(2.0), v), 6).alias("packed"), F.round(physics.ramp(v.cast("double"), [(-400.0, 0.0), (-100.0, 50.0), (200.0, 200.0), (400.0, 255.0)]), 6).alias("tint"), F.round(physics.hsv(r, g, b)[1], 6).alias("saturation"),
    )


@query(
    "sc57_sc58_sun_and_moon",
    """WITH e AS (SELECT event_id, epoch(ts) AS s, lon_e7 / 1e7 AS lon, lat_e7 / 1e7 AS lat, dayofyear(ts) AS d FROM {observations}), f AS (SELECT *, -asin(0.39779 * cos(radians(0.98565 * (d + 10) + 1.914 * sin(radians(0.98565 * (d - 2)))))) AS dec FROM e)
    SELECT event_id, round(s / 86400.0 + 2440587.5, 6) AS julian, round(degrees(dec), 6) AS declination, round(least(greatest(degrees(acos(least(greatest(-tan(radians(lat)) * tan(dec), -1), 1))) * 2 / 15, 1), 23), 6) AS day_hours, CAST(floor(lon / 15 + 0.5) AS BIGINT) AS utc_offset,
      CAST((floor(((s / 86400.0 + 2440587.5 - 2451550.1) % 29.530588853) / 29.530588853 * 8 + 0.5) + 4) % 8 AS BIGINT) AS moon FROM f""",
)
def sun_and_moon(read):
    """SC-57, SC-58: Julian day, declination, day length, moon phase, UTC offset."""
    o = read("observations")
    s, d = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6, F.dayofyear("ts")
    lat = F.col("lat_e7") / 1e7
    return o.select("event_id", F.round(physics.julian_day(s), 6).alias("julian"), F.round(physics.declination(d), 6).alias("declination"), F.round(physics.day_hours(lat, d), 6).alias("day_hours"), physics.utc_offset(F.col("lon_e7") / 1e7).alias("utc_offset"), physics.moon_phase(s).alias("moon"))


@query("sc61_vertical_mapping", "SELECT r, c, round(CASE WHEN value <= 100 THEN value ELSE 100 + 200 * (1 - exp(-(value - 100) / 200.0)) END, 6) AS y FROM {grid} WHERE value IS NOT NULL")
def vertical(read):
    """SC-61: linear to a knee, then a soft ceiling."""
    return read("grid").where("value is not null").select("r", "c", F.round(physics.soft_vertical(F.col("value").cast("double")), 6).alias("y"))


@query("sc63_cell_jitter", "SELECT r, c, round(((r * 73856093 + c * 19349663) % 2147483647) / 2147483647.0, 9) AS a, round(((r * 73856093 + c * 19349663) % 2147483647 * 48271 % 2147483647) / 2147483647.0, 9) AS b FROM {grid}")
def jitter(read):
    """SC-63: two deterministic draws for each cell."""
    a, b = physics.cell_jitter(F.col("r"), F.col("c"))
    return read("grid").select("r", "c", F.round(a, 9).alias("a"), F.round(b, 9).alias("b"))


@query("sc64_synthetic_ids")
def synthetic_ids(read):
    """SC-64: stable ids from strings, in the range from 2^62."""
    masked = F.xxhash64("name").bitwiseAND(F.lit((1 << 62) - 1)).bitwiseOR(F.lit(1 << 62))
    return read("places").select("place_id", masked.alias("synthetic_id"))


@query(
    "sc65_outlines",
    "SELECT place_id, i AS vertex, round(lat_e7 / 1e7 + 2 * cos(i * 2 * pi() / 8) / 111.32, 7) AS lat, round(lon_e7 / 1e7 + 2 * sin(i * 2 * pi() / 8) / (111.32 * cos(radians(lat_e7 / 1e7))), 7) AS lon FROM {places}, range(8) t(i)",
)
def outlines(read):
    """SC-65: a circle of eight vertices round each place."""
    ring = geometry.circle_outline(F.col("lat_e7") / 1e7, F.col("lon_e7") / 1e7, F.lit(2.0), 8)
    return read("places").select("place_id", F.posexplode(ring).alias("vertex", "v")).select("place_id", F.col("vertex").cast("bigint").alias("vertex"), F.round("v.lat", 7).alias("lat"), F.round("v.lon", 7).alias("lon"))


@query("src16_storage_usage", "SELECT prefix, count(*) AS files, sum(size) AS bytes FROM (SELECT path, size, max_by(prefix, length(prefix)) AS prefix FROM {files} JOIN {data_sources} ON starts_with(path, prefix || '_') GROUP BY path, size) GROUP BY prefix")
def storage(read):
    """SRC-16: files and bytes by the source with the longest matching prefix.

    A path has few prefixes, those before its underscores, so the join is on equality.
    """
    parts = F.split("path", "_")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "_"))
    tried = read("files").withColumn("prefix", F.explode(prefixes)).join(read("data_sources"), "prefix")
    owner = tried.groupBy("path", "size").agg(F.max_by("prefix", F.length("prefix")).alias("prefix"))
    return owner.groupBy("prefix").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
