"""Queries over tags, categories, codes and colours."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoloom.functions import physics, tags
from geoloom.plans.register import query
from geoloom.sources import fixtures


def _cycle(values: list[str], prime: int, blanks: int) -> str:
    picks = " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values))
    return f"CASE (id * {prime}) % {len(values) + blanks} {picks} END"


_KEYS = {"landuse": 3, "natural": 5, "leisure": 7, "amenity": 11, "highway": 13, "place": 17, "aeroway": 19, "man_made": 23}
_MORE = {"leaf_type": (list(tags.LEAF), 29, 1), "wetland": (list(tags.WET), 31, 1), "surface": (list(tags.PITCH_SURFACE), 37, 2), "area": (["yes", "no"], 41, 5), "building": (["house", "garage", "church", "apartments"], 43, 4), "power": (["line", "plant"], 47, 6)}
fixtures.SQL["tagged"] = "SELECT id, size, " + ", ".join([f"{_cycle(list(tags.LAND_COVER[k]), p, 4 * len(tags.LAND_COVER[k]))} AS {k}" for k, p in _KEYS.items()] + [f"{_cycle(*spec)} AS {k}" for k, spec in _MORE.items()]) + " FROM {buildings}"


def _case(column: str, table: dict[str, str]) -> str:
    return f'CASE "{column}" ' + " ".join(f"WHEN '{v}' THEN '{c}'" for v, c in table.items()) + " END"


def _tag(key):
    return F.col(key) if key in _KEYS or key in _MORE else F.lit(None).cast("string")


_FIRST = "coalesce(" + ", ".join(_case(k, t) for k, t in tags.LAND_COVER.items()) + ")"


@query(
    "sc39_land_cover",
    f"""WITH f AS (SELECT *, {_FIRST} AS f FROM {{tagged}}) SELECT id, CASE f WHEN 'FOREST' THEN coalesce({_case("leaf_type", tags.LEAF)}, f) WHEN 'WETLAND' THEN coalesce({_case("wetland", tags.WET)}, f) WHEN 'PITCH' THEN coalesce({_case("surface", tags.PITCH_SURFACE)}, f) ELSE f END AS cover FROM f""",
)
def land_cover(read):
    """SC-39: land-cover class of the tags."""
    return read("tagged").select("id", tags.land_cover(_tag).alias("cover"))


@query("sc40_satellite_cover", """SELECT r, c, CASE class * 10 WHEN 10 THEN 'FOREST' WHEN 20 THEN 'SCRUB' WHEN 30 THEN 'MEADOW' WHEN 40 THEN 'FARMLAND' WHEN 50 THEN 'RESIDENTIAL' WHEN 60 THEN CASE WHEN abs(r - 30) < 35 AND (r % 7 = 0 OR c * 40 < 1500) THEN 'SAND' ELSE 'BARE_ROCK' END WHEN 70 THEN 'GLACIER' WHEN 90 THEN 'WETLAND' WHEN 100 THEN 'HEATH' END AS cover FROM {grid_class}""")
def satellite(read):
    """SC-40: class of a satellite code."""
    elevation = F.when(F.col("r") % 7 != 0, F.col("c") * 40)
    return read("grid_class").select("r", "c", tags.satellite_cover(F.col("class") * 10, F.col("r") - 30, elevation).alias("cover"))


@query("sc29_is_area", """SELECT id, CASE WHEN area = 'no' THEN false WHEN area = 'yes' THEN true WHEN highway IS NOT NULL OR coalesce("natural", '') IN ('coastline', 'cliff') OR coalesce(man_made, '') IN ('breakwater', 'groyne') OR power = 'line' THEN false ELSE coalesce(landuse, "natural", leisure, amenity, place, aeroway, man_made, building, power) IS NOT NULL END AS is_area FROM {tagged}""")
def area_test(read):
    """SC-29: whether a closed way is a polygon."""
    return read("tagged").select("id", tags.is_area(_tag).alias("is_area"))


#: Categories as a place source writes them, and the tags they have to get, stated by hand.
PLACE_CASES = [
    ("cafe", "amenity=cafe"), ("internet_cafe", "amenity=cafe"), ("cafeteria", "amenity=restaurant"), ("bar", "amenity=bar"), ("barber", "shop=hairdresser"), ("gastropub", "amenity=bar"), ("public_library", "amenity=library"), ("preschool", "amenity=kindergarten"), ("high_school", "amenity=school"),
    ("veterinarian", "amenity=veterinary"), ("animal_hospital", "amenity=hospital"), ("Hotel", "tourism=hotel"), ("beach_resort", "tourism=hotel"), ("art_museum", "tourism=museum"), ("movie_theater", "amenity=cinema"), ("comedy_club", "amenity=theatre"), ("night_club", "amenity=nightclub"), ("medical_center", "amenity=hospital"),
    ("bike_shop", "shop=bicycle"), ("sporting_goods", "shop=sports"), ("shoe_store", "shop=shoes"), ("lamp_store", "shop=yes"), ("professional_services", "office=yes"), ("fire_department", "amenity=fire_station"), ("mall", "shop=mall"), ("small", None), ("embassy", "amenity=townhall"), ("unheard_of", None), ("bowling_alley", "leisure=sports_centre"), ("law_firm", "office=yes"),
]
_CASES = ", ".join(f"({k}, '{c}', {repr(t) if t else 'NULL'})" for k, (c, t) in enumerate(PLACE_CASES))


@query("sc34_place_tags", f"""WITH k(k, category, tag) AS (VALUES {_CASES}), a AS (SELECT place_id, p.tag AS own, CASE WHEN place_id % 3 = 0 THEN q.tag END AS other FROM {{places}} JOIN k p ON p.k = place_id % {len(PLACE_CASES)} JOIN k q ON q.k = (place_id + 7) % {len(PLACE_CASES)} WHERE confidence >= 0.35)
    SELECT place_id, CASE WHEN (own IS NULL OR own IN ('office=yes', 'shop=yes')) AND other IS NOT NULL AND other NOT IN ('office=yes', 'shop=yes') THEN other ELSE own END AS tag FROM a""")
def place_tags(read):
    """SC-34, FL-07, SRC-07: category to tag; an unknown or generic primary yields to a specific alternate."""
    names = F.array(*[F.lit(c) for c, _ in PLACE_CASES])
    at = lambda k: F.get(names, F.pmod(F.col("place_id") + k, F.lit(len(PLACE_CASES))).cast("int"))
    others = F.when(F.col("place_id") % 3 == 0, F.array(F.lit("nothing"), at(7))).otherwise(F.array(F.lit("nothing")))
    return read("places").where("confidence >= 0.35").select("place_id", tags.place_tag(at(0), others).alias("tag"))


#: Tags of a way (key, value), lanes, and by hand: kind, priority, width, major, clearance over the ground, and over the way itself.
WAY_CASES = [
    ("highway", "motorway", 0, "ROAD", 100, 16.0, True, 5.0, 5.5), ("highway", "motorway", 4, "ROAD", 100, 14.0, True, 5.0, 5.5), ("highway", "secondary_link", 0, "ROAD", 70, 6.0, True, 5.0, 5.5), ("highway", "residential", 2, "ROAD", 55, 7.5, False, 3.0, 5.5), ("highway", "service", 0, "ROAD", 45, 4.0, False, 3.0, 5.5),
    ("highway", "track", 2, "TRACK", 35, 3.0, False, 2.0, 3.5), ("highway", "steps", 0, "STEPS", 28, 2.0, False, 2.0, 3.5), ("highway", "cycleway", 0, "PATH", 30, 2.5, False, 2.0, 3.5), ("highway", "path", 0, "PATH", 20, 1.5, False, 2.0, 3.5), ("highway", "platform", 0, None, 10, None, False, 2.0, 5.5),
    ("railway", "rail", 0, "RAIL", 58, 3.5, True, 5.0, 6.5), ("railway", "tram", 0, "RAIL", 58, 2.5, True, 5.0, 6.5), ("railway", "abandoned", 0, None, 58, None, False, 2.0, 5.5), ("aeroway", "runway", 0, "RUNWAY", 99, 45.0, True, 2.0, 5.5), ("aeroway", "taxiway", 0, "TAXIWAY", 99, 23.0, False, 2.0, 5.5),
    ("man_made", "breakwater", 0, "PIER", 42, 5.0, False, 2.0, 5.5), ("man_made", "pier", 0, "PIER", 42, 3.0, False, 2.0, 5.5), ("leisure", "track", 0, "PATH", 15, 1.5, False, 2.0, 3.5), ("waterway", "river", 0, None, 15, None, False, 2.0, 5.5),
]
_sql = lambda v: "NULL" if v is None else f"'{v}'" if isinstance(v, str) else str(v)
_WAYS = ", ".join(f"({k}, {', '.join(_sql(v) for v in case[3:])})" for k, case in enumerate(WAY_CASES))


@query("sc42_sc43_roads", f"""WITH k(k, kind, priority, width, major, ground, over_it) AS (VALUES {_WAYS}) SELECT way_id, CASE WHEN bridge = 'yes' THEN greatest(layer, 1) WHEN way_id % 7 = 0 THEN least(layer, -1) ELSE layer END AS level, k.kind, k.priority, CAST(k.width AS DOUBLE) AS width, k.major, CAST(ground AS DOUBLE) AS ground, CAST(over_it AS DOUBLE) AS over_it FROM {{ways}} JOIN k ON k.k = way_id % {len(WAY_CASES)}""")
def roads(read):
    """SC-42, SC-43: kind, draw priority, default width, the coarse map's choice, layer and clearances."""
    at = F.pmod(F.col("way_id"), F.lit(len(WAY_CASES))).cast("int")
    of = lambda k: F.get(F.array(*[F.lit(case[k]) for case in WAY_CASES]), at)
    w = read("ways").select("way_id", "bridge", "layer", of(0).alias("key"), of(1).alias("value"), of(2).alias("lanes"))
    tag = lambda key: F.when(F.col("key") == key, F.col("value"))
    kind, tunnel = tags.way_kind(tag), F.when(F.col("way_id") % 7 == 0, "yes")
    width = tags.road_width(kind, tag("highway"), F.col("lanes"), tag("railway"), tag("man_made"))
    return w.select(
        "way_id", tags.layer(F.col("bridge"), tunnel, F.col("layer")).alias("level"), kind.alias("kind"), tags.draw_priority(tag).alias("priority"), width.alias("width"),
        tags.is_major(kind, tag("highway")).alias("major"), tags.bridge_clearance(kind, tag("highway")).alias("ground"), tags.clearance_over(kind).alias("over_it"),
    )


@query(
    "sc47_ground_class",
    """WITH c AS (SELECT r, c, (value + 1000) % 256 AS red, (value * 3 + 4000) % 256 AS green, (value * 7 + 9000) % 256 AS blue FROM {grid} WHERE value IS NOT NULL), m AS (SELECT *, greatest(red, green, blue) AS hi, CAST(greatest(red, green, blue) - least(red, green, blue) AS DOUBLE) AS d FROM c),
    k AS (SELECT *, CASE WHEN d = 0 THEN 0 WHEN hi = red THEN ((green - blue) * 60 / d + 360) % 360 WHEN hi = green THEN (blue - red) * 60 / d + 120 ELSE (red - green) * 60 / d + 240 END AS h, CASE WHEN hi = 0 THEN 0 ELSE d / hi END AS s, hi / 255.0 AS v, (green - greatest(red, blue)) / 255.0 AS veg FROM m)
    SELECT r, c, CASE WHEN veg > 0.04 AND s > 0.15 AND h > 60 AND h < 170 THEN CASE WHEN v < 0.42 THEN 'TREE_CANOPY' ELSE 'GRASS' END WHEN v > 0.9 AND s < 0.12 THEN 'SNOW' WHEN s < 0.16 THEN CASE WHEN v < 0.55 THEN 'PAVED_DARK' ELSE 'PAVED_LIGHT' END
      WHEN h BETWEEN 180 AND 260 AND s > 0.25 AND v > 0.15 THEN 'WATER' WHEN h BETWEEN 10 AND 55 AND s > 0.18 THEN CASE WHEN v > 0.72 AND s < 0.45 THEN 'SAND' ELSE 'BARE_SOIL' END WHEN v < 0.25 THEN 'PAVED_DARK' WHEN s < 0.28 AND v > 0.45 THEN 'ROCK' ELSE 'UNKNOWN' END AS ground FROM k""",
)
def ground(read):
    """SC-47: ground class of a colour."""
    v = F.col("value")
    r, g, b = F.pmod(v + 1000, F.lit(256)), F.pmod(v * 3 + 4000, F.lit(256)), F.pmod(v * 7 + 9000, F.lit(256))
    return read("grid").where("value is not null").select("r", "c", r.alias("red"), g.alias("green"), b.alias("blue")).select("r", "c", tags.ground_class(F.col("red"), F.col("green"), F.col("blue")).alias("ground"))


@query("sc45_default_levels", """WITH d AS (SELECT id, building, ((id % 1000003) * 7919 + 104729) % 1000003 AS d FROM {buildings}) SELECT id, CAST(CASE building WHEN 'garage' THEN 1 WHEN 'house' THEN 1 + d % 2 WHEN 'apartments' THEN 3 + d % 4 WHEN 'church' THEN 1 ELSE 2 + d % 2 END AS BIGINT) AS levels FROM d""")
def levels(read):
    """SC-45: storeys by type and a draw of the id."""
    return read("buildings").select("id", tags.default_levels(F.col("building"), F.col("id")).cast("bigint").alias("levels"))


@query("fl04_fl06_boxes_and_ranges", """SELECT way_id, floor(min(lat_e7) / 1e6) * 0.1 - 0.005 AS south, ceil(max(lon_e7) / 1e6) * 0.1 + 0.005 AS east FROM {way_points} GROUP BY 1 HAVING max(lat_e7) - min(lat_e7) BETWEEN 2000 AND 5000""")
def snapped(read):
    """FL-04, FL-06: boxes snapped outward to cells and a margin; ranges of measurements."""
    p = read("way_points").groupBy("way_id")
    boxed = p.agg((F.floor(F.min("lat_e7") / 1e6) * 0.1 - 0.005).alias("south"), (F.ceil(F.max("lon_e7") / 1e6) * 0.1 + 0.005).alias("east"), (F.max("lat_e7") - F.min("lat_e7")).alias("tall"))
    return boxed.where(F.col("tall").between(2000, 5000)).drop("tall")


@query("src11_tile_pixels", "SELECT r, c, CAST(floor((least(greatest(value, 0), 200) + 32768) / 256.0) AS BIGINT) AS red, CAST(floor((least(greatest(value, 0), 200) + 32768)) % 256 AS BIGINT) AS green, CAST(least(greatest(value, 0), 200) AS DOUBLE) AS again FROM {grid} WHERE value IS NOT NULL")
def pixels(read):
    """SRC-11: heights to encoded pixels and back."""
    red, green, blue = physics.rgb_of_elevation(F.col("value").cast("double"))
    p = read("grid").where("value is not null").select("r", "c", red.alias("red"), green.alias("green"), blue.alias("blue"))
    return p.select("r", "c", F.col("red").cast("bigint").alias("red"), F.col("green").cast("bigint").alias("green"), physics.elevation_of_rgb(F.col("red"), F.col("green"), F.col("blue")).cast("double").alias("again"))


fixtures.SQL["waters"] = "SELECT id, size, " + ", ".join(f"{_cycle(v, p, b)} AS {k}" for k, v, p, b in (("water", list(tags.WATER), 3, 9), ("natural", ["water", "bay", "wood"], 5, 3), ("landuse", ["reservoir", "basin", "forest"], 7, 8), ("leisure", ["swimming_pool", "park"], 11, 9), ("waterway", ["dock", "riverbank", "river"], 13, 12), ("tidal", ["yes", "no"], 17, 7), ("name", ["Oslofjord", "Old Sound", "Lake"], 19, 6))) + " FROM {buildings}"


@query(
    "sc41_water_kind",
    f"""SELECT id, CASE WHEN leisure = 'swimming_pool' THEN 'SWIMMING_POOL' WHEN waterway = 'dock' THEN 'SEA' WHEN waterway = 'riverbank' THEN 'RIVER' WHEN landuse = 'reservoir' THEN 'RESERVOIR' WHEN landuse = 'basin' THEN 'BASIN' WHEN "natural" = 'bay' THEN 'SEA' WHEN water IS NOT NULL THEN {_case("water", tags.WATER)} WHEN "natural" = 'water' THEN 'LAKE' END AS kind,
      coalesce(tidal = 'yes', false) OR coalesce({_case("water", tags.WATER)} = 'SEA', false) OR coalesce("natural" = 'bay', false) OR coalesce(name IN ('Oslofjord', 'Old Sound'), false) AS tidal FROM {{waters}}""",
)
def waters(read):
    """SC-41: kind of a water area and the tidal test."""
    tag = lambda k: F.col(k) if k in ("water", "natural", "landuse", "leisure", "waterway", "tidal", "name") else F.lit(None).cast("string")
    return read("waters").select("id", tags.water_kind(tag).alias("kind"), tags.is_tidal(tag).alias("tidal"))


_ROCKS = [("Granodiorite and gneiss", "GRANITE"), ("granitic gneiss", "GNEISS"), ("mafic-intermediate volcanic rocks", "BASALT"), ("basaltic andesite", "VOLCANIC"), ("Kalkstein, Mergel", "MARBLE"), ("alluvial sand", "LOOSE"), ("roches métamorphiques", "GNEISS"), ("nothing known", None), ("esquistos y pizarras", "SCHIST"), ("dépôts de plage", None)]
fixtures.SQL["descriptions"] = "SELECT id, CASE id % 10 " + " ".join(f"WHEN {k} THEN '{t}'" for k, (t, _) in enumerate(_ROCKS)) + " END AS text FROM {buildings}"


@query("sc37_rocks", "SELECT id, CASE id % 10 " + " ".join(f"WHEN {k} THEN '{r}'" for k, (_, r) in enumerate(_ROCKS) if r) + " END AS rock FROM {buildings}")
def rocks(read):
    """SC-37: the rock of a description, against answers worked out by hand."""
    return read("descriptions").select("id", tags.rock(F.col("text")).alias("rock"))


@query("sc49_ag28_roofs_and_channels", """WITH c AS (SELECT r, c, (value + 1000) % 256 AS v, (value * 3 + 4000) % 256 AS street, (value + 700) % 150 AS lum FROM {grid} WHERE value IS NOT NULL) SELECT r, c, CAST(CASE WHEN lum < 8 THEN v ELSE least(greatest(floor(88 * ((v * lum / CAST(greatest(street, 1) AS DOUBLE)) / lum) ** 1.3 + 0.5), 0), 255) END AS BIGINT) AS roof, CAST(greatest(floor(6 * (1 - least((c % 9) / 6.0, 1) ** 2) + 0.5), 1) AS BIGINT) AS depth FROM c""")
def roofs(read):
    """SC-49, AG-28: roof colour by the street's colour, parabolic channel bed."""
    v = F.col("value")
    c = read("grid").where("value is not null").select("r", "c", F.pmod(v + 1000, F.lit(256)).alias("v"), F.pmod(v * 3 + 4000, F.lit(256)).alias("street"), F.pmod(v + 700, F.lit(150)).alias("lum"))
    return c.select("r", "c", physics.roof_colour(F.col("v"), F.col("street"), F.col("lum")).cast("bigint").alias("roof"), physics.channel_depth(F.lit(6.0), F.col("c") % 9, F.lit(5.0)).cast("bigint").alias("depth"))


_KG = [*physics.KOEPPEN, "BSk", "Dfb", "ET", "Cfb"]
fixtures.SQL["climates"] = "SELECT id, CAST(size AS DOUBLE) - 20 AS t, CAST(id * 37 % 5200 AS DOUBLE) AS elev, CAST(id % 80 AS DOUBLE) AS lat, CAST(id * 11 % 900 AS DOUBLE) AS rain, CAST(id * 13 % 1400 - 700 AS DOUBLE) AS dz, " + _cycle(_KG, 7, 0) + " AS kg FROM {buildings}"
_RANK = "CASE {z} WHEN 'ICE_CAP' THEN 0 WHEN 'TUNDRA' THEN 1 WHEN 'ALPINE' THEN 1 WHEN 'TAIGA' THEN 2 WHEN 'TEMPERATE' THEN 3 ELSE 4 END"


@query(
    "sc51_climate_zones",
    f"""WITH z AS (SELECT *, CASE kg WHEN 'BSk' THEN CASE WHEN rain < 250 THEN 'ARID' WHEN t >= 15 THEN 'SAVANNA' ELSE 'TEMPERATE' END WHEN 'Dfb' THEN CASE WHEN t < 4 THEN 'TAIGA' ELSE 'TEMPERATE' END WHEN 'ET' THEN CASE WHEN elev > 1500 AND lat < 60 THEN 'ALPINE' ELSE 'TUNDRA' END ELSE coalesce({_case("kg", physics.KOEPPEN)}, 'TEMPERATE') END AS z,
      CASE WHEN t < -6 OR elev > 4800 THEN 'ICE_CAP' WHEN elev > 2600 AND t < 8 THEN 'ALPINE' WHEN t < 1 THEN 'TUNDRA' WHEN t < 7.5 THEN 'TAIGA' WHEN t < 16 THEN 'TEMPERATE' END AS o FROM {{climates}})
    SELECT id, CASE WHEN (dz > 400 OR elev > 2600) AND o IS NOT NULL AND {_RANK.replace("{z}", "o")} < {_RANK.replace("{z}", "z")} THEN o WHEN NOT (dz > 400 OR elev > 2600) AND dz < -400 AND o IS NOT NULL AND {_RANK.replace("{z}", "o")} > {_RANK.replace("{z}", "z")} THEN o ELSE z END AS zone FROM z""",
)
def zones(read):
    """SC-51: climate zone by class, temperature, height and rain."""
    return read("climates").select("id", physics.climate_zone(F.col("kg"), F.col("t"), F.col("elev"), F.col("lat"), F.col("rain"), F.col("dz")).alias("zone"))


_SITE = {
    "natural": (["tree", "shrub", "water"], 3, 7), "highway": (["street_lamp", "traffic_signals", "crossing", "bus_stop", "primary"], 7, 8), "amenity": (["bench", "fountain", "waste_basket", "shelter", "place_of_worship", "planetarium"], 11, 7), "power": (["tower", "pole", "line"], 13, 8),
    "man_made": (["flagpole", "mast", "tower", "communications_tower", "lighthouse", "dome", "observatory", "minaret"], 17, 5), "barrier": (["bollard", "fence"], 19, 7), "historic": ([*tags.MONUMENTS, "wayside_cross", "castle"], 23, 16), "cemetery": (["grave", "sector"], 29, 9),
    "genus": (["Quercus", "picea", "Pinus", "populus", "Betula", "prunus", "phoenix", "Ficus", "acacia", "Rosa"], 31, 7), "species": (["Tilia cordata", "Larix decidua"], 37, 3), "leaf_type": (["needleleaved", "broadleaved"], 41, 3),
    "material": (["metal", "steel", "concrete", "stone", "wood", "brick"], 43, 5), "fence_type": (["chain_link", "wire", "wood", "split_rail", "hedge"], 47, 4), "wall": (["brick", "noise_barrier", "dry_stone"], 53, 4),
    "building": ([*tags.SOLID_TYPES, "gurdwara", "mosque", "shrine", "religious", "house", "tower", "carport", "minaret"], 59, 10), "building:part": (["dome", "yes", "minaret"], 61, 14), "roof:shape": (["dome", "onion", "flat"], 67, 10), "dome": (["yes", "no"], 71, 9),
    "religion": (["sikh", "muslim", "christian"], 73, 2), "tower:type": (["minaret", "bell_tower"], 79, 9), "name": (["Old Minaret", "منارة قديمة", "Tower"], 83, 2),
}
fixtures.SQL["site_tags"] = "SELECT id, " + ", ".join(f"{_cycle(*spec)} AS {key.replace(':', '_')}" for key, spec in _SITE.items()) + " FROM {buildings}"


def _site(key):
    return F.col(key.replace(":", "_"))


@query(
    "sc44_furniture",
    """WITH g AS (SELECT *, lower(coalesce(genus, species)) AS g FROM {site_tags}) SELECT id,
    CASE WHEN "natural" = 'tree' THEN 'TREE' WHEN "natural" = 'shrub' THEN 'BUSH' WHEN highway IN ('traffic_signals', 'crossing', 'bus_stop') THEN rtrim(upper(highway), 'S')
      WHEN highway = 'street_lamp' THEN 'LAMP' WHEN amenity IN ('bench', 'fountain', 'waste_basket', 'shelter') THEN upper(amenity) WHEN power IN ('tower', 'pole') THEN 'POWER_' || upper(power) WHEN man_made IN ('flagpole', 'lighthouse') THEN upper(man_made)
      WHEN man_made IN ('mast', 'tower', 'communications_tower') THEN 'MAST' WHEN barrier = 'bollard' THEN 'BOLLARD' WHEN historic = 'wayside_cross' OR cemetery = 'grave' THEN 'CROSS' END AS kind,
    CASE WHEN g LIKE 'picea%' OR g LIKE 'larix%' THEN 'SPRUCE' WHEN g LIKE 'pinus%' THEN 'PINE' WHEN g LIKE 'populus%' THEN 'POPLAR' WHEN g LIKE 'betula%' THEN 'BIRCH' WHEN g LIKE 'prunus%' THEN 'CHERRY' WHEN g LIKE 'quercus%' OR g LIKE 'tilia%' THEN 'OAK'
      WHEN g LIKE 'phoenix%' THEN 'PALM' WHEN g LIKE 'ficus%' THEN 'JUNGLE' WHEN g LIKE 'acacia%' THEN 'ACACIA' WHEN leaf_type = 'needleleaved' THEN 'SPRUCE' WHEN leaf_type = 'broadleaved' THEN 'OAK' ELSE 'AUTO' END AS species,
    CASE WHEN fence_type IN ('chain_link', 'wire') OR material IN ('metal', 'steel') THEN 'METAL' WHEN material IN ('concrete', 'stone') THEN 'STONE' WHEN material = 'wood' OR fence_type IN ('wood', 'split_rail') THEN 'WOOD' ELSE 'METAL' END AS fence,
    CASE WHEN material = 'brick' OR wall = 'brick' THEN 'BRICK' WHEN material = 'concrete' OR wall = 'noise_barrier' THEN 'CONCRETE' ELSE 'STONE' END AS built FROM g""",
)
def furniture(read):
    """SC-44: furniture and plants, kinds of trees, materials of fences and walls."""
    t = read("site_tags")
    return t.select("id", tags.furniture(_site).alias("kind"), tags.tree_species(_site).alias("species"), tags.fence_material(_site).alias("fence"), tags.wall_material(_site).alias("built"))


@query(
    "sc66_building_traits",
    """SELECT id, CASE WHEN roof_shape IS NOT NULL THEN roof_shape <> 'flat' ELSE coalesce(dome = 'yes' OR man_made IN ('dome', 'observatory') OR building IN ('gurdwara', 'mosque') OR building_part = 'dome' OR amenity = 'planetarium' OR (amenity = 'place_of_worship' AND religion <> 'christian'), false) END AS domed,
    coalesce('minaret' IN (man_made, tower_type, building, building_part) OR (man_made = 'tower' AND name <> 'Tower'), false) AS minaret, coalesce(building IN ('religious', 'shrine'), false) AS shrine,
    coalesce(historic NOT IN ('wayside_cross', 'castle'), false) OR coalesce(building NOT IN ('gurdwara', 'mosque', 'shrine', 'religious', 'house', 'tower', 'carport', 'minaret'), false) AS solid,
    coalesce(building NOT IN ('tower', 'carport', 'triumphal_arch', 'monument'), true) AS enclosed FROM {site_tags}""",
)
def traits(read):
    """SC-66: domes, minarets, shrines, solid monuments and what is closed below."""
    t = read("site_tags")
    return t.select("id", tags.is_domed(_site).alias("domed"), tags.is_minaret(_site).alias("minaret"), tags.is_shrine(_site).alias("shrine"), tags.is_solid_monument(_site).alias("solid"), tags.is_enclosed(F.col("building")).alias("enclosed"))


_ROOF = "lower(trim(roof_tag))"
_LOT = "CAST(('0x' || md5(CAST(id AS VARCHAR))[:8]) AS BIGINT) % 100"
_KINDS = ["house", "apartments", "church", "garage", "yes", "silo", "water_tower", "barn", "roof", "dormitory", "wall", "office", "mosque", "villa", "kindergarten"]
fixtures.SQL["roof_buildings"] = (
    "SELECT id, CASE id % 9 WHEN 0 THEN ' Hip ' WHEN 1 THEN 'gable' WHEN 2 THEN 'bell' ELSE NULL END AS roof_tag, id % 13 = 0 AS domed, CASE WHEN id % 10 = 0 THEN NULL ELSE id % 8 = 1 END AS part, "
    + "CASE id % 16 " + " ".join(f"WHEN {k} THEN '{t}'" for k, t in enumerate(_KINDS)) + " END AS kind, CASE WHEN id % 7 <> 0 THEN CAST(size % 9 + 1 AS INT) END AS levels, CAST(size % 18 AS DOUBLE) AS half_width FROM {buildings}"
)


@query(
    "sc66_roof_shapes",
    f"""WITH b AS (SELECT *, coalesce(kind, 'yes') AS t, coalesce(levels, 1) AS n, {_LOT} AS r FROM {{roof_buildings}})
    SELECT id, CASE WHEN {_ROOF} IN ('hipped', 'hip') THEN 'hipped' WHEN {_ROOF} = 'gable' THEN 'gabled' WHEN domed THEN 'dome' WHEN part OR t = 'wall' THEN 'flat' WHEN t = 'silo' THEN 'cone' WHEN t = 'water_tower' THEN 'flat' WHEN t IN ('barn', 'church') THEN 'gabled'
      WHEN t = 'garage' THEN CASE WHEN r < 50 THEN 'flat' ELSE 'gabled' END WHEN t = 'roof' THEN CASE WHEN r < 60 THEN 'flat' ELSE 'gabled' END WHEN t IN ('apartments', 'office') THEN 'flat'
      WHEN t = 'dormitory' THEN CASE WHEN n >= 4 THEN 'flat' WHEN r < 60 THEN 'gabled' ELSE 'hipped' END
      WHEN t IN ('house', 'yes', 'villa') THEN CASE WHEN n >= 6 THEN 'flat' WHEN half_width > 14 THEN CASE WHEN r < 50 THEN 'flat' ELSE 'hipped' END WHEN r < 62 THEN 'gabled' WHEN r < 90 THEN 'hipped' ELSE 'flat' END
      WHEN half_width > 12 THEN 'flat' WHEN r < 50 THEN 'gabled' WHEN r < 70 THEN 'hipped' ELSE 'flat' END AS shape FROM b""",
)
def roof_shapes(read):
    """SC-66: roof shape by tag, dome, part, type, levels, width and a lot of the id."""
    c = F.col
    return read("roof_buildings").select("id", tags.default_roof(c("roof_tag"), c("domed"), c("part"), c("kind"), c("levels"), c("half_width"), c("id")).alias("shape"))
