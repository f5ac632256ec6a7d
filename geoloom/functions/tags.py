"""Classification by tags, codes and colours. `tag` is a function from a key to its column (null: no such tag)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Tag = Callable[[str], Column]

# Classes of tag values, key by key in the order in which they decide.
LAND_COVER: dict[str, dict[str, str]] = {
    "landuse": {
        "forest": "FOREST", "grass": "GRASS", "village_green": "GRASS", "recreation_ground": "GRASS", "greenfield": "GRASS", "religious": "GRASS", "flowerbed": "GARDEN", "meadow": "MEADOW", "farmland": "FARMLAND", "greenhouse_horticulture": "FARMLAND",
        "farmyard": "GRAVEL_AREA", "garages": "GRAVEL_AREA", "depot": "GRAVEL_AREA", "orchard": "ORCHARD", "plant_nursery": "ORCHARD", "vineyard": "VINEYARD", "allotments": "ALLOTMENTS", "residential": "RESIDENTIAL", "commercial": "COMMERCIAL", "retail": "RETAIL",
        "industrial": "INDUSTRIAL", "port": "INDUSTRIAL", "railway": "RAILWAY_LAND", "cemetery": "CEMETERY", "construction": "CONSTRUCTION", "brownfield": "CONSTRUCTION", "quarry": "QUARRY", "landfill": "LANDFILL", "military": "MILITARY", "education": "SCHOOL",
    },
    "natural": {
        "wood": "FOREST", "scrub": "SCRUB", "shrubbery": "SCRUB", "heath": "HEATH", "fell": "HEATH", "tundra": "HEATH", "moor": "HEATH", "grassland": "MEADOW", "sand": "SAND", "dune": "SAND", "beach": "BEACH", "bare_rock": "BARE_ROCK", "rock": "BARE_ROCK", "stone": "BARE_ROCK",
        "scree": "SCREE", "blockfield": "SCREE", "shingle": "GRAVEL_AREA", "wetland": "WETLAND", "mud": "MUD", "glacier": "GLACIER", "reef": "REEF",
    },
    "leisure": {
        "park": "PARK", "common": "PARK", "garden": "GARDEN", "pitch": "PITCH", "playground": "PLAYGROUND", "golf_course": "GOLF", "miniature_golf": "GOLF", "sports_centre": "GRASS_SPORT", "stadium": "GRASS_SPORT", "dog_park": "GRASS_SPORT", "recreation_ground": "GRASS_SPORT", "schoolyard": "GRASS_SPORT",
        "track": "PITCH_HARD", "marina": "MARINA", "beach_resort": "BEACH",
    },
    "amenity": {"parking": "PARKING", "school": "SCHOOL", "university": "SCHOOL", "college": "SCHOOL", "kindergarten": "SCHOOL", "hospital": "HOSPITAL", "grave_yard": "CEMETERY", "marketplace": "MARKETPLACE", "bus_station": "PARKING"},
    "highway": {"pedestrian": "PEDESTRIAN", "footway": "PEDESTRIAN", "living_street": "PEDESTRIAN", "services": "PARKING", "rest_area": "PARKING"},
    "place": {"square": "SQUARE"},
    "aeroway": {"apron": "AIRPORT_APRON", "helipad": "AIRPORT_APRON", "heliport": "AIRPORT_APRON", "runway": "RUNWAY", "taxiway": "RUNWAY"},
    "man_made": {"pier": "PIER", "breakwater": "BARE_ROCK", "groyne": "BARE_ROCK", "wastewater_plant": "INDUSTRIAL", "works": "INDUSTRIAL", "water_works": "INDUSTRIAL"},
}
LEAF = {"needleleaved": "FOREST_CONIFER", "broadleaved": "FOREST_BROADLEAF"}
WET = {"tidalflat": "SALT_MARSH", "saltmarsh": "SALT_MARSH", "mud": "MUD"}
PITCH_SURFACE = {"artificial_turf": "PITCH_ARTIFICIAL", "artificial_grass": "PITCH_ARTIFICIAL", "asphalt": "PITCH_HARD", "concrete": "PITCH_HARD", "tartan": "PITCH_HARD", "clay": "PITCH_HARD", "acrylic": "PITCH_HARD", "paved": "PITCH_HARD", "hard": "PITCH_HARD", "rubber": "PITCH_HARD"}
AREA_KEYS = ["building", "building:part", "landuse", "leisure", "amenity", "natural", "water", "place", "aeroway", "military", "tourism", "shop", "office", "historic", "man_made", "power"]
LINE_KEYS = ["highway", "barrier", "waterway", "railway", "route"]
LINEAR = {"natural": ["coastline", "tree_row", "cliff", "ridge", "valley", "arete"], "man_made": ["embankment", "pipeline", "cutline", "dyke", "goods_conveyor", "breakwater", "groyne"], "power": ["line", "minor_line"]}
# Words of a place category and the tag they make; the first rule that matches decides. A word counts
# anywhere in the category; "=word" is all of it, "word$" its end.
CATEGORY_FOOD = [
    ("amenity=fast_food", "fast_food burger pizza kebab sandwich"), ("amenity=bar", "=bar _bar$ pub$ beer_garden brewery lounge"), ("amenity=nightclub", "night_club nightclub dance_club casino"), ("amenity=cafe", "coffee =cafe _cafe tea_room bubble_tea"),
    ("shop=bakery", "bakery patisserie pastry"), ("amenity=ice_cream", "ice_cream dessert chocolat"), ("amenity=restaurant", "restaurant bistro diner steakhouse sushi food_court cafeteria"),
]
CATEGORY_CULTURE = [
    ("tourism=hostel", "hostel"), ("tourism=hotel", "hotel motel bed_and_breakfast resort guest_house lodging"), ("tourism=museum", "museum"), ("tourism=gallery", "art_gallery =gallery art_museum"), ("tourism=aquarium", "aquarium"), ("amenity=cinema", "movie_theater cinema"),
    ("amenity=theatre", "theater theatre performing_arts_venue concert_hall concert_venue opera_house music_venue comedy_club"), ("amenity=library", "library"), ("shop=books", "bookstore book_store"),
]
CATEGORY_HEALTH = [
    ("amenity=pharmacy", "pharmacy drugstore chemist"), ("amenity=hospital", "hospital emergency_room medical_center medical_centre"), ("amenity=dentist", "dentist dental"), ("amenity=doctors", "doctor physician clinic physiotherap chiropract psycholog optometr"),
    ("amenity=veterinary", "veterinar animal_hospital"), ("shop=optician", "optician eyewear"), ("leisure=fitness_centre", "gym fitness yoga pilates crossfit martial_arts boxing"), ("leisure=sports_centre", "sports_club sports_center sports_centre swimming_pool climbing bowling ice_rink"),
]
CATEGORY_SHOPS = [
    ("shop=supermarket", "supermarket grocery hypermarket"), ("shop=convenience", "convenience"), ("shop=department_store", "department_store"), ("shop=mall", "shopping_center shopping_centre shopping_mall =mall"), ("shop=seafood", "seafood fish_market fishmonger"), ("shop=butcher", "butcher meat_shop"),
    ("shop=alcohol", "liquor wine_store wine_shop beverage_store"), ("shop=florist", "florist flower"), ("shop=jewelry", "jewel watch_store"), ("shop=shoes", "shoe"), ("shop=clothes", "clothing fashion boutique apparel lingerie menswear womenswear"),
    ("shop=electronics", "electronics computer mobile_phone cell_phone camera_store"), ("shop=hardware", "hardware home_improvement paint_store tool"), ("shop=furniture", "furniture home_decor interior_design kitchen mattress"), ("shop=toys", "toy game_store hobby"),
    ("shop=bicycle", "bike_shop bicycle"), ("shop=sports", "sporting_goods sports_wear outdoor_gear"), ("shop=hairdresser", "hair barber beauty nail_salon cosmetic spa"), ("shop=tattoo", "tattoo piercing"), ("shop=pet", "pet_store pet_shop"), ("shop=gift", "gift souvenir"),
    ("shop=music", "music_store record_store musical_instrument"), ("shop=stationery", "art_supply craft_store stationery office_supply"), ("shop=travel_agency", "travel_agen"), ("shop=car", "car_dealer auto_dealer"), ("shop=tobacco", "tobacco vape"), ("shop=confectionery", "candy confection"),
    ("shop=second_hand", "thrift second_hand antique vintage"), ("shop=yes", "_store$ _shop$ retail"),
]
CATEGORY_PUBLIC = [
    ("amenity=bank", "bank credit_union currency_exchange"), ("amenity=university", "university college"), ("amenity=kindergarten", "kindergarten preschool day_care child_care"), ("amenity=school", "school education tutoring"),
    ("amenity=place_of_worship", "church cathedral chapel mosque synagogue temple place_of_worship religious"), ("amenity=post_office", "post_office"), ("amenity=police", "police"), ("amenity=fire_station", "fire_station fire_department"), ("amenity=townhall", "city_hall town_hall courthouse embassy"),
    ("office=government", "government public_service public_administration"), ("amenity=community_centre", "community_center community_centre cultural_center cultural_centre event_venue conference"), ("tourism=information", "tourist_information visitor_center visitor_centre"),
    ("office=yes", "lawyer attorney law_firm accountant real_estate insurance consult advertising marketing architect engineering software it_service recruit financial office professional_services business_service media publisher telecommunication energy shipping logistics"),
]
CATEGORY = CATEGORY_FOOD + CATEGORY_CULTURE + CATEGORY_HEALTH + CATEGORY_SHOPS + CATEGORY_PUBLIC
#: Tags that say little: a primary category of one of them yields to an alternate of another tag.
GENERIC = ["office=yes", "shop=yes"]
# Kinds of ways by tag, key by key; draw priorities and default widths in metres; what a coarse map keeps.
WAY_KIND: dict[str, dict[str, str]] = {
    "highway": {
        **dict.fromkeys("motorway trunk primary secondary tertiary unclassified residential motorway_link trunk_link primary_link secondary_link tertiary_link living_street service road busway raceway".split(), "ROAD"),
        "track": "TRACK", **dict.fromkeys("footway path pedestrian cycleway bridleway corridor sidewalk".split(), "PATH"), "steps": "STEPS",
    },
    "railway": dict.fromkeys("rail light_rail narrow_gauge tram monorail preserved miniature funicular disused".split(), "RAIL"),
    "aeroway": {"runway": "RUNWAY", "taxiway": "TAXIWAY"},
    "man_made": dict.fromkeys("pier breakwater groyne".split(), "PIER"),
    "leisure": {"track": "PATH"},
}
DRAW_PRIORITY = {
    "motorway": 100, "trunk": 95, "motorway_link": 90, "trunk_link": 90, "primary": 85, "primary_link": 80, "secondary": 75, "secondary_link": 70, "tertiary": 65, "tertiary_link": 60, "residential": 55, "unclassified": 55, "road": 55, "busway": 55, "raceway": 55,
    "living_street": 50, "service": 45, "pedestrian": 40, "track": 35, "cycleway": 30, "steps": 28, "footway": 25, "sidewalk": 25, "corridor": 25, "bridleway": 20, "path": 20,
}
OTHER_PRIORITY = {"highway": 10, "railway": 58, "aeroway": 99, "man_made": 42}
WAY_WIDTH = {
    "motorway": 16.0, "trunk": 14.0, "primary": 10.0, "secondary": 9.0, "tertiary": 8.0, "motorway_link": 6.0, "trunk_link": 6.0, "primary_link": 6.0, "secondary_link": 6.0, "tertiary_link": 5.0, "residential": 6.0, "unclassified": 6.0, "road": 6.0, "living_street": 5.0, "service": 4.0, "busway": 7.0, "raceway": 12.0,
    "pedestrian": 5.0, "cycleway": 2.5, "footway": 2.0, "sidewalk": 2.0,
}
KIND_WIDTH = {"RAIL": 3.5, "RUNWAY": 45.0, "TAXIWAY": 23.0, "PIER": 3.0, "STEPS": 2.0, "TRACK": 3.0, "PATH": 1.5, "ROAD": 6.0}
MAJOR = ["motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link"]
CLEARANCE_OVER = {"RAIL": 6.5, "PATH": 3.5, "STEPS": 3.5, "TRACK": 3.5}


def mapped(value: Column, table: dict[str, str]) -> Column:
    """The table's class of a value, null for others: values of a class share a branch."""
    classes: dict[str, list[str]] = {}
    for v, c in table.items():
        classes.setdefault(c, []).append(v)
    out = F.lit(None).cast("string")
    for c, values in classes.items():
        out = F.when(value.isin(values), F.lit(c)).otherwise(out)
    return out


def land_cover(tag: Tag) -> Column:
    """The land-cover class: the first key with a classed value decides; some classes look at a further tag."""
    first = F.coalesce(*[mapped(tag(key), table) for key, table in LAND_COVER.items()])
    return (
        F.when(first == "FOREST", F.coalesce(mapped(tag("leaf_type"), LEAF), first))
        .when((first == "WETLAND"), F.coalesce(mapped(tag("wetland"), WET), first))
        .when((first == "PITCH"), F.coalesce(mapped(tag("surface"), PITCH_SURFACE), first))
        .otherwise(first)
    )


def satellite_cover(code: Column, lat: Column, elevation: Column) -> Column:
    """Class of a satellite land-cover code; bare ground is sand only in warm low places."""
    warm = (F.abs(lat) < 35) & (elevation.isNull() | (elevation < 1500))
    bare = F.when(warm, "SAND").otherwise("BARE_ROCK")
    table = {10: "FOREST", 20: "SCRUB", 30: "MEADOW", 40: "FARMLAND", 50: "RESIDENTIAL", 70: "GLACIER", 90: "WETLAND", 95: "WETLAND", 100: "HEATH"}
    out = F.when(code == 60, bare)
    for c, name in table.items():
        out = out.when(code == c, name)
    return out


def is_area(tag: Tag) -> Column:
    """Whether a closed way is a polygon: the area tag, then keys of lines, then linear values, then keys of areas."""
    line = F.lit(False)
    for key in LINE_KEYS:
        line = line | tag(key).isNotNull()
    for key, values in LINEAR.items():
        line = line | F.coalesce(tag(key).isin(values), F.lit(False))
    area = F.lit(False)
    for key in AREA_KEYS:
        area = area | tag(key).isNotNull()
    return F.when(tag("area") == "no", False).when(tag("area") == "yes", True).when(line, False).otherwise(area)


def category_tag(category: Column, rules: list[tuple[str, str]] = CATEGORY) -> Column:
    """The tag of a place category by the first of `rules` that matches, null for unknown ones."""
    out, low = F.lit(None).cast("string"), F.lower(category)
    for name, words in reversed(rules):
        pattern = "|".join(f"^{w[1:]}$" if w[0] == "=" else w for w in words.split())
        out = F.when(low.rlike(pattern), name).otherwise(out)
    return out


def place_tag(primary: Column, alternates: Column) -> Column:
    """The primary category's tag; an unknown or generic one yields to the first alternate of a known tag that is not."""
    own = category_tag(primary)
    better = F.get(F.filter(F.transform(alternates, lambda c: category_tag(c)), lambda t: t.isNotNull() & ~t.isin(GENERIC)), F.lit(0))
    return F.when(own.isNull() | own.isin(GENERIC), F.coalesce(better, own)).otherwise(own)


def way_kind(tag: Tag) -> Column:
    """Kind of a way: the first key that it has decides, but `man_made` and `leisure` only where they give a kind; areas have none."""
    out = F.coalesce(mapped(tag("aeroway"), WAY_KIND["aeroway"]), mapped(tag("man_made"), WAY_KIND["man_made"]), mapped(tag("leisure"), WAY_KIND["leisure"]))
    for key in ("railway", "highway"):
        out = F.when(tag(key).isNotNull(), mapped(tag(key), WAY_KIND[key])).otherwise(out)
    return F.when(F.coalesce(tag("area") == "yes", F.lit(False)), F.lit(None).cast("string")).otherwise(out)


def draw_priority(tag: Tag) -> Column:
    """The greater is drawn over the lesser."""
    out = F.lit(15)
    for key in reversed(OTHER_PRIORITY):
        by_value = F.coalesce(mapped(tag(key), {k: str(v) for k, v in DRAW_PRIORITY.items()}).cast("int"), F.lit(OTHER_PRIORITY[key])) if key == "highway" else F.lit(OTHER_PRIORITY[key])
        out = F.when(tag(key).isNotNull(), by_value).otherwise(out)
    return out


def is_major(kind: Column, highway: Column) -> Column:
    """Whether a coarse map keeps the way: railways, runways and the larger roads."""
    return F.coalesce(kind.isin("RAIL", "RUNWAY") | ((kind == "ROAD") & highway.isin(MAJOR)), F.lit(False))


def bridge_clearance(kind: Column, highway: Column) -> Column:
    """Metres of a bridge over the ground: main roads and railways, other roads, the rest."""
    main = (kind == "ROAD") & highway.rlike("^(motorway|trunk|primary|secondary)")
    return F.when((kind == "RAIL") | F.coalesce(main, F.lit(False)), 5.0).when(kind == "ROAD", 3.0).otherwise(2.0)


def clearance_over(under: Column) -> Column:
    """Metres that a bridge leaves over what passes under it."""
    return F.coalesce(mapped(under, {k: str(v) for k, v in CLEARANCE_OVER.items()}).cast("double"), F.lit(5.5))


def layer(bridge: Column, tunnel: Column, given: Column) -> Column:
    """Layer with bridges at 1 or above and tunnels at -1 or below."""
    own = F.coalesce(given, F.lit(0))
    return F.when(F.coalesce(bridge, F.lit("no")) != "no", F.greatest(own, F.lit(1))).when(F.coalesce(tunnel, F.lit("no")) != "no", F.least(own, F.lit(-1))).otherwise(own)


def road_width(kind: Column, highway: Column, lanes: Column, railway: Column | None = None, man_made: Column | None = None) -> Column:
    """Metres of a way: roads by lanes (3.25 each and one more) where known, else by highway, else by kind; trams and breakwaters differ."""
    by_highway = mapped(highway, {k: str(v) for k, v in WAY_WIDTH.items()}).cast("double")
    by_kind = mapped(kind, {k: str(v) for k, v in KIND_WIDTH.items()}).cast("double")
    out = F.when(kind.isin("ROAD", "PATH"), F.coalesce(by_highway, by_kind)).otherwise(by_kind)
    if railway is not None:
        out = F.when((kind == "RAIL") & F.coalesce(railway == "tram", F.lit(False)), 2.5).otherwise(out)
    if man_made is not None:
        out = F.when((kind == "PIER") & F.coalesce(man_made == "breakwater", F.lit(False)), 5.0).otherwise(out)
    return F.when((kind == "ROAD") & (lanes > 0), lanes * 3.25 + 1).otherwise(out)


def ground_class(r: Column, g: Column, b: Column) -> Column:
    """Ground by hue (degrees), saturation and value of a colour, with a vegetation index first."""
    from geoloom.functions.physics import hsv

    h, s, v = hsv(r, g, b)
    green = (g - F.greatest(r, b)) / 255.0
    return (
        F.when((green > 0.04) & (s > 0.15) & (h > 60) & (h < 170), F.when(v < 0.42, "TREE_CANOPY").otherwise("GRASS"))
        .when((v > 0.9) & (s < 0.12), "SNOW").when(s < 0.16, F.when(v < 0.55, "PAVED_DARK").otherwise("PAVED_LIGHT"))
        .when(h.between(180, 260) & (s > 0.25) & (v > 0.15), "WATER").when(h.between(10, 55) & (s > 0.18), F.when((v > 0.72) & (s < 0.45), "SAND").otherwise("BARE_SOIL"))
        .when(v < 0.25, "PAVED_DARK").when((s < 0.28) & (v > 0.45), "ROCK").otherwise("UNKNOWN")
    )


def default_levels(building: Column, identifier: Column) -> Column:
    """Storeys by type with a deterministic draw of the id; the mixing stays below 2^63."""
    draw = F.pmod(F.pmod(identifier, F.lit(1_000_003)) * 7919 + 104729, F.lit(1_000_003))
    few, many = F.pmod(draw, F.lit(2)), F.pmod(draw, F.lit(4))
    return F.when(building == "garage", 1).when(building == "house", 1 + few).when(building == "apartments", 3 + many).when(building == "church", 1).otherwise(2 + few)


# Kinds of the water tag, and values and words that make water tidal.
WATER = {
    "lake": "LAKE", "oxbow": "LAKE", "pond": "POND", "fishpond": "POND", "moat": "POND", "reflecting_pool": "POND", "pool": "POND", "reservoir": "RESERVOIR", "wastewater": "RESERVOIR", "river": "RIVER", "rapids": "RIVER", "canal": "CANAL", "lock": "CANAL", "stream": "STREAM", "stream_pool": "STREAM",
    "ditch": "DITCH", "drain": "DITCH", "basin": "BASIN", "lagoon": "SEA", "harbour": "SEA", "harbor": "SEA", "bay": "SEA", "fjord": "SEA", "strait": "SEA", "tidal": "SEA", "sea": "SEA", "ocean": "SEA",
}
TIDAL_WORDS = ["fjord", "harbour", "harbor", "sound"]


def water_kind(tag: Tag) -> Column:
    """Kind of a water area, null if it is none."""
    landuse, natural, waterway, water = tag("landuse"), tag("natural"), tag("waterway"), tag("water")
    return (
        F.when(tag("leisure") == "swimming_pool", "SWIMMING_POOL").when(tag("amenity") == "fountain", "FOUNTAIN_BASIN").when(waterway == "dock", "SEA").when(waterway == "riverbank", "RIVER")
        .when(landuse == "reservoir", "RESERVOIR").when(landuse.isin("basin", "salt_pond", "aquaculture"), "BASIN").when(natural.isin("bay", "strait"), "SEA")
        .when(water.isNotNull(), F.coalesce(mapped(water, WATER), F.lit("LAKE"))).when(natural == "water", "LAKE")
    )


def is_tidal(tag: Tag) -> Column:
    said = F.coalesce(~tag("tidal").isin("no", "false", "0"), F.lit(False))
    by_kind = F.coalesce(mapped(tag("water"), WATER) == "SEA", F.lit(False)) | F.coalesce(tag("natural").isin("bay", "strait"), F.lit(False))
    return said | by_kind | F.coalesce(F.lower(tag("name")).rlike("|".join(TIDAL_WORDS)), F.lit(False))


# Stems of rock words by rock, in the order in which they are tried; ^ marks the beginning of a word.
ROCK_STEMS: list[tuple[str, str]] = [
    ("GNEISS", "gneis|gnais|migmatit|granulit|metamorf|metamorph"),
    ("MARBLE", "marbl|marmor|marmo|limestone|calcair|caliz|calcar|kalkstein|^kalk|dolomi|carbonat|chalk|craie|travertin|^lime|gyps|gesso|anhydrit|evaporit"),
    ("GRANITE", "granodiorit|granit|monzonit|syenit|sienit|charnockit|pegmatit|aplit|larvikit|plutoni|batholit|felsic|intrusi"),
    ("DIORITE", "quartzit|quarzit|cuarcit|anorthosit|anortosit|diorit|tonalit|trondhjemit|chert|^silex|^flint|radiolarit"),
    ("BASALT", "basalt"),
    ("MAFIC", "gabbro|gabro|norit|amphibolit|anfibolit|greenstone|diabas|dolerit|eclogit|peridotit|serpentin|pyroxenit|ultramafi|ophiolit|mafi"),
    ("SCHIST", "schist|schiefer|esquist|scist|phyllit|slate|ardois|pizarr|ardesi|shale|argillit|mudstone|siltstone|claystone|pelit|wacke|grauvac|grauwac|turbidit|flysch|^marl|^marn|mergel|tuff|^tuf|toba"),
    ("SANDSTONE", "sandstone|sandstein|^gres|arenisc|arenit|arenari|arkos|conglomer|siliciclast|^clastic"),
    ("VOLCANIC", "rhyolit|riolit|dacit|andesit|trachyt|porphyr|porfir|volcan|vulcan|vulkan|ignimbrit|pyroclast|brecci|^brech|latit|phonolit|obsidian|^lava"),
    ("LOOSE", "alluvi|aluvi|^sand|gravel|^kies|^clay|argil|^silt|^mud|^loess|^till|morain|^peat|colluvi|unconsolidat|sediment|deposit|^dune|glacia|fluvi|lacustr|eolian"),
]
ADJECTIVE = "(ic|ics|ique|iques|ico|ica|icos|icas|isch|ische|ischer|ed|ive|ivo|iva|oid|ous|ose|oso|osa|ary|aire|ario|aria)$"
_ACCENTED, _PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def rock(text: Column) -> Column:
    """The rock that a description names: the first noun, else the last adjective (mafic and volcanic: basalt), else loose ground."""
    words = F.filter(F.split(F.translate(F.lower(text), _ACCENTED, _PLAIN), r"[^\p{L}]+"), lambda w: F.length(w) >= 3)

    def named(w: Column) -> Column:
        out = None
        for name, stems in ROCK_STEMS:
            out = F.when(w.rlike(stems), name) if out is None else out.when(w.rlike(stems), name)
        return F.struct(out.alias("rock"), w.rlike(ADJECTIVE).alias("adjective"))

    hits = F.filter(F.transform(words, named), lambda h: h["rock"].isNotNull())
    nouns = F.filter(hits, lambda h: ~h["adjective"] & (h["rock"] != "LOOSE"))
    adjectives = F.filter(hits, lambda h: h["adjective"] & (h["rock"] != "LOOSE"))
    last = F.try_element_at(adjectives, F.lit(-1))["rock"]
    mafic = F.exists(adjectives, lambda h: h["rock"] == "MAFIC")
    return F.coalesce(F.get(nouns, F.lit(0))["rock"], F.when((last == "VOLCANIC") & mafic, "BASALT").otherwise(last), F.when(F.size(hits) > 0, "LOOSE"))


# Tags of street furniture in the order in which they are tried, stems of tree genera, and values of fences and walls.
FURNITURE = [
    ("natural", "tree", "TREE"), ("natural", "shrub", "BUSH"), ("highway", "street_lamp", "LAMP"), ("highway", "traffic_signals", "TRAFFIC_SIGNAL"), ("highway", "crossing", "CROSSING"), ("highway", "bus_stop", "BUS_STOP"), ("amenity", "bench", "BENCH"),
    ("amenity", "fountain", "FOUNTAIN"), ("amenity", "waste_basket", "WASTE_BASKET"), ("amenity", "shelter", "SHELTER"), ("power", "tower", "POWER_TOWER"), ("power", "pole", "POWER_POLE"), ("man_made", "flagpole", "FLAGPOLE"), ("man_made", "mast", "MAST"),
    ("man_made", "tower", "MAST"), ("man_made", "communications_tower", "MAST"), ("man_made", "lighthouse", "LIGHTHOUSE"), ("barrier", "bollard", "BOLLARD"), ("historic", "wayside_cross", "CROSS"), ("cemetery", "grave", "CROSS"),
]
TREES = {
    "SPRUCE": "picea abies pseudotsuga larix thuja cupressus juniperus taxus", "PINE": "pinus cedrus sequoia araucaria", "POPLAR": "populus", "BIRCH": "betula salix alnus", "CHERRY": "prunus malus magnolia",
    "OAK": "quercus fagus acer tilia ulmus fraxinus aesculus platanus carpinus juglans", "PALM": "phoenix cocos washingtonia arecaceae palm", "JUNGLE": "eucalyptus ficus", "ACACIA": "acacia",
}
METAL_FENCES, WOODEN_FENCES = ["chain_link", "railing", "metal_bars", "wire", "barbed_wire"], ["wood", "split_rail", "pole"]
# What makes a building a monument without rooms, or open below.
MONUMENTS = ["ruins", "archaeological_site", "monument", "memorial", "tomb", "pyramid", "city_gate", "citywalls", "wayside_shrine"]
SOLID_TYPES = ["wall", "city_wall", "pyramid", "sphinx", "monument", "triumphal_arch", "ruins", "stupa", "tomb", "mausoleum", "obelisk"]
OPEN_TYPES = ["tower", "bridge", "roof", "shelter", "carport", "triumphal_arch", "monument", "gate", "city_gate", "pagoda", "stadium", "grandstand", "transformer_tower", "water_tower", "mast", "communications_tower", "canopy"]
MINARET_NAMES = ["مئذنة", "منارة", "minaret"]


def _any(*tests: Column) -> Column:
    """Whether one of the tests holds; null tests don't."""
    return F.greatest(*[F.coalesce(t, F.lit(False)) for t in tests]) if len(tests) > 1 else F.coalesce(tests[0], F.lit(False))


def furniture(tag: Tag) -> Column:
    """Kind of street furniture or plant that a node's tags name, null for none."""
    return F.coalesce(*[F.when(tag(key) == value, kind) for key, value, kind in FURNITURE])


def tree_species(tag: Tag) -> Column:
    """Kind of tree by its genus (else species), then by its leaves; AUTO for neither."""
    name = F.lower(F.coalesce(tag("genus"), tag("species")))
    by_name = F.coalesce(*[F.when(name.rlike(f"^({stems.replace(' ', '|')})"), kind) for kind, stems in TREES.items()])
    return F.coalesce(by_name, F.when(tag("leaf_type") == "needleleaved", "SPRUCE").when(tag("leaf_type") == "broadleaved", "OAK"), F.lit("AUTO"))


def fence_material(tag: Tag) -> Column:
    material, kind = tag("material"), tag("fence_type")
    metal = _any(kind.isin(METAL_FENCES), material.isin("metal", "steel"))
    return F.when(metal, "METAL").when(material.isin("concrete", "stone"), "STONE").when(_any(material == "wood", kind.isin(WOODEN_FENCES)), "WOOD").otherwise("METAL")


def wall_material(tag: Tag) -> Column:
    material, kind = tag("material"), tag("wall")
    return F.when(_any(material == "brick", kind == "brick"), "BRICK").when(_any(material == "concrete", kind.isin("concrete", "noise_barrier")), "CONCRETE").otherwise("STONE")


def is_domed(tag: Tag) -> Column:
    """Whether a building has a dome: by its roof if that is tagged, else by its other tags."""
    worship = (tag("amenity") == "place_of_worship") & tag("religion").isin("sikh", "muslim")
    other = _any(tag("dome") == "yes", tag("man_made").isin("dome", "observatory"), tag("building").isin("dome", "gurdwara", "mosque"), tag("building:part") == "dome", worship, tag("amenity") == "planetarium")
    return F.when(tag("roof:shape").isNotNull(), tag("roof:shape").isin("dome", "onion")).otherwise(other)


def is_minaret(tag: Tag) -> Column:
    named = (tag("man_made") == "tower") & F.lower(tag("name")).rlike("|".join(MINARET_NAMES))
    return _any(*[tag(key) == "minaret" for key in ("man_made", "tower:type", "building", "building:part")], named)


def is_shrine(tag: Tag) -> Column:
    return _any(tag("building").isin("religious", "shrine"))


def is_solid_monument(tag: Tag) -> Column:
    """Whether there are no rooms behind the walls."""
    return _any(tag("historic").isin(MONUMENTS), tag("building").isin(SOLID_TYPES))


def is_enclosed(building: Column) -> Column:
    """Whether a building of this type is closed below its upper parts; null counts as closed."""
    return ~_any(building.isin(OPEN_TYPES))


#: Building types with flat roofs, and those that people live in.
FLAT_ROOF_TYPES = (
    "apartments", "commercial", "office", "industrial", "retail", "warehouse", "parking", "hospital", "school",
    "university", "college", "hotel", "public", "civic", "government", "supermarket", "kiosk", "service",
    "transportation", "train_station", "sports_hall", "stadium", "factory", "hangar", "water_tower",
    "tower", "bunker", "garages", "data_center", "manufacture", "depot", "fire_station", "police",
    "transformer_tower", "multi-storey", "mall", "storage_tank", "silo", "container",
)
LIVED_IN_TYPES = (
    "house", "detached", "semidetached_house", "terrace", "residential", "bungalow", "farm", "cabin",
    "hut", "villa", "dormitory", "houseboat", "static_caravan", "ger", "yes",
)
#: How roof shapes are tagged.
ROOF_SHAPES = {
    "flat": ("flat",),
    "gabled": ("gabled", "gable", "pitched"),
    "hipped": ("hipped", "hip"),
    "half_hipped": ("half-hipped", "half_hipped", "jerkinhead"),
    "pyramidal": ("pyramidal", "pyramid"),
    "skillion": ("skillion", "shed", "lean_to", "mono-pitched", "monopitch"),
    "gambrel": ("gambrel",),
    "mansard": ("mansard",),
    "round": ("round", "barrel", "vault", "quarter-round"),
    "dome": ("dome", "hemisphere"),
    "onion": ("onion",),
    "cone": ("cone", "conical", "spire"),
    "saltbox": ("saltbox",),
}


def tagged_roof(value: Column) -> Column:
    """The roof shape that a tag names, null for none and for unknown ones."""
    v = F.lower(F.trim(value))
    return F.coalesce(*[F.when(v.isin(*names), shape) for shape, names in ROOF_SHAPES.items()])


def lot(key: Column) -> Column:
    """A number from 0 to 99 that the key alone decides."""
    return F.conv(F.substring(F.md5(key.cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") % 100


def default_roof(shape_tag: Column, domed: Column, part: Column, kind: Column, levels: Column, half_width: Column, key: Column) -> Column:
    """Roof shape of a building: as tagged; a dome; flat for a part or a wall; else by its type, levels, width and a lot of its key.

    Nulls: a type that is not given counts as `yes`, no levels as one, no width as narrow.
    """
    t, n, wide, r = F.coalesce(kind, F.lit("yes")), F.coalesce(levels, F.lit(1)), F.coalesce(half_width, F.lit(0.0)), lot(key)
    one_of = lambda *shares: F.coalesce(*[F.when(r < below, shape) for below, shape in shares])
    lived_in = F.when(n >= 6, "flat").when(wide > 14, one_of((50, "flat"), (100, "hipped"))).otherwise(one_of((62, "gabled"), (90, "hipped"), (100, "flat")))
    by_type = (
        F.when(t.isin("silo", "storage_tank"), "cone")
        .when(t == "water_tower", "flat")
        .when(t.isin("greenhouse", "barn", "farm_auxiliary", "stable", "cowshed", "church", "cathedral", "chapel"), "gabled")
        .when(t.isin("garage", "garages", "shed", "carport"), one_of((50, "flat"), (100, "gabled")))
        .when(t.isin("roof", "shelter"), one_of((60, "flat"), (100, "gabled")))
        .when(t.isin(*FLAT_ROOF_TYPES), "flat")
        .when(t == "dormitory", F.when(n >= 4, "flat").otherwise(one_of((60, "gabled"), (100, "hipped"))))
        .when(t.isin(*LIVED_IN_TYPES), lived_in)
        .otherwise(F.when(wide > 12, "flat").otherwise(one_of((50, "gabled"), (70, "hipped"), (100, "flat"))))
    )
    untagged = F.when(F.coalesce(domed, F.lit(False)), "dome").when(F.coalesce(part, F.lit(False)) | (t == "wall"), "flat").otherwise(by_type)
    return F.coalesce(tagged_roof(shape_tag), untagged)
