"""Text and tag rules: Column -> Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Metres of the units that may follow a number.
UNITS = {"'": 0.3048, "ft": 0.3048, "feet": 0.3048, "km": 1000.0, "mi": 1609.344}


def parse_length(text: Column) -> Column:
    """Metres from texts such as '12 m', "40'", '3,5', 'approx. 40 ft', '2 km'; null without a digit."""
    plain = F.lower(F.replace(text, F.lit(","), F.lit(".")))
    digits = F.regexp_extract(plain, r"(-?[0-9]+(?:\.[0-9]+)?)", 1)
    unit = F.regexp_extract(plain, r"-?[0-9]+(?:\.[0-9]+)?\s*('|feet|ft|km|mi)", 1)
    factor = F.lit(1.0)
    for name, metres in UNITS.items():
        factor = F.when(unit == name, F.lit(metres)).otherwise(factor)
    return digits.try_cast("double") * factor


def parse_int(text: Column) -> Column:
    return F.floor(parse_length(text) + 0.5).cast("bigint")


def is_true(tag: Column) -> Column:
    """A tag that is there and says neither no nor false."""
    return F.coalesce(~F.lower(tag).isin("no", "false", "0"), F.lit(False))


def name_key(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def tidy_name(name: Column, most: int = 60) -> Column:
    """First of a semicolon list, trimmed, at most `most` characters; null if nothing is left."""
    first = F.trim(F.split(name, ";")[0])
    return F.when(first != "", F.substring(first, 1, most))


def is_latin(name: Column) -> Column:
    return name.rlike(r"[A-Za-z\x{C0}-\x{24F}]") & ~name.rlike(r"[\x{370}-\x{1CFF}\x{3040}-\x{9FFF}]")


def slug(name: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(name), r"[^a-z0-9]+", "_"), "^_+|_+$", "")


def parse_position(text: Column) -> Column:
    """Struct of lat and lon from 'lat, lon', null if out of range or anything else."""
    pattern = r"^\s*(-?[0-9]+(?:\.[0-9]+)?)\s*[,; ]\s*(-?[0-9]+(?:\.[0-9]+)?)\s*$"
    lat, lon = F.regexp_extract(text, pattern, 1).try_cast("double"), F.regexp_extract(text, pattern, 2).try_cast("double")
    return F.when(lat.between(-90, 90) & lon.between(-180, 180), F.struct(lat.alias("lat"), lon.alias("lon")))


def region_of_file(name: Column) -> Column:
    """'norway-latest.osm.pbf' -> 'norway'; folders, suffixes and dates go."""
    base = F.regexp_replace(name, r"^.*[/\\]", "")
    return F.regexp_replace(F.regexp_replace(F.lower(base), r"(\.osm)?\.pbf$", ""), r"-(latest|[0-9]{6,8})$", "")


def wet_and_thunder(wx: Column) -> tuple[Column, Column]:
    """Precipitation and thunder from METAR present weather; groups in the vicinity (VC) don't count as wet."""
    groups = F.filter(F.transform(F.split(F.coalesce(wx, F.lit("")), r"\s+"), lambda g: F.regexp_replace(g, "^[+-]", "")), lambda g: g != "")
    wet = F.exists(groups, lambda g: ~g.startswith("VC") & g.rlike("DZ|RA|SN|SG|PL|GR|GS|IC|UP"))
    return wet, F.exists(groups, lambda g: g.contains("TS"))


def sky_of_symbol(symbol: Column) -> Column:
    return F.when(symbol.contains("thunder"), "THUNDER").when(symbol.rlike("rain|sleet|snow|shower|drizzle"), "RAIN").otherwise("CLEAR")


def rock_shares(text: Column) -> Column:
    """The rock of the largest share in 'granite [60%..]; gneiss [40%]'; the first of equal shares."""
    parts = F.filter(F.split(text, ";"), lambda p: F.trim(p) != "")
    sized = F.transform(parts, lambda p, i: F.struct(F.coalesce(F.regexp_extract(p, r"\[(\d+)", 1).try_cast("int"), F.lit(0)).alias("share"), (-i).alias("minus"), F.trim(F.regexp_replace(p, r"\[.*", "")).alias("rock")))
    return F.array_max(sized)["rock"]
