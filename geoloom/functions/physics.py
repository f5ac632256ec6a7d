"""Colour, water, ice, climate, sun: Column -> Column."""

from __future__ import annotations


from pyspark.sql import Column
from pyspark.sql import functions as F

LAPSE = 0.0065


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def river_depth(width: Column) -> Column:
    return clamp(0.3 * F.pow(width, F.lit(0.6)), 0.5, 25.0)


def lake_depth(km2: Column) -> Column:
    return clamp(8.0 * F.pow(km2, F.lit(0.3)), 3.0, 60.0)


def bowl(deepest: Column, to_shore: Column, inradius: Column) -> Column:
    return deepest * F.pow(F.least(to_shore / inradius, F.lit(1.0)), F.lit(0.8))


def glacier_thickness(km2: Column) -> Column:
    return F.least(2 * 34.0 * F.pow(km2, F.lit(0.375)), F.lit(600.0))


def code_temperature(celsius: Column) -> Column:
    return F.floor((celsius + 40) * 2 + 0.5).cast("bigint")


def code_rain(mm: Column) -> Column:
    return F.floor(40 * F.log10(mm + 1) + 0.5).cast("bigint")


def decode_rain(code: Column) -> Column:
    return F.pow(F.lit(10.0), code / 40.0) - 1


def to_sea_level(celsius: Column, metres: Column) -> Column:
    return celsius + LAPSE * metres


def precipitation_at(celsius: Column, reference_m: Column, metres: Column) -> Column:
    t = celsius - LAPSE * (metres - reference_m)
    return F.when(t >= 2, "rain").when(t <= 0, "snow").otherwise("unknown")


def ice_on_water(seen: Column, depth: Column) -> Column:
    """True where ice or snow is seen or deep snow lies, false where open water is seen, else null."""
    return F.when(seen.isin("ice", "snow"), True).when(seen == "open", False).when(depth >= 0.3, True)


def corrected_snow(model: Column, seen: Column) -> Column:
    return F.when(seen == "snow", F.greatest(model, F.lit(0.05))).when(seen == "bare", F.greatest(model - 0.3, F.lit(0.0))).otherwise(model)


def elevation_of_rgb(r: Column, g: Column, b: Column) -> Column:
    return r * 256 + g + b / 256 - 32768


def rgb_of_elevation(h: Column) -> tuple[Column, Column, Column]:
    v = clamp(h, 0.0, 200.0) + 32768
    return F.floor(v / 256), F.pmod(F.floor(v), F.lit(256)), F.floor((v - F.floor(v)) * 256)


def rgb565(r: Column, g: Column, b: Column) -> Column:
    return F.call_function("shiftleft", F.call_function("shiftright", r, F.lit(3)), F.lit(11)) + F.call_function("shiftleft", F.call_function("shiftright", g, F.lit(2)), F.lit(5)) + F.call_function("shiftright", b, F.lit(3))


def ramp(x: Column, stops: list[tuple[float, float]]) -> Column:
    """Piecewise linear through the stops, held at both ends."""
    out = F.lit(stops[-1][1])
    for (x0, y0), (x1, y1) in reversed(list(zip(stops, stops[1:], strict=False))):
        out = F.when(x < x1, y0 + (y1 - y0) * (F.greatest(x, F.lit(x0)) - x0) / (x1 - x0)).otherwise(out)
    return out


def palette_distance(r1: Column, g1: Column, b1: Column, r2: Column, g2: Column, b2: Column) -> Column:
    return (r1 - r2) * (r1 - r2) + (g1 - g2) * (g1 - g2) + (b1 - b2) * (b1 - b2)


def packed_value(reference: Column, binary_scale: Column, decimal_scale: Column, x: Column) -> Column:
    return (reference + x * F.pow(F.lit(2.0), binary_scale)) / F.pow(F.lit(10.0), decimal_scale)


def soft_vertical(y: Column, knee: float = 100.0, ceiling: float = 300.0) -> Column:
    """Linear to the knee, then approaching the ceiling exponentially."""
    room = ceiling - knee
    return F.when(y <= knee, y).otherwise(knee + room * (1 - F.exp(-(y - knee) / room)))


def utc_offset(lon: Column) -> Column:
    return F.floor(lon / 15 + 0.5).cast("bigint")


def julian_day(epoch_s: Column) -> Column:
    return epoch_s / 86400.0 + 2440587.5


def moon_phase(epoch_s: Column) -> Column:
    """Eighths of the synodic month, 0 = full moon."""
    age = F.pmod(julian_day(epoch_s) - 2451550.1, F.lit(29.530588853)) / 29.530588853
    return F.pmod(F.floor(age * 8 + 0.5) + 4, F.lit(8)).cast("bigint")


def declination(day_of_year: Column) -> Column:
    return F.degrees(F.asin(0.39779 * F.cos(F.radians(0.98565 * (day_of_year + 10) + 1.914 * F.sin(F.radians(0.98565 * (day_of_year - 2)))))) * -1)


def day_hours(lat: Column, day_of_year: Column) -> Column:
    """Hours of daylight, clamped to 1..23."""
    c = -F.tan(F.radians(lat)) * F.tan(F.radians(declination(day_of_year)))
    return clamp(F.degrees(F.acos(clamp(c, -1.0, 1.0))) * 2 / 15, 1.0, 23.0)


def hsv(r: Column, g: Column, b: Column) -> tuple[Column, Column, Column]:
    """Hue in degrees, saturation and value, 0 to 1."""
    high, low = F.greatest(r, g, b), F.least(r, g, b)
    d = high - low
    h = F.when(d == 0, 0.0).when(high == r, F.pmod((g - b) * 60.0 / d, F.lit(360.0))).when(high == g, (b - r) * 60.0 / d + 120).otherwise((r - g) * 60.0 / d + 240)
    return h, F.when(high == 0, 0.0).otherwise(d / high), high / 255.0


def cell_jitter(x: Column, z: Column) -> tuple[Column, Column]:
    """Two deterministic draws in [0, 1) of a cell; modular, so that nothing overflows."""
    h = F.pmod(x * 73856093 + z * 19349663, F.lit(2147483647))
    h2 = F.pmod(h * 48271, F.lit(2147483647))
    return h / 2147483647.0, h2 / 2147483647.0



def roof_colour(v: Column, street: Column, luminance: Column) -> Column:
    """One channel of a roof's colour, white-balanced by the street's and spread round a grey of 88 with gamma 1.3."""
    balanced = v * luminance / F.greatest(street, F.lit(1))
    return F.when(luminance < 8, v).otherwise(clamp(F.floor(88 * F.pow(balanced / luminance, F.lit(1.3)) + 0.5), 0, 255))


def channel_depth(deepest: Column, distance: Column, half_width: Column) -> Column:
    """Parabolic bed of a channel, at least 1."""
    across = F.least(distance / (half_width + 1.0), F.lit(1.0))
    return F.greatest(F.floor(deepest * (1 - across * across) + 0.5), F.lit(1))


# Zones of the climate classes that have one zone each.
KOEPPEN = {"Af": "TROPICAL_HUMID", "Am": "TROPICAL_HUMID", "Aw": "SAVANNA", "BSh": "SAVANNA", "BWh": "ARID", "BWk": "ARID", "Csa": "SUBTROPICAL", "Cwa": "SUBTROPICAL", "Cfa": "SUBTROPICAL", "Cfc": "TAIGA", "Dfc": "TAIGA", "Dfd": "TAIGA", "EF": "ICE_CAP"}
ZONE_RANK = {"ICE_CAP": 0, "TUNDRA": 1, "ALPINE": 1, "TAIGA": 2, "TEMPERATE": 3}


def climate_zone(koeppen: Column, t: Column, elevation: Column, abs_lat: Column, rain: Column, above_cell: Column) -> Column:
    """Zone of a place: by class; far above its cell or over 2,600 m only colder, far below only warmer up to temperate."""
    zone = F.when(koeppen == "BSk", F.when(rain < 250, "ARID").when(t >= 15, "SAVANNA").otherwise("TEMPERATE"))
    zone = zone.when(koeppen.isin("Dfb", "Dwb", "Dsb"), F.when(t < 4, "TAIGA").otherwise("TEMPERATE")).when(koeppen == "ET", F.when((elevation > 1500) & (abs_lat < 60), "ALPINE").otherwise("TUNDRA"))
    for k, z in KOEPPEN.items():
        zone = zone.when(koeppen == k, z)
    zone = zone.otherwise("TEMPERATE")
    own = F.when((t < -6) | (elevation > 4800), "ICE_CAP").when((elevation > 2600) & (t < 8), "ALPINE").when(t < 1, "TUNDRA").when(t < 7.5, "TAIGA").when(t < 16, "TEMPERATE")

    def rank(z: Column) -> Column:
        out = F.lit(4)
        for name, r in ZONE_RANK.items():
            out = F.when(z == name, r).otherwise(out)
        return out

    high = (above_cell > 400) | (elevation > 2600)
    return F.when(high & own.isNotNull() & (rank(own) < rank(zone)), own).when(~high & (above_cell < -400) & own.isNotNull() & (rank(own) > rank(zone)), own).otherwise(zone)
