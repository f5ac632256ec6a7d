"""Map projections as column arithmetic."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

METRES_PER_DEGREE = 111320.0
SPHERE = 6378137.0


def local(lat: Column, lon: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    """Metres east and north of an origin, equirectangular."""
    return (lon - lon0) * METRES_PER_DEGREE * math.cos(math.radians(lat0)), (lat - lat0) * METRES_PER_DEGREE


def local_inverse(x: Column, y: Column, lat0: float, lon0: float) -> tuple[Column, Column]:
    return y / METRES_PER_DEGREE + lat0, x / (METRES_PER_DEGREE * math.cos(math.radians(lat0))) + lon0


def transverse_mercator(lat: Column, lon: Column, lon0: float, radius: float = SPHERE) -> tuple[Column, Column]:
    """Spherical transverse Mercator: x along the parallel, y from the equator."""
    phi, dl = F.radians(lat), F.radians(lon - lon0)
    b = F.cos(phi) * F.sin(dl)
    return radius / 2 * F.log((1 + b) / (1 - b)), radius * F.atan2(F.tan(phi), F.cos(dl))


def transverse_mercator_inverse(x: Column, y: Column, lon0: float, radius: float = SPHERE) -> tuple[Column, Column]:
    d = y / radius
    return F.degrees(F.asin(F.sin(d) / F.cosh(x / radius))), F.degrees(F.atan2(F.sinh(x / radius), F.cos(d))) + lon0


def utm(lat: Column, lon: Column, zone: int) -> tuple[Column, Column]:
    """Easting and northing by the Krueger series of the third order on WGS 84 (northern half)."""
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    k0, phi, dl = 0.9996, F.radians(lat), F.radians(lon - (zone * 6 - 183))
    e = 2 * math.sqrt(n) / (1 + n)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    t = F.sinh(atanh(F.sin(phi)) - e * atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(dl)), atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = eta + sum(al * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, al in enumerate(alpha, 1))
    north = xi + sum(al * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, al in enumerate(alpha, 1))
    return 500000.0 + k0 * a * east, k0 * a * north


def utm_inverse(east: Column, north: Column, zone: int) -> tuple[Column, Column]:
    f = 1 / 298.257223563
    n = f / (2 - f)
    a = 6378137.0 / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    xi, eta = north / (0.9996 * a), (east - 500000.0) / (0.9996 * a)
    x1 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1))
    e1 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1))
    chi = F.asin(F.sin(x1) / F.cosh(e1))
    lat = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1))
    return F.degrees(lat), zone * 6 - 183 + F.degrees(F.atan2(F.sinh(e1), F.cos(x1)))


def swiss_lv95(lat: Column, lon: Column) -> tuple[Column, Column]:
    """East and north of the Swiss grid, by the published polynomials."""
    p, l = (lat * 3600 - 169028.66) / 10000, (lon * 3600 - 26782.5) / 10000
    east = 2600072.37 + 211455.93 * l - 10938.51 * l * p - 0.36 * l * p * p - 44.54 * l * l * l
    north = 1200147.07 + 308807.95 * p + 3745.25 * l * l + 76.63 * p * p - 194.56 * l * l * p + 119.79 * p * p * p
    return east, north


def swiss_lv95_inverse(east: Column, north: Column) -> tuple[Column, Column]:
    y, x = (east - 2600000) / 1000000, (north - 1200000) / 1000000
    lon = 2.6779094 + 4.728982 * y + 0.791484 * y * x + 0.1306 * y * x * x - 0.0436 * y * y * y
    lat = 16.9023892 + 3.238272 * x - 0.270978 * y * y - 0.002528 * x * x - 0.0447 * y * y * x - 0.0140 * x * x * x
    return lat * 100 / 36, lon * 100 / 36


def lambert_conformal(lat: Column, lon: Column, lat0: float, lon0: float, sp1: float, sp2: float, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Lambert conformal conic with two standard parallels, before false origins."""
    e = math.sqrt(f * (2 - f))
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = math.radians(sp1), math.radians(sp2), math.radians(lat0)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    phi = F.radians(lat)
    tc = F.tan(math.pi / 4 - phi / 2) / F.pow((1 - e * F.sin(phi)) / (1 + e * F.sin(phi)), F.lit(e / 2))
    rho, theta = a * big * F.pow(tc, F.lit(n)), n * F.radians(lon - lon0)
    return rho * F.sin(theta), a * big * t(p0) ** n - rho * F.cos(theta)


def lambert_conformal_inverse(x: Column, y: Column, lat0: float, lon0: float, sp1: float, sp2: float, a: float = 6378137.0, f: float = 1 / 298.257222101) -> tuple[Column, Column]:
    """Inverse of lambert_conformal in eight fixed iterations."""
    e = math.sqrt(f * (2 - f))
    m = lambda p: math.cos(p) / math.sqrt(1 - e * e * math.sin(p) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    p1, p2, p0 = math.radians(sp1), math.radians(sp2), math.radians(lat0)
    n = (math.log(m(p1)) - math.log(m(p2))) / (math.log(t(p1)) - math.log(t(p2)))
    big = m(p1) / (n * t(p1) ** n)
    dy = a * big * t(p0) ** n - y
    tc = F.pow(F.sqrt(x * x + dy * dy) / (a * big), F.lit(1 / n))
    start = math.pi / 2 - 2 * F.atan(tc)
    turn = lambda s: math.pi / 2 - 2 * F.atan(tc * F.pow((1 - e * F.sin(s)) / (1 + e * F.sin(s)), F.lit(e / 2)))
    # eight rounds as a fold, so that the expression stays small
    phi = F.aggregate(F.array(*[F.lit(0)] * 8), start, lambda s, _: turn(s))
    return F.degrees(phi), F.degrees(F.atan2(x, dy) / n) + lon0


def polar_stereographic(lat: Column, lon: Column, lon0: float, true_lat: float = 60.0, radius: float = 6371200.0) -> tuple[Column, Column]:
    """Northern spherical polar stereographic metres."""
    scale = radius * (1 + math.sin(math.radians(true_lat)))
    r = scale * F.tan(math.pi / 4 - F.radians(lat) / 2)
    return r * F.sin(F.radians(lon - lon0)), -r * F.cos(F.radians(lon - lon0))


def lambert_azimuthal(lat: Column, lon: Column, lat0: float = 55.0, lon0: float = 10.0, radius: float = 6378137.0) -> tuple[Column, Column]:
    """Spherical Lambert azimuthal equal-area metres."""
    phi, dl, p0 = F.radians(lat), F.radians(lon - lon0), math.radians(lat0)
    k = F.sqrt(2 / (1 + math.sin(p0) * F.sin(phi) + math.cos(p0) * F.cos(phi) * F.cos(dl)))
    return radius * k * F.cos(phi) * F.sin(dl), radius * k * (math.cos(p0) * F.sin(phi) - math.sin(p0) * F.cos(phi) * F.cos(dl))
