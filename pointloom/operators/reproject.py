"""Reprojection with closed formulas as column expressions.

Systems are given by EPSG number (4326, 3857, the UTM zones 326xx and 327xx, those in SYSTEMS), as a PROJ string ("+proj=..."), as WKT (PROJCS,
GEOGCS), or as a System. There are conic projections, Albers' (equal areas) and Lambert's (equal angles), transverse, oblique and plain Mercator, and
polar stereographic ones, each on an ellipsoid whose datum is WGS 84 moved, turned and scaled a little (three or seven parameters), or
that a grid of shifts takes to WGS 84 (NTv2 files, +nadgrids=). Anything else needs a function of the caller's, from columns (x, y, z) to columns.
Coordinates follow the systems' own axis order: (latitude, longitude) in degrees for EPSG:4326 and WKT that says so, (longitude, latitude) for PROJ strings and
other WKT, (easting, northing) for projected ones; heights stay.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from math import asin, atan, atan2, atanh, copysign, cos, degrees, exp, log, pi, radians, sin, sinh, sqrt, tan

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import box_unchecked, vec
from ..functions.schema import POINT_IDX
from .aggregates import POSITION
from .grid_shift import shifted

# The WGS 84 ellipsoid and the UTM grid.
SEMI_MAJOR, FLATTENING = 6378137.0, 1 / 298.257223563
UTM_SCALE, UTM_EASTING, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0

Transform = Callable[[Column, Column, Column], tuple[Column, Column, Column]]


def _mercator(lat: Column, lon: Column) -> tuple[Column, Column]:
    return F.radians(lon) * SEMI_MAJOR, F.log(F.tan(F.radians(lat) / 2 + F.pi() / 4)) * SEMI_MAJOR


def _mercator_back(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(F.atan(F.exp(y / SEMI_MAJOR)) * 2 - F.pi() / 2), F.degrees(x / SEMI_MAJOR)


def _sum(terms: list[Column]) -> Column:
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return out


@dataclass(frozen=True)
class System:
    """A projected system, or a geographic one in degrees. Angles in degrees, lengths in metres; `unit`: metres of a unit of its coordinates.

    shift is what the datum's geocentric coordinates need added to be those of WGS 84; turn are rotations (seconds, position vector) and growth (parts in
    a million) before that. parallels: two of conic systems; of Mercator and polar ones (parallel, 0) is the parallel of true scale, if any.
    grids: files that take the datum to WGS 84 in place of shift and turn (grid_shift).
    azimuth: of the central line of oblique ones, whose coordinates are counted from the center, or from where the line meets the equator (natural).
    """

    method: str
    lat: float
    lon: float
    parallels: tuple[float, float] = (0.0, 0.0)
    east: float = 0.0
    north: float = 0.0
    scale: float = 1.0
    axis: float = SEMI_MAJOR
    flattening: float = FLATTENING
    shift: tuple[float, float, float] = (0.0, 0.0, 0.0)
    turn: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    unit: float = 1.0
    azimuth: float = 0.0
    rectified: float | None = None
    natural: bool = False
    lat_first: bool = False
    grids: tuple[str, ...] = ()

    def __post_init__(self):
        if self.method not in FORMULAS:
            raise ValueError(f"no projection {self.method!r}")
        if self.method == "polar" and abs(self.lat) != 90:
            raise ValueError("stereographic projections have formulas at the poles only")

    @property
    def e2(self) -> float:
        return self.flattening * (2 - self.flattening)

    @property
    def third(self) -> float:
        return self.flattening / (2 - self.flattening)


def _krueger(n: float) -> tuple[tuple[float, ...], tuple[float, ...], tuple[float, ...], float]:
    """Coefficients of Krueger's series to the fourth order, forth, back and from conformal to geodetic latitude, and the mean radius by axis."""
    forth = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    back = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return forth, back, latitude, (1 + n**2 / 4 + n**4 / 64) / (1 + n)


def _conformal(phi: Column, e: float) -> Column:
    """sinh of the isometric latitude, the tangent of the conformal one."""
    return F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * e) * e)


def _arc(s: System) -> float:
    """The meridian's arc from the equator to the latitude of origin, by the mean radius."""
    phi, e = radians(s.lat), sqrt(s.e2)
    if not phi:
        return 0.0
    xi = atan(sinh(atanh(sin(phi)) - e * atanh(e * sin(phi))))
    return xi + sum(a * sin(2 * j * xi) for j, a in enumerate(_krueger(s.third)[0], 1))


def _transverse(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    """Millimetres within a zone."""
    forth, _, _, mean = _krueger(s.third)
    phi, lam = F.radians(lat), F.radians(lon - s.lon)
    t = _conformal(phi, sqrt(s.e2))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(t * t + 1))
    east = eta + _sum([F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * a for j, a in enumerate(forth, 1)])
    north = xi + _sum([F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * a for j, a in enumerate(forth, 1)])
    return east * (s.scale * mean * s.axis) + s.east, (north - _arc(s)) * (s.scale * mean * s.axis) + s.north


def _transverse_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    _, back, latitude, mean = _krueger(s.third)
    xi, eta = (y - s.north) / (s.scale * mean * s.axis) + _arc(s), (x - s.east) / (s.scale * mean * s.axis)
    xi1 = xi - _sum([F.sin(xi * (2 * j)) * F.cosh(eta * (2 * j)) * b for j, b in enumerate(back, 1)])
    eta1 = eta - _sum([F.cos(xi * (2 * j)) * F.sinh(eta * (2 * j)) * b for j, b in enumerate(back, 1)])
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    phi = chi + _sum([F.sin(chi * (2 * j)) * d for j, d in enumerate(latitude, 1)])
    return F.degrees(phi), F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))) + s.lon


def _ring(phi: float, e2: float) -> float:
    """Radius of a parallel by the ellipsoid's axis."""
    return cos(phi) / sqrt(1 - e2 * sin(phi) ** 2)


def _area(phi: float, e2: float) -> float:
    e = sqrt(e2)
    return (1 - e2) * (sin(phi) / (1 - e2 * sin(phi) ** 2) - log((1 - e * sin(phi)) / (1 + e * sin(phi))) / (2 * e))


def _albers_cone(s: System) -> tuple[float, float, float]:
    """(cone constant, its integration constant, radius of the latitude of origin by axis)."""
    one, two = (radians(p) for p in s.parallels)
    n = sin(one) if one == two else (_ring(one, s.e2) ** 2 - _ring(two, s.e2) ** 2) / (_area(two, s.e2) - _area(one, s.e2))
    c = _ring(one, s.e2) ** 2 + n * _area(one, s.e2)
    return n, c, sqrt(c - n * _area(radians(s.lat), s.e2)) / n


def _lambert_cone(s: System) -> tuple[float, float, float]:
    e = sqrt(s.e2)
    t = lambda p: tan(pi / 4 - p / 2) / ((1 - e * sin(p)) / (1 + e * sin(p))) ** (e / 2)
    one, two = (radians(p) for p in s.parallels)
    n = sin(one) if one == two else (log(_ring(one, s.e2)) - log(_ring(two, s.e2))) / (log(t(one)) - log(t(two)))
    f = _ring(one, s.e2) / (n * t(one) ** n) * s.scale
    return n, f, f * t(radians(s.lat)) ** n


def _conic(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    phi, e = F.radians(lat), sqrt(s.e2)
    if s.method == "albers":
        n, c, start = _albers_cone(s)
        sine = F.sin(phi)
        area = (sine / (1 - sine * sine * s.e2) - F.log((1 - sine * e) / (1 + sine * e)) / (2 * e)) * (1 - s.e2)
        rho = F.sqrt(F.greatest(c - area * n, F.lit(0.0))) / n
    else:
        n, f, start = _lambert_cone(s)
        rho = F.pow(_tangent(phi, e), F.lit(n)) * f
    theta = F.radians(lon - s.lon) * n
    return rho * F.sin(theta) * s.axis + s.east, (start - rho * F.cos(theta)) * s.axis + s.north


def _tangent(phi: Column, e: float) -> Column:
    """exp of the isometric latitude, turned round."""
    return F.exp(F.atanh(F.sin(phi) * e) * e - F.atanh(F.sin(phi)))


def _conic_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    n, c, start = (_albers_cone if s.method == "albers" else _lambert_cone)(s)
    side = 1.0 if n > 0 else -1.0
    dx, dy = (x - s.east) / s.axis, start - (y - s.north) / s.axis
    rho, theta = F.sqrt(dx * dx + dy * dy) * side, F.atan2(dx * side, dy * side)
    if s.method == "albers":
        e2, pole = s.e2, _area(pi / 2, s.e2)
        beta = F.asin(F.greatest(F.least((c - rho * rho * (n * n)) / (n * pole), F.lit(1.0)), F.lit(-1.0)))
        terms = (e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360)
        phi = beta + _sum([F.sin(beta * (2 * j)) * d for j, d in enumerate(terms, 1)])
    else:
        chi = F.lit(pi / 2) - F.atan(F.pow(rho / c, F.lit(1 / n))) * 2
        phi = chi + _sum([F.sin(chi * (2 * j)) * d for j, d in enumerate(_krueger(s.third)[2], 1)])
    return F.degrees(phi), F.degrees(theta / n) + s.lon


def _from_conformal(chi: Column, s: System) -> Column:
    return chi + _sum([F.sin(chi * (2 * j)) * d for j, d in enumerate(_krueger(s.third)[2], 1)])


def _true_scale(s: System) -> float:
    return _ring(radians(s.parallels[0]), s.e2) if s.parallels[0] else s.scale


def _plain(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    size = s.axis * _true_scale(s)
    return F.radians(_turned(lon - s.lon)) * size + s.east, F.log(_tangent(F.radians(lat), sqrt(s.e2))) * -size + s.north


def _plain_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    size = s.axis * _true_scale(s)
    chi = F.lit(pi / 2) - F.atan(F.exp((s.north - y) / size)) * 2
    return F.degrees(_from_conformal(chi, s)), F.degrees((x - s.east) / size) + s.lon


def _turned(lon: Column) -> Column:
    """Degrees from -180 to 180."""
    return F.pmod(lon + 180, F.lit(360.0)) - 180


def _polar_size(s: System) -> float:
    """Radius by the tangent of half the colatitude."""
    e = sqrt(s.e2)
    at_pole = sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    if not s.parallels[0]:
        return 2 * s.axis * s.scale / at_pole
    phi = radians(abs(s.parallels[0]))
    return s.axis * _ring(phi, s.e2) / exp(e * atanh(e * sin(phi)) - atanh(sin(phi)))


def _polar(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    side = copysign(1.0, s.lat)
    rho, lam = _tangent(F.radians(lat * side), sqrt(s.e2)) * _polar_size(s), F.radians(lon - s.lon)
    return rho * F.sin(lam) + s.east, rho * F.cos(lam) * -side + s.north


def _polar_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    side, dx, dy = copysign(1.0, s.lat), x - s.east, y - s.north
    chi = F.lit(pi / 2) - F.atan(F.sqrt(dx * dx + dy * dy) / _polar_size(s)) * 2
    return F.degrees(_from_conformal(chi, s)) * side, _turned(F.degrees(F.atan2(dx, dy * -side)) + s.lon)


def _oblique_line(s: System) -> tuple[float, ...]:
    """(B, A, H, sine and cosine of the line's azimuth at the equator, its longitude there, u of the center, azimuth of the grid)."""
    phi, e, alpha = radians(s.lat), sqrt(s.e2), radians(s.azimuth)
    b = sqrt(1 + s.e2 * cos(phi) ** 4 / (1 - s.e2))
    a = s.axis * b * s.scale * sqrt(1 - s.e2) / (1 - s.e2 * sin(phi) ** 2)
    t0 = exp(e * atanh(e * sin(phi)) - atanh(sin(phi)))
    d = max(1.0, b * sqrt(1 - s.e2) / _ring(phi, s.e2) * 1 / (1 - s.e2 * sin(phi) ** 2))
    f = d + copysign(sqrt(d * d - 1), phi)
    gamma = asin(sin(alpha) / d)
    lon = radians(s.lon) - asin((f - 1 / f) / 2 * tan(gamma)) / b
    across = abs(abs(s.azimuth) - 90) < 1e-10
    center = 0.0 if s.natural else a * (radians(s.lon) - lon) if across else copysign(a / b * atan2(sqrt(d * d - 1), cos(alpha)), phi)
    return b, a, f * t0**b, sin(gamma), cos(gamma), lon, center, radians(s.azimuth if s.rectified is None else s.rectified)


def _oblique(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    b, a, h, sine, cosine, start, center, grid = _oblique_line(s)
    q = F.pow(_tangent(F.radians(lat), sqrt(s.e2)), F.lit(-b)) * h
    lam = F.radians(_turned(lon - degrees(start))) * b
    half, whole, turn = (q - 1 / q) / 2, (q + 1 / q) / 2, F.sin(lam)
    v = F.atanh((half * sine - turn * cosine) / whole) * (-a / b)
    u = F.atan2(half * cosine + turn * sine, F.cos(lam)) * (a / b) - center
    return v * cos(grid) + u * sin(grid) + s.east, u * cos(grid) - v * sin(grid) + s.north


def _oblique_back(s: System, x: Column, y: Column) -> tuple[Column, Column]:
    b, a, h, sine, cosine, start, center, grid = _oblique_line(s)
    dx, dy = x - s.east, y - s.north
    v, u = dx * cos(grid) - dy * sin(grid), dy * cos(grid) + dx * sin(grid) + center
    q = F.exp(v * (-b / a))
    half, whole, turn = (q - 1 / q) / 2, (q + 1 / q) / 2, F.sin(u * (b / a))
    ratio = (turn * cosine + half * sine) / whole
    t = F.pow(F.sqrt((1 - ratio) / (1 + ratio)) * h, F.lit(1 / b))
    lam = F.atan2(half * cosine - turn * sine, F.cos(u * (b / a))) / -b
    return F.degrees(_from_conformal(F.lit(pi / 2) - F.atan(t) * 2, s)), _turned(F.degrees(lam + start))


def _degrees(s: System, lat: Column, lon: Column) -> tuple[Column, Column]:
    return (lat, lon) if s.lat_first else (lon, lat)


#: Each method forth, from (latitude, longitude), and back.
FORMULAS = {
    "albers": (_conic, _conic_back), "lambert": (_conic, _conic_back), "transverse": (_transverse, _transverse_back), "mercator": (_plain, _plain_back),
    "polar": (_polar, _polar_back), "oblique": (_oblique, _oblique_back), "geographic": (_degrees, _degrees),
}


# Parameters of the systems as the EPSG registry gives them.
CLARKE = {"axis": 6378206.4, "flattening": 1 / 294.978698213898}
GRS80 = {"flattening": 1 / 298.257222101}
SYSTEMS = {
    3309: System("albers", 0, -120, (34, 40.5), 0, -4_000_000, **CLARKE, shift=(-8, 159, 175)),  # NAD27 / California, shift of the western states
    3310: System("albers", 0, -120, (34, 40.5), 0, -4_000_000, **GRS80),  # NAD83 / California
    5070: System("albers", 23, -96, (29.5, 45.5), **GRS80),  # NAD83 / Conus
    3577: System("albers", 0, 132, (-18, -36), **GRS80),  # GDA94 / Australia
    2154: System("lambert", 46.5, 3, (49, 44), 700_000, 6_600_000, **GRS80),  # RGF93 / France
    3034: System("lambert", 52, 10, (35, 65), 4_000_000, 2_800_000, **GRS80),  # ETRS89 / Europe
    2193: System("transverse", 0, 173, (0, 0), 1_600_000, 10_000_000, 0.9996, **GRS80),  # NZGD2000 / New Zealand
}


def _geocentric(lat: Column, lon: Column, h: Column, axis: float, e2: float) -> tuple[Column, Column, Column]:
    phi, lam = F.radians(lat), F.radians(lon)
    across = F.lit(axis) / F.sqrt(1 - F.sin(phi) * F.sin(phi) * e2)
    return (across + h) * F.cos(phi) * F.cos(lam), (across + h) * F.cos(phi) * F.sin(lam), (across * (1 - e2) + h) * F.sin(phi)


def _geodetic(x: Column, y: Column, z: Column, axis: float, e2: float) -> tuple[Column, Column]:
    """Bowring's formula: micrometres near the ground."""
    f = 1 - sqrt(1 - e2)
    r = F.sqrt(x * x + y * y)
    u = F.atan2(z, r * (1 - f))
    lift, pull = e2 / (1 - e2) * axis * (1 - f), e2 * axis
    return F.degrees(F.atan2(z + F.pow(F.sin(u), F.lit(3)) * lift, r - F.pow(F.cos(u), F.lit(3)) * pull)), F.degrees(F.atan2(y, x))


def _helmert(s: System) -> np.ndarray:
    """The matrix that takes the datum's geocentric coordinates to those of WGS 84, before the shift."""
    rx, ry, rz = (radians(v / 3600) for v in s.turn[:3])
    return (1 + s.turn[3] * 1e-6) * np.array([[1, -rz, ry], [rz, 1, -rx], [-ry, rx, 1]])


def _moved(lat: Column, lon: Column, h: Column, s: System, back: bool) -> tuple[Column, Column]:
    """From WGS 84 to the system's datum, or back."""
    wgs, own = (SEMI_MAJOR, FLATTENING * (2 - FLATTENING)), (s.axis, s.e2)
    if s.grids:
        return shifted(s.grids, lat, lon, not back)
    if s.shift == (0.0, 0.0, 0.0) and not any(s.turn):
        return lat, lon
    at = _geocentric(lat, lon, h, *(own if back else wgs))
    if back:
        moved = [_sum([c * float(v) for c, v in zip(at, row, strict=True)]) + d for row, d in zip(_helmert(s), s.shift, strict=True)]
    else:
        off = [c - d for c, d in zip(at, s.shift, strict=True)]
        moved = [_sum([c * float(v) for c, v in zip(off, row, strict=True)]) for row in np.linalg.inv(_helmert(s))]
    return _geodetic(*moved, *(wgs if back else own))


def _utm(code: int) -> System:
    return System("transverse", 0, 6 * (code % 100) - 183, (0, 0), UTM_EASTING, UTM_SOUTH if code > 32700 else 0.0, UTM_SCALE)


def _system(crs: str | int | System) -> int | System:
    if isinstance(crs, System):
        return crs
    if str(crs).strip().startswith("+"):
        return of_proj(str(crs))
    if "[" in str(crs):
        return of_wkt(str(crs))
    text = str(crs).upper().removeprefix("EPSG:")
    code = int(text) if text.isdigit() else 0
    if code in (4326, 3857):
        return code
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return _utm(code)
    if code in SYSTEMS:
        return SYSTEMS[code]
    raise ValueError(f"{crs}: only EPSG:4326, EPSG:3857, UTM zones (326xx, 327xx) and {sorted(SYSTEMS)} are known by number; pass a PROJ string, WKT, a System or a transform")


# Ellipsoids (axis, 1 / flattening; 0: a sphere), datums (ellipsoid, to WGS 84) and units by the names that PROJ strings use.
ELLIPSOIDS = {
    "WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "clrk66": (6378206.4, 294.978698213898), "clrk80": (6378249.145, 293.4663),
    "bessel": (6377397.155, 299.1528128), "intl": (6378388.0, 297.0), "airy": (6377563.396, 299.3249646), "krass": (6378245.0, 298.3), "sphere": (6370997.0, 0.0),
}
DATUMS = {
    "WGS84": ("WGS84", (0.0,) * 7), "NAD83": ("GRS80", (0.0,) * 7), "OSGB36": ("airy", (446.448, -125.157, 542.060, 0.1502, 0.2470, 0.8421, -20.4894)),
    "potsdam": ("bessel", (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)), "nzgd49": ("intl", (59.47, -5.04, 187.44, 0.47, -0.1, 1.024, -4.5993)),
}
UNITS = {"m": 1.0, "km": 1000.0, "ft": 0.3048, "us-ft": 1200 / 3937}
PROJ_METHODS = {"aea": "albers", "lcc": "lambert", "tmerc": "transverse", "utm": "transverse", "merc": "mercator", "stere": "polar", "omerc": "oblique", "longlat": "geographic", "latlong": "geographic"}
PROJ_KEYS = {"proj", "lat_0", "lat_1", "lat_2", "lat_ts", "lon_0", "lonc", "k", "k_0", "x_0", "y_0", "a", "b", "rf", "ellps", "datum", "towgs84", "nadgrids", "units", "to_meter", "zone", "south", "alpha", "gamma", "no_uoff", "no_off", "no_defs", "type", "wktext", "over"}


def _to_wgs84(values: list[float]) -> dict:
    v = [*values, *[0.0] * (7 - len(values))]
    return {"shift": tuple(v[:3]), "turn": tuple(v[3:7])}


def of_proj(text: str) -> System:
    """A system from a PROJ string. Parameters that have no formula here raise."""
    given = {k: v for k, _, v in (part.lstrip("+").partition("=") for part in text.split())}
    number = lambda name, default=0.0: float(given.get(name, default))
    if unknown := given.keys() - PROJ_KEYS:
        raise ValueError(f"{text}: no formulas for {sorted(unknown)}")
    if given.get("proj") not in PROJ_METHODS or given.get("datum", "WGS84") not in DATUMS or given.get("ellps", "WGS84") not in ELLIPSOIDS or given.get("units", "m") not in UNITS:
        raise ValueError(f"{text}: unknown projection, datum, ellipsoid or unit")
    method = PROJ_METHODS[given["proj"]]
    ellipsoid, moves = DATUMS[given.get("datum", "WGS84")]
    axis, inverse = ELLIPSOIDS[given.get("ellps", ellipsoid)]
    axis, inverse = number("a", axis), number("rf", inverse)
    flattening = 1 - number("b") / axis if "b" in given else 1 / inverse if inverse else 0.0
    shared = {"axis": axis, "flattening": flattening, "unit": number("to_meter", UNITS[given.get("units", "m")]) if method != "geographic" else 1.0}
    shared |= _to_wgs84([float(v) for v in given["towgs84"].split(",")] if "towgs84" in given else list(moves))
    if "nadgrids" in given:
        if "towgs84" in given:
            raise ValueError(f"{text}: grids and parameters of one datum")
        shared |= {"shift": (0.0, 0.0, 0.0), "turn": (0.0,) * 4, "grids": tuple(n for n in given["nadgrids"].split(",") if n)}
    if given["proj"] == "utm":
        south = "south" in given
        return System("transverse", 0, 6 * int(number("zone")) - 183, (0, 0), UTM_EASTING, UTM_SOUTH if south else 0.0, UTM_SCALE, **shared)
    parallels = (number("lat_1"), number("lat_2", number("lat_1"))) if method in ("albers", "lambert") else (number("lat_ts"), 0.0)
    lat, lon = number("lat_0", parallels[0] if method == "lambert" else 0.0), number("lonc", number("lon_0"))
    gamma = number("gamma") if "gamma" in given else None
    return System(method, lat, lon, parallels, number("x_0"), number("y_0"), number("k_0", number("k", 1.0)), azimuth=number("alpha"), rectified=gamma, natural="no_uoff" in given or "no_off" in given, **shared)


def _wkt_nodes(text: str) -> list:
    """A bracketed text as nested lists: [name, value or node, ...]."""
    stack: list[list] = [[]]
    for quoted, word, mark in re.findall(r'"((?:[^"]|"")*)"|([^\s,\[\]()"]+)|([\[\]()])', text):
        if mark in ("[", "("):
            node = [stack[-1].pop()]
            stack[-1].append(node)
            stack.append(node)
        elif mark:
            if len(stack) < 2:
                raise ValueError("brackets that don't match")
            stack.pop()
        else:
            stack[-1].append(word or quoted)
    if len(stack) != 1 or not stack[0]:
        raise ValueError("brackets that don't match")
    return stack[0][0]


def _wkt_find(node: list, name: str) -> list | None:
    """The first node of a name, level by level."""
    level = [node]
    while level:
        for n in level:
            if n[0].upper() == name:
                return n
        level = [c for n in level for c in n[1:] if isinstance(c, list)]
    return None


# Projections by their WKT names without marks, with a parallel of true scale or not.
WKT_METHODS = {
    "albersconicequalarea": "albers", "albers": "albers", "lambertconformalconic2sp": "lambert", "lambertconformalconic1sp": "lambert", "lambertconformalconic": "lambert",
    "transversemercator": "transverse", "mercator1sp": "mercator", "mercator2sp": "mercator", "mercator": "mercator", "polarstereographic": "polar",
    "hotineobliquemercator": "natural", "hotineobliquemercatorazimuthcenter": "oblique", "obliquemercator": "oblique",
}


def of_wkt(text: str) -> System:
    """A system from WKT as LAS files carry it (PROJCS or GEOGCS, also inside COMPD_CS). Other kinds raise."""
    root = _wkt_nodes(text)
    projected, geographic = _wkt_find(root, "PROJCS"), _wkt_find(root, "GEOGCS")
    spheroid = geographic and _wkt_find(geographic, "SPHEROID")
    if not spheroid:
        raise ValueError("WKT without PROJCS or GEOGCS and its SPHEROID")
    meridian = _wkt_find(geographic, "PRIMEM")
    if meridian and float(meridian[2]):
        raise ValueError("prime meridians other than Greenwich have no formula")
    axis, inverse = float(spheroid[2]), float(spheroid[3])
    moves = _wkt_find(geographic, "TOWGS84")
    shared = {"axis": axis, "flattening": 1 / inverse if inverse else 0.0} | _to_wgs84([float(v) for v in moves[1:]] if moves else [])
    if not projected:
        first = _wkt_find(geographic, "AXIS")
        return System("geographic", 0, 0, lat_first=bool(first) and first[2].upper() in ("NORTH", "SOUTH"), **shared)
    named = re.sub("[^a-z0-9]", "", _wkt_find(projected, "PROJECTION")[1].lower())
    if named not in WKT_METHODS:
        raise ValueError(f"no formulas for the projection {named}")
    method = WKT_METHODS[named]
    given = {n[1].lower().replace(" ", "_"): float(n[2]) for n in projected[1:] if isinstance(n, list) and n[0].upper() == "PARAMETER"}
    unit = next((float(n[2]) for n in projected[1:] if isinstance(n, list) and n[0].upper() == "UNIT"), 1.0)
    one = lambda *names, default=0.0: next((given[n] for n in names if n in given), default)
    lat, lon = one("latitude_of_origin", "latitude_of_center", "central_parallel"), one("central_meridian", "longitude_of_center", "longitude_of_origin")
    parallels = (one("standard_parallel_1", default=lat), one("standard_parallel_2", default=one("standard_parallel_1", default=lat)))
    if method == "polar":  # the parallel of true scale is given as that of origin
        true = one("standard_parallel_1", default=lat)
        lat, parallels = copysign(90.0, true), (0.0 if abs(true) == 90 else true, 0.0)
    elif method == "mercator":
        lat, parallels = 0.0, (one("standard_parallel_1"), 0.0)
    rectified = given.get("rectified_grid_angle")
    kind = "oblique" if method == "natural" else method
    return System(kind, lat, lon, parallels, one("false_easting") * unit, one("false_northing") * unit, one("scale_factor", default=1.0), unit=unit, azimuth=one("azimuth"), rectified=rectified, natural=method == "natural", **shared)


def transform(source: str | int | System, target: str | int | System) -> Transform:
    """A function from coordinate columns of one system to those of another."""
    a, b = _system(source), _system(target)

    def run(x: Column, y: Column, z: Column) -> tuple[Column, Column, Column]:
        if a == b:
            return x, y, z
        if a == 3857:
            x, y = _mercator_back(x, y)
        elif isinstance(a, System):
            x, y = FORMULAS[a.method][1](a, x * a.unit, y * a.unit)
            x, y = _moved(x, y, z, a, True)
        if b == 3857:
            x, y = _mercator(x, y)
        elif isinstance(b, System):
            x, y = _moved(x, y, z, b, False)
            x, y = (c / b.unit for c in FORMULAS[b.method][0](b, x, y))
        return x, y, z

    return run


def reproject(points: DataFrame, source: str | int | System, target: str | int | System, position: str = POSITION, by: Transform | None = None) -> DataFrame:
    """points with their positions in another system."""
    run = by or transform(source, target)
    p = F.col(position)
    kinds = {f.name: f.dataType for f in points.schema[position].dataType.fields}
    out = run(*[p[a].cast("double") for a in "xyz"])
    return points.withColumn(position, vec(*[c.cast(kinds[a]) for a, c in zip("xyz", out, strict=True)]))


def reproject_between(source_points: DataFrame, target_points: DataFrame, source: str | int | System, target: str | int | System, by: Transform | None = None) -> DataFrame:
    """target_points with the reprojected positions of source_points, by index; the tables need equal lengths."""
    from .joins import zip_points

    moved = reproject(source_points.select(POINT_IDX, POSITION), source, target, by=by)
    both = zip_points(target_points, moved)
    return both.withColumn(POSITION, F.col(POSITION + "_right")).drop(POSITION + "_right")


def transform_bounds(box: Column, source: str | int | System, target: str | int | System) -> Column:
    """The box between the images of a box's two corners; only the corners are mapped."""
    run = transform(source, target)
    low, high = (vec(*run(*[box[e][a] for a in "xyz"])) for e in ("min", "max"))
    return box_unchecked(low, high)
