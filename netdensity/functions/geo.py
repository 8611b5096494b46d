"""Map geometry as column expressions: projection, tiles, lattice keys, colours."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84, UTM scale and false easting, constants of the planar approximation (metres a degree).
AXIS, FLATTENING, SCALE, EASTING = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
LON_METRES, LAT_METRES, DEGREE_METRES = 82000.0, 111000.0, 111320.0
SNAP, RADIUS, SPACING, SNAP_REACH = 75.0, 800.0, 25.0, 150.0
CHUNK, HALO = 2000.0, RADIUS + SNAP_REACH + SPACING
#: Seven colour stops from low to high, and the opacity of a cell with a value.
PALETTE = ((34, 62, 92), (52, 112, 133), (92, 166, 159), (195, 215, 161), (250, 218, 126), (246, 156, 85), (209, 80, 61))
OPACITY = 210


def series() -> tuple[float, float, tuple[float, ...], tuple[float, ...], tuple[float, ...]]:
    """n, rectifying radius and the forward, inverse and latitude coefficients of the Krueger series, to fourth order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280)
    inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280)
    latitude = (2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630)
    return n, radius, forward, inverse, latitude


def utm_zone(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326zz north of the equator, 327zz south of it."""
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("long")


def project(lon: Column, lat: Column, meridian: float = -69.0) -> tuple[Column, Column]:
    """Easting and northing in the northern UTM zone around ``meridian``."""
    n, radius, forward, _, _ = series()
    s, dl = F.sin(F.radians(lat)), F.radians(lon - meridian)
    c = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(s) - c * F.atanh(c * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(forward, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return EASTING + SCALE * radius * east, SCALE * radius * north


def unproject(x: Column, y: Column, meridian: float = -69.0) -> tuple[Column, Column]:
    """Longitude and latitude of a northern UTM point."""
    _, radius, _, inverse, latitude = series()
    xi, eta = y / (SCALE * radius), (x - EASTING) / (SCALE * radius)
    xi2, eta2 = xi, eta
    for j, b in enumerate(inverse, 1):
        xi2 = xi2 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta2 = eta2 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi
    for j, d in enumerate(latitude, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return meridian + F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))), F.degrees(phi)


def buffer_degrees(metres: float, lat: Column) -> tuple[Column, Column]:
    """Degrees of longitude and latitude that ``metres`` are at a latitude."""
    return metres / (DEGREE_METRES * F.cos(F.radians(lat))), F.lit(metres / DEGREE_METRES)


def scaled(lon: Column, lat: Column) -> tuple[Column, Column]:
    return lon * LON_METRES, lat * LAT_METRES


def tile_coordinate(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Fractional web-map tile coordinates."""
    n = float(1 << zoom)
    return (lon + 180) / 360 * n, (1 - F.asinh(F.tan(F.radians(lat))) / math.pi) / 2 * n


def tile_at(lon: Column, lat: Column, zoom: int) -> tuple[Column, Column]:
    """Whole tile numbers, cut towards zero."""
    x, y = tile_coordinate(lon, lat, zoom)
    return x.cast("long"), y.cast("long")


def pixel_centre(x: Column, y: Column, px: Column, py: Column, zoom: int) -> tuple[Column, Column]:
    """Longitude and latitude of the centre of pixel (px, py) of a 256-pixel tile."""
    n = float(1 << zoom)
    tx, ty = x + (px + 0.5) / 256, y + (py + 0.5) / 256
    return tx / n * 360 - 180, F.degrees(F.atan(F.sinh(math.pi * (1 - 2 * ty / n))))


def cell_of(x: Column, y: Column, x0: float = 0.0, y0: float = 0.0, spacing: float = SPACING) -> tuple[Column, Column]:
    """Row and column of the lattice cell that a point lies in."""
    return F.floor((y - y0) / spacing), F.floor((x - x0) / spacing)


def kernel_exp(d: Column, scale: float = 120.0) -> Column:
    return F.exp(-d / scale)


def kernel_power(d: Column, p: float = 2.0, d0: float = 50.0) -> Column:
    return F.pow(1 + d / d0, F.lit(-p))


def kernel(spec: dict):
    """The kernel of a configuration: {"type": "exponential", "lambda_m": ..} or {"type": "power", "p": .., "d0_m": ..}."""
    kind = spec.get("type")
    if kind == "exponential":
        return lambda d: kernel_exp(d, spec.get("lambda_m", 300.0))
    if kind in ("power", "power_law"):
        return lambda d: kernel_power(d, spec.get("p", 2.0), spec.get("d0_m", 50.0))
    raise ValueError(f"no such kernel: {kind!r}")


def display(score: Column) -> Column:
    """A score on the fixed scale from 0 to 1, by log1p up to 30; null without a score (least and greatest pass over nulls)."""
    return F.when(score.isNull() | F.isnan(score), None).otherwise(F.least(F.greatest(F.log1p(score) / math.log1p(30), F.lit(0.0)), F.lit(1.0)))


def colour(v: Column) -> list[Column]:
    """Red, green, blue, alpha of a display value: linear between stops, cut to whole numbers; null is transparent."""
    last = len(PALETTE) - 1
    at = v * last
    low = F.least(F.floor(at), F.lit(last - 1)).cast("int")
    out = []
    for channel in range(3):
        stops = F.array(*[F.lit(float(p[channel])) for p in PALETTE])
        a, b = F.element_at(stops, low + 1), F.element_at(stops, low + 2)
        out.append(F.when(v.isNull() | F.isnan(v), 0).otherwise((a * (1 - (at - low)) + b * (at - low)).cast("int")))
    return [*out, F.when(v.isNull() | F.isnan(v), 0).otherwise(OPACITY)]


def pieces_ceil(length: Column, most: float = SPACING) -> Column:
    """Into how many pieces an edge is cut so that none is over ``most``."""
    return F.greatest(F.lit(1), F.ceil(length / most)).cast("int")


def pieces_round(length: Column, size: float = 10.0) -> Column:
    """Into how many pieces of about ``size`` an edge is cut; halves go to the even number."""
    return F.greatest(F.lit(1), F.bround(length / size)).cast("int")


def position_key(way: Column, segment: Column, j: Column) -> Column:
    """A key whose order is that of way, segment and piece."""
    return F.format_string("%012d:%06d:%06d", way, segment, j)
