"""Coordinates, grids and distances as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

ACRE = 4046.86
METRES_PER_DEGREE = 111320.0

# WGS84 and the UTM scale: fixed values.
_A, _F, _K0, _E0 = 6378137.0, 1 / 298.257223563, 0.9996, 500000.0
_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
# Series in n of the transverse Mercator projection, forward and back, third order.
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_EPS = 2 * math.sqrt(_N) / (1 + _N)


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _atanh(x: Column) -> Column:
    return (F.log1p(x) - F.log1p(-x)) / 2


def utm_zone(lon, lat) -> Column:
    """EPSG code of the UTM zone of a point."""
    zone = F.lpad((F.floor((_c(lon) + 180) / 6) + 1).cast("string"), 2, "0")
    return F.concat(F.when(_c(lat) >= 0, F.lit("EPSG:326")).otherwise(F.lit("EPSG:327")), zone)


def to_utm(lon, lat, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(easting, northing) of degrees in a UTM zone."""
    phi, lam = F.radians(_c(lat)), F.radians(_c(lon) - (zone * 6 - 183))
    s = F.sin(phi)
    t = F.sinh(_atanh(s) - _EPS * _atanh(_EPS * s))
    xi, eta = F.atan2(t, F.cos(lam)), _atanh(F.sin(lam) / F.sqrt(1 + t * t))
    e = eta + sum(a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    n = xi + sum(a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(_ALPHA, 1))
    return _E0 + _K0 * _RECT * e, (10_000_000.0 if south else 0.0) + _K0 * _RECT * n


def from_utm(x, y, zone: int, south: bool = False) -> tuple[Column, Column]:
    """(longitude, latitude) of a point in a UTM zone."""
    xi, eta = (_c(y) - (10_000_000.0 if south else 0.0)) / (_K0 * _RECT), (_c(x) - _E0) / (_K0 * _RECT)
    xi2 = xi - sum(b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    eta2 = eta - sum(b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(_BETA, 1))
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + sum(d * F.sin(2 * j * chi) for j, d in enumerate(_DELTA, 1))
    return F.degrees(F.atan2(F.sinh(eta2), F.cos(xi2))) + (zone * 6 - 183), F.degrees(phi)


def bbox_acres(west, south, east, north) -> Column:
    """Area of a box in degrees."""
    mid = F.radians((_c(south) + _c(north)) / 2)
    return (_c(east) - _c(west)) * METRES_PER_DEGREE * F.cos(mid) * (_c(north) - _c(south)) * METRES_PER_DEGREE / ACRE


def cell(x, y, west, north, res) -> tuple[Column, Column]:
    """(row, col) of the pixel that holds a point; row 0 is the northern one."""
    return F.floor((north - _c(y)) / res).cast("long"), F.floor((_c(x) - west) / res).cast("long")


def distance2(x1, y1, x2, y2) -> Column:
    """Squared distance: compare it with a squared limit."""
    dx, dy = _c(x1) - _c(x2), _c(y1) - _c(y2)
    return dx * dx + dy * dy


def in_ring(x, y, xs, ys) -> Column:
    """Even-odd test of a point against a closed ring (the last vertex joins the first)."""
    x, y, xs, ys = _c(x), _c(y), _c(xs), _c(ys)
    n = F.size(xs)

    def crossing(i):
        j = F.pmod(i + 1, n)
        x1, y1, x2, y2 = F.get(xs, i), F.get(ys, i), F.get(xs, j), F.get(ys, j)
        over = (y1 > y) != (y2 > y)
        return over & (x < (x2 - x1) * (y - y1) / F.when(y2 != y1, y2 - y1).otherwise(F.lit(1.0)) + x1)

    hits = F.filter(F.sequence(F.lit(0), n - 1), crossing)
    return F.size(hits) % 2 == 1


def tile_id(source, row, col) -> Column:
    return F.format_string("%s_%04d_%04d", _c(source), _c(row), _c(col))


def safe_name(text) -> Column:
    """Letters and digits stay, all else becomes an underscore."""
    return F.regexp_replace(_c(text), "[^A-Za-z0-9]", "_")


def safe_double(text) -> Column:
    """A number, or 0 where there is none."""
    return F.coalesce(F.expr(f"try_cast({text} AS DOUBLE)"), F.lit(0.0))


def safe_int(text) -> Column:
    """A whole number, or 0 where there is none."""
    return F.coalesce(F.expr(f"try_cast({text} AS INT)"), F.lit(0))


def parent_name(path) -> Column:
    """Name of the folder that holds a file; 'unknown' without one."""
    parts = F.split(_c(path), "/")
    return F.coalesce(F.when(F.size(parts) >= 2, F.get(parts, F.size(parts) - 2)), F.lit("unknown"))
