"""Column expressions: numbers from text, scales, coordinates, colours, grades.

Everything here stays in the JVM and inside generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c: str | Column) -> Column:
    """The value, or null for NaN and infinities."""
    v = col(c).cast("double")
    return F.when(~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))), v)


def parse_numeric(c: str | Column, decimal_comma: bool = True) -> Column:
    """Double from text with ``.`` or ``,``; null for anything that isn't wholly a finite number."""
    t = F.trim(col(c).cast("string"))
    if decimal_comma:
        t = F.regexp_replace(t, ",", ".")
    return finite(F.when(t.rlike(NUMBER), t.try_cast("double")))


def blank_to_null(c: str | Column) -> Column:
    t = F.trim(col(c).cast("string"))
    return F.when(t != "", t)


def clamp(c: str | Column, lo, hi) -> Column:
    return F.when(col(c).isNotNull(), F.greatest(F.least(col(c), F.lit(hi)), F.lit(lo)))


def round_half_away(c: str | Column) -> Column:
    v = col(c)
    return F.when(v >= 0, F.floor(v + 0.5)).otherwise(F.ceil(v - 0.5))


def scale_transform(c: str | Column, mode: str = "linear") -> Column:
    """linear, log10, ln or sqrt; null where the function isn't defined."""
    v = col(c)
    return {"linear": v, "log10": F.when(v > 0, F.log10(v)), "ln": F.when(v > 0, F.ln(v)), "sqrt": F.when(v >= 0, F.sqrt(v))}[mode]


def json_path_extract(c: str | Column, path: str) -> Column:
    """A dotted path with numeric indices (``a.0.b``) into JSON text."""
    steps = "".join(f"[{p}]" if p.isdigit() else f".{p}" for p in path.split(".") if p)
    return F.get_json_object(col(c), "$" + steps)


def grade_factor(unit: str) -> float:
    """Mass share that one unit of grade stands for."""
    return {"percent": 1e-2, "fraction": 1.0, "ppm": 1e-6, "g/t": 1e-6}[unit]


def utm_epsg(lon: Column, lat: Column) -> Column:
    """EPSG code of the UTM zone: 326zz north, 327zz south."""
    zone = clamp(F.floor((lon + 180) / 6) + 1, 1, 60)
    return (F.when(lat >= 0, F.lit(32600)).otherwise(F.lit(32700)) + zone).cast("int")


# Krueger series to third order in n on the WGS84 ellipsoid.
_A, _F = 6378137.0, 1 / 298.257223563
_N = _F / (2 - _F)
_RADIUS = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_K0, _E = 0.9996, 2 * math.sqrt(_N) / (1 + _N)


def lonlat_to_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in the zone of ``epsg`` (326zz or 327zz)."""
    central = (epsg % 100) * 6 - 183
    phi, lam = F.radians(lat), F.radians(lon - central)
    atanh = lambda v: F.log((1 + v) / (1 - v)) / 2
    s = F.sin(phi)
    t = F.sinh(atanh(s) - _E * atanh(_E * s))
    xi, eta = F.atan2(t, F.cos(lam)), atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return 500000 + _K0 * _RADIUS * x, F.when(epsg >= 32700, F.lit(1e7)).otherwise(F.lit(0.0)) + _K0 * _RADIUS * y


def utm_to_lonlat(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    xi0 = (y - F.when(epsg >= 32700, F.lit(1e7)).otherwise(F.lit(0.0))) / (_K0 * _RADIUS)
    eta0 = (x - 500000) / (_K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return (epsg % 100) * 6 - 183 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(phi)


def lonlat_to_mercator(lon: Column, lat: Column) -> tuple[Column, Column]:
    return F.radians(lon) * _A, F.log(F.tan(math.pi / 4 + F.radians(clamp(lat, -85.05112878, 85.05112878)) / 2)) * _A


def mercator_to_lonlat(x: Column, y: Column) -> tuple[Column, Column]:
    return F.degrees(x / _A), F.degrees(2 * F.atan(F.exp(y / _A)) - math.pi / 2)


#: Colour stops (position, red, green, blue).
RAMPS = {
    "inferno": ((0.0, 0, 0, 4), (0.2, 43, 10, 90), (0.45, 120, 28, 109), (0.7, 209, 58, 47), (1.0, 255, 59, 47)),
    "viridis": ((0.0, 68, 1, 84), (0.25, 59, 82, 139), (0.5, 33, 144, 140), (0.75, 93, 200, 99), (1.0, 253, 231, 37)),
    "terrain": ((0.0, 43, 131, 186), (0.35, 171, 221, 164), (0.6, 102, 189, 99), (0.8, 253, 174, 97), (1.0, 215, 25, 28)),
    "default": ((0.0, 44, 123, 182), (0.25, 0, 166, 202), (0.5, 0, 204, 106), (0.75, 249, 208, 87), (1.0, 215, 25, 28)),
}


def colour_ramp(t: Column, palette: str = "inferno") -> Column:
    """struct(r, g, b) of 8 bits for t in [0, 1], linear between stops."""
    stops = RAMPS.get(palette.lower(), RAMPS["default"])
    own = clamp(t, 0.0, 1.0)

    def channel(k: int) -> Column:
        out = F.lit(stops[-1][k]).cast("double")
        for a, b in reversed(list(zip(stops[:-1], stops[1:], strict=True))):
            out = F.when(own <= b[0], a[k] + (own - a[0]) / (b[0] - a[0]) * (b[k] - a[k])).otherwise(out)
        return round_half_away(out).cast("int")

    return F.struct(channel(1).alias("r"), channel(2).alias("g"), channel(3).alias("b"))


def category_position(c: str | Column) -> Column:
    """A place in [0, 1] for a value used as a category."""
    return F.abs(F.floor(F.round(col(c), 3) * 104729)) % 997 / 996
