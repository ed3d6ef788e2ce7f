"""Transverse Mercator projections in closed form (Krueger's series), as column expressions."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257222101
N = FLAT / (2 - FLAT)
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64)
ALPHA = (N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16, 13 * N**2 / 48 - 3 * N**3 / 5, 61 * N**3 / 240)


def parameters(crs: str) -> tuple[float, float, float, float] | None:
    """Central meridian, scale, false easting and northing of a transverse Mercator system; None for geographic coordinates."""
    code = re.sub(r"\D", "", crs)
    if code == "4326":
        return None
    if code == "2180":
        return 19.0, 0.9993, 500_000.0, -5_300_000.0
    if code[:3] in ("326", "327") and len(code) == 5 and 1 <= int(code[3:]) <= 60:
        return 6.0 * int(code[3:]) - 183, 0.9996, 500_000.0, 0.0 if code[2] == "6" else 10_000_000.0
    raise ValueError(f"no projection for {crs}")


def project(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    """Easting and northing of longitude and latitude in degrees."""
    p = parameters(crs)
    if p is None:
        return lon, lat
    lon0, k0, fe, fn = p
    e = 2 * math.sqrt(N) / (1 + N)
    phi, d = F.radians(lat), F.radians(lon - lon0)
    s = F.sin(phi)
    atanh = lambda x: 0.5 * F.log((1 + x) / (1 - x))
    t = F.sinh(atanh(s) - e * atanh(e * s))
    xi, eta = F.atan2(t, F.cos(d)), atanh(F.sin(d) / F.sqrt(1 + t * t))
    east, north = eta, xi
    for j, a in enumerate(ALPHA, 1):
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.lit(fe) + k0 * RADIUS * east, F.lit(fn) + k0 * RADIUS * north


def transform(x: Column, y: Column, source: str, target: str) -> tuple[Column, Column]:
    if source.lower() == target.lower():
        return x, y
    if parameters(source) is not None:
        raise ValueError(f"only from epsg:4326, not {source}")
    return project(x, y, target)
