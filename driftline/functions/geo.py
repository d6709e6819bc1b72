"""Distances, projections and polygons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
WGS84_A, WGS84_F = 6378.137, 1 / 298.257223563
# public parameters of EPSG:2180: GRS80, central meridian 19, scale 0.9993, false easting and northing
TM_2180 = {"a": 6378137.0, "f": 1 / 298.257222101, "lon0": 19.0, "k": 0.9993, "fe": 500_000.0, "fn": -5_300_000.0}


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on a sphere; null if a coordinate is."""
    half = lambda a, b: F.pow(F.sin(F.radians(b - a) / 2), 2)
    a = half(lat1, lat2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half(lon1, lon2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.when(a > 1, 1.0).otherwise(a)))


def vincenty(lat1, lon1, lat2, lon2) -> np.ndarray:
    """Kilometres on the WGS84 ellipsoid. Nearly antipodal points, where the series doesn't settle, give the sphere's distance."""
    lat1, lon1, lat2, lon2 = (np.radians(np.asarray(x, float)) for x in (lat1, lon1, lat2, lon2))
    b = WGS84_A * (1 - WGS84_F)
    u1, u2 = np.arctan((1 - WGS84_F) * np.tan(lat1)), np.arctan((1 - WGS84_F) * np.tan(lat2))
    s1, c1, s2, c2 = np.sin(u1), np.cos(u1), np.sin(u2), np.cos(u2)
    diff = lon2 - lon1
    lam = diff.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(200):
            sl, cl = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sl, c1 * s2 - s1 * c2 * cl)
            cos_s = s1 * s2 + c1 * c2 * cl
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, c1 * c2 * sl / sin_s)
            cos2_a = 1 - sin_a**2
            cos_m = np.where(cos2_a < 1e-15, 0, cos_s - 2 * s1 * s2 / cos2_a)
            c = WGS84_F / 16 * cos2_a * (4 + WGS84_F * (4 - 3 * cos2_a))
            new = diff + (1 - c) * WGS84_F * sin_a * (sigma + c * sin_s * (cos_m + c * cos_s * (-1 + 2 * cos_m**2)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if np.all(settled | np.isnan(lam)):
                break
        uu = cos2_a * (WGS84_A**2 - b**2) / b**2
        big_a = 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu)))
        big_b = uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu)))
        inner = cos_s * (-1 + 2 * cos_m**2) - big_b / 6 * cos_m * (-3 + 4 * sin_s**2) * (-3 + 4 * cos_m**2)
        out = b * big_a * (sigma - big_b * sin_s * (cos_m + big_b / 4 * inner))
        h = np.sin((lat2 - lat1) / 2) ** 2 + np.cos(lat1) * np.cos(lat2) * np.sin(diff / 2) ** 2
        sphere = 2 * EARTH_KM * np.arcsin(np.sqrt(np.minimum(h, 1)))
        return np.where(settled | np.isnan(sphere), out, sphere)


def geodesic(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Kilometres on the ellipsoid by an Arrow UDF; null if a coordinate is. Apply it to distinct pairs of places."""

    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series, c: pd.Series, d: pd.Series) -> pd.Series:
        km = vincenty(a, b, c, d)
        return pd.Series(km).where(~np.isnan(km), None)

    return run(*[x.cast("double") for x in (lat1, lon1, lat2, lon2)])


def from_transverse_mercator(northing: Column, easting: Column, p: dict | None = None) -> Column:
    """struct(lat, lon) in degrees of plane coordinates in metres, by the inverse series to the fourth order."""
    p = p or TM_2180
    n = p["f"] / (2 - p["f"])
    radius = p["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi, eta = (northing - p["fn"]) / (p["k"] * radius), (easting - p["fe"]) / (p["k"] * radius)
    x, y = xi, eta
    for k, b in enumerate(beta, 1):
        x = x - b * F.sin(2 * k * xi) * F.cosh(2 * k * eta)
        y = y - b * F.cos(2 * k * xi) * F.sinh(2 * k * eta)
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi
    for k, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * k * chi)
    return F.struct(F.degrees(lat).alias("lat"), (F.degrees(F.atan2(F.sinh(y), F.cos(x))) + p["lon0"]).alias("lon"))


def to_transverse_mercator(lat: float, lon: float, p: dict | None = None) -> tuple[float, float]:
    """(northing, easting): the forward series, to check the inverse with."""
    p = p or TM_2180
    n = p["f"] / (2 - p["f"])
    radius = p["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    phi, dlon = math.radians(lat), math.radians(lon - p["lon0"])
    e = 2 * math.sqrt(n) / (1 + n)
    t = math.sinh(math.atanh(math.sin(phi)) - e * math.atanh(e * math.sin(phi)))
    xi, eta = math.atan2(t, math.cos(dlon)), math.atanh(math.sin(dlon) / math.hypot(1, t))
    x = xi + sum(a * math.sin(2 * k * xi) * math.cosh(2 * k * eta) for k, a in enumerate(alpha, 1))
    y = eta + sum(a * math.cos(2 * k * xi) * math.sinh(2 * k * eta) for k, a in enumerate(alpha, 1))
    return p["fn"] + p["k"] * radius * x, p["fe"] + p["k"] * radius * y


def ring_edges(rings: Column) -> Column:
    """Array of edges (x1, y1, x2, y2) of rings, arrays of (lon, lat) points; rings are closed if they aren't."""

    def edges(ring: Column) -> Column:
        step = lambda p, k: F.struct(
            p["lon"].alias("x1"),
            p["lat"].alias("y1"),
            F.get(ring, (k + 1) % F.size(ring))["lon"].alias("x2"),
            F.get(ring, (k + 1) % F.size(ring))["lat"].alias("y2"),
        )
        return F.transform(ring, step)

    return F.flatten(F.transform(rings, edges))


def within(lon: Column, lat: Column, edges: Column) -> Column:
    """Whether a point is inside the edges by the even-odd rule: holes are outside, and so is the border. Null for a null point."""
    crosses = lambda e: ((e["y1"] > lat) != (e["y2"] > lat)) & (lon < (e["x2"] - e["x1"]) * (lat - e["y1"]) / (e["y2"] - e["y1"]) + e["x1"])
    cross = lambda e: (e["x2"] - e["x1"]) * (lat - e["y1"]) - (e["y2"] - e["y1"]) * (lon - e["x1"])
    on = lambda e: (
        (cross(e) == 0)
        & lon.between(F.least(e["x1"], e["x2"]), F.greatest(e["x1"], e["x2"]))
        & lat.between(F.least(e["y1"], e["y2"]), F.greatest(e["y1"], e["y2"]))
    )
    safe = lambda e: (e["y1"] != e["y2"]) & crosses(e)
    return F.when(lon.isNull() | lat.isNull(), F.lit(None)).otherwise((F.size(F.filter(edges, safe)) % 2 == 1) & ~F.exists(edges, on))
