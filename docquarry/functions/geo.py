"""Distances on the earth, as column expressions, and units of length."""

from __future__ import annotations

import math
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from docquarry.errors import UserError

RADIUS_M = 6_371_008.7714
UNITS = {
    "mm": 0.001, "cm": 0.01, "m": 1.0, "km": 1000.0, "in": 0.0254, "ft": 0.3048, "yd": 0.9144, "mi": 1609.344, "nmi": 1852.0, "pc": 3.0856775814913674e16, "au": 1.495978707e11, "ly": 9.4607304725808e15,
    "millimeter": 0.001, "centimeter": 0.01, "meter": 1.0, "kilometer": 1000.0, "inch": 0.0254, "foot": 0.3048, "yard": 0.9144, "mile": 1609.344, "nauticalmile": 1852.0, "parsec": 3.0856775814913674e16,
    "astronomicalunit": 1.495978707e11, "lightyear": 9.4607304725808e15, "inches": 0.0254, "feet": 0.3048,
}


def meters(text: str) -> float:
    """``"5 km"`` or ``"5km"`` in meters."""
    m = re.fullmatch(r"\s*([+-]?\d+(?:\.\d+)?)\s*([A-Za-z]+)\s*", text)
    unit = m and (UNITS.get(m[2].lower()) or UNITS.get(m[2].lower().removesuffix("s")))
    if not m or not unit:
        raise UserError(f"bad distance {text!r}")
    if float(m[1]) < 0:
        raise UserError("a distance can't be negative")
    return float(m[1]) * unit


def haversine(lat: Column, lon: Column, lat0: float, lon0: float) -> Column:
    """Meters from each point to a given one; null for a null point."""
    p, q = F.radians(lat), math.radians(lat0)
    a = F.pow(F.sin((p - q) / 2), 2) + F.cos(p) * math.cos(q) * F.pow(F.sin((F.radians(lon) - math.radians(lon0)) / 2), 2)
    return 2 * RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def within(point: Column, lat0: float, lon0: float, radius: float) -> Column:
    """Whether points lie in a radius; a band of latitudes is compared first."""
    band = math.degrees(radius / RADIUS_M) + 1e-9
    return point["lat"].between(lat0 - band, lat0 + band) & (haversine(point["lat"], point["lon"], lat0, lon0) <= radius)


def in_box(point: Column, a: tuple[float, float], b: tuple[float, float]) -> Column:
    """Whether points lie between two corners, whichever they are; boxes don't wrap over the date line."""
    return point["lat"].between(min(a[0], b[0]), max(a[0], b[0])) & point["lon"].between(min(a[1], b[1]), max(a[1], b[1]))
