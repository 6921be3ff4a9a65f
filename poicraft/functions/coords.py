"""Coordinate parsing and distances (X3, X4, X6, radius search)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from poicraft.functions._col import col

# Fixed value: decimal text accepted as a number (the syntax of Python float()
# without nan/inf, which are not valid JSON numbers, and without underscores).
NUMBER_PATTERN = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
# Fixed value: the strict coordinate form, digits '.' digits once signs are removed.
STRICT_PATTERN = r"^[0-9]+\.[0-9]+$"

EARTH_RADIUS_M = 6371000.0


def parse_number(c) -> Column:
    """Text → double, null when the text is not a plain decimal number."""
    s = col(c).cast("string")
    return F.when(s.rlike(NUMBER_PATTERN), s.try_cast("double"))


def _point(lng: Column, lat: Column, ok: Column) -> Column:
    return F.when(ok, F.array(lng, lat)).otherwise(F.array().cast("array<double>"))


def geojson_coords(lng, lat) -> Column:
    """``[lng, lat]`` as doubles when both parse, else an empty array."""
    x, y = parse_number(lng), parse_number(lat)
    return _point(x, y, x.isNotNull() & y.isNotNull())


def strict_coords(lng, lat) -> Column:
    """Both values must read digits.digits after removing '-'; else ``[]``."""
    def ok(c):
        s = col(c).cast("string")
        return (F.regexp_replace(s, "-", "").rlike(STRICT_PATTERN)
                & s.try_cast("double").isNotNull())
    lng_c, lat_c = col(lng).cast("string"), col(lat).cast("string")
    return _point(lng_c.try_cast("double"), lat_c.try_cast("double"),
                  F.coalesce(ok(lng) & ok(lat), F.lit(False)))


def planar_distance(lat1, lng1, lat2, lng2) -> Column:
    """Euclidean distance in degrees between two [lat, lng] points."""
    dlat = col(lat1) - col(lat2)
    dlng = col(lng1) - col(lng2)
    return F.sqrt(dlat * dlat + dlng * dlng)


def haversine_m(lat1, lng1, lat2, lng2, radius_m: float = EARTH_RADIUS_M) -> Column:
    """Great-circle distance in metres."""
    p1, p2 = F.radians(col(lat1)), F.radians(col(lat2))
    dphi = F.radians(col(lat2) - col(lat1))
    dlmb = F.radians(col(lng2) - col(lng1))
    a = (F.sin(dphi / 2) * F.sin(dphi / 2)
         + F.cos(p1) * F.cos(p2) * F.sin(dlmb / 2) * F.sin(dlmb / 2))
    return F.lit(2.0 * radius_m) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
