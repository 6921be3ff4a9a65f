"""Box and radius searches over a venue table with ``lat``/``lng`` columns.

On a table with a cell column (``operators.cells``) each search also names the ranges of
cells that its box or circle touches, so a clustered store is read only where they lie.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import and_, or_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from poicraft.functions.coords import EARTH_RADIUS_M, haversine_m
from poicraft.functions.text import icontains
from poicraft.operators.cells import CELL, in_cells

Box = tuple[Sequence[float], Sequence[float]]  # south-west and north-east corner, [lat, lng]


def _limit(df: DataFrame, order_by: Sequence[str], limit: int | None) -> DataFrame:
    return df if limit is None else df.orderBy(*order_by).limit(limit)


def _near_cells(df: DataFrame, boxes: Sequence[Box]) -> DataFrame:
    return df.filter(in_cells(boxes)) if CELL in df.columns else df


def _parts(sw: Sequence[float], ne: Sequence[float]) -> list[Box]:
    """The box, cut in two where it crosses the ±180° meridian."""
    if sw[1] <= ne[1]:
        return [(sw, ne)]
    return [(sw, (ne[0], 180.0)), ((sw[0], -180.0), ne)]


def in_box(sw: Sequence[float], ne: Sequence[float], lat: str = "lat", lng: str = "lng") -> Column:
    """Half-open box ``[sw, ne)``; points are ``[lat, lng]``. Plain range predicates,
    so on a parquet venue table they are pushed into the scan. A box whose west
    edge lies east of its east edge crosses the ±180° meridian."""
    west, east = F.col(lng) >= F.lit(float(sw[1])), F.col(lng) < F.lit(float(ne[1]))
    across = west | east if sw[1] > ne[1] else west & east
    return (F.col(lat) >= F.lit(float(sw[0]))) & (F.col(lat) < F.lit(float(ne[0]))) & across


def bbox_search(df: DataFrame, sw, ne, limit: int | None = None, order_by=("id",),
                lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Venues inside the box, first ``limit`` by ``order_by`` (all when None)."""
    return _limit(_near_cells(df, _parts(sw, ne)).filter(in_box(sw, ne, lat, lng)), order_by, limit)


def bbox_category_search(df: DataFrame, sw, ne, category_id: str, limit: int | None = None,
                         order_by=("id",), lat: str = "lat", lng: str = "lng",
                         cat_ids: str = "cat_id") -> DataFrame:
    """R2: R1 restricted to venues listing ``category_id``."""
    hit = F.array_contains(F.col(cat_ids), F.lit(category_id))
    return _limit(_near_cells(df, _parts(sw, ne)).filter(in_box(sw, ne, lat, lng) & hit), order_by, limit)


def circle_boxes(center: Sequence[float], radius_m: float, radius_earth_m: float = EARTH_RADIUS_M) -> list[Box]:
    """One or two boxes that hold the circle. Longitudes are in [-180, 180]; a circle that
    crosses ±180° gets two, one that holds a pole all longitudes."""
    lat0, lng0 = float(center[0]), float(center[1])
    ang = radius_m / radius_earth_m
    dlat = math.degrees(ang) * 1.000001
    south, north, cos0 = lat0 - dlat, lat0 + dlat, math.cos(math.radians(lat0))
    if not (ang < math.pi / 2 and math.sin(ang) < cos0):
        return [((south, -math.inf), (north, math.inf))]
    dlng = math.degrees(math.asin(math.sin(ang) / cos0)) * 1.000001
    west, east = lng0 - dlng, lng0 + dlng
    if west < -180.0:
        return [((south, -math.inf), (north, east)), ((south, west + 360.0), (north, math.inf))]
    if east > 180.0:
        return [((south, west), (north, math.inf)), ((south, -math.inf), (north, east - 360.0))]
    return [((south, west), (north, east))]


def near(center: Sequence[float], radius_m: float, lat: str = "lat", lng: str = "lng",
         radius_earth_m: float = EARTH_RADIUS_M) -> Column:
    """Haversine distance ≤ radius, behind a conservative lat/lng box prefilter
    (cheap range predicates evaluated first, pushable to the scan)."""
    boxes = circle_boxes(center, radius_m, radius_earth_m)
    (south, _), (north, _) = boxes[0]
    cond = (F.col(lat) >= F.lit(south)) & (F.col(lat) <= F.lit(north))
    sides = []
    for (_, west), (_, east) in boxes:
        side = [F.col(lng) >= F.lit(west)] * (west > -math.inf) + [F.col(lng) <= F.lit(east)] * (east < math.inf)
        sides += [reduce(and_, side)] if side else []
    if sides:
        cond = cond & reduce(or_, sides)
    dist = haversine_m(F.lit(float(center[0])), F.lit(float(center[1])), F.col(lat), F.col(lng), radius_earth_m)
    return cond & (dist <= F.lit(float(radius_m)))


def radius_search(df: DataFrame, center, radius_m: float, limit: int | None = None,
                  order_by=("id",), lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Venues within ``radius_m`` metres of ``center`` = ``[lat, lng]``."""
    return _limit(_near_cells(df, circle_boxes(center, radius_m)).filter(near(center, radius_m, lat, lng)), order_by, limit)


def radius_query_search(df: DataFrame, center, radius_m: float, query: str,
                        limit: int | None = None, order_by=("id",), lat: str = "lat",
                        lng: str = "lng", name: str = "name") -> DataFrame:
    """R3 and the query text occurs (case-folded) in the venue name."""
    cond = near(center, radius_m, lat, lng) & icontains(name, query)
    return _limit(_near_cells(df, circle_boxes(center, radius_m)).filter(cond), order_by, limit)
