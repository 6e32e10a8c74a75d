"""Geographic and binning column functions (GE-*)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must match the reference's results.
EARTH_RADIUS_M = 6371000.0
CITY_CENTER = (52.3730, 4.8923)
DISTANCE_BIN_EDGES = [-1.0, 0.0, 2000.0, 5000.0, 10000.0, 20000.0, math.inf]
DISTANCE_BIN_LABELS = ["missing", "0–2km", "2–5km", "5–10km", "10–20km", "20km+"]
COUNT_BIN_EDGES = [-1.0, 0.0, 2.0, 5.0, 10.0, math.inf]
COUNT_BIN_LABELS = ["0", "1-2", "3-5", "6-10", "10+"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _num(x) -> Column:
    """Column name, Column or Python number -> double Column."""
    if isinstance(x, str):
        return F.col(x).cast("double")
    if isinstance(x, Column):
        return x.cast("double")
    return F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2) -> Column:
    """GE-1: great-circle distance in metres (atan2 form, R = 6 371 000)."""
    lat1, lon1, lat2, lon2 = _num(lat1), _num(lon1), _num(lat2), _num(lon2)
    phi1, phi2 = F.radians(lat1), F.radians(lat2)
    dphi = F.radians(lat2 - lat1)
    dlmb = F.radians(lon2 - lon1)
    a = F.pow(F.sin(dphi / 2), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(F.sin(dlmb / 2), 2)
    return F.lit(EARTH_RADIUS_M) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def cut(c, edges: list[float]) -> Column:
    """Right-closed bins (e0,e1], (e1,e2], ... -> 0, 1, ...; outside or NULL -> NULL."""
    c = _col(c).cast("double")
    expr = None
    for i in range(1, len(edges)):
        cond = (c > F.lit(edges[i - 1])) & (c <= F.lit(edges[i]))
        expr = F.when(cond, F.lit(i - 1)) if expr is None else expr.when(cond, F.lit(i - 1))
    return expr


def distance_to_center_bin(lat, lon, center=CITY_CENTER) -> Column:
    """GE-2: distance to the centre cut into 6 right-closed bins, codes 0..5."""
    return cut(haversine_m(lat, lon, center[0], center[1]), DISTANCE_BIN_EDGES)


def count_bin(c) -> Column:
    """GE-3: amenity count cut into 5 right-closed bins, codes 0..4."""
    return cut(c, COUNT_BIN_EDGES)


def planar_km(lat1, lon1, lat2, lon2) -> Column:
    """GE-5: planar centroid distance, degrees x 111 km."""
    dy = _num(lat1) - _num(lat2)
    dx = _num(lon1) - _num(lon2)
    return F.sqrt(dy * dy + dx * dx) * F.lit(111.0)


def box_km2(lat_min, lat_max, lon_min, lon_max) -> Column:
    """GE-5: planar area of a box, degrees x 111 km."""
    return (_num(lat_max) - _num(lat_min)) * F.lit(111.0) * (_num(lon_max) - _num(lon_min)) * F.lit(111.0)
