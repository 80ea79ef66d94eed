"""Geometry on coordinates as column expressions. Coordinates are nanodegrees (LONG) unless a name says degrees."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_M = 6_371_000.0
#: Metres of one degree of latitude.
DEGREE_M = EARTH_M * 3.141592653589793 / 180

# fixed values: the area's corners (latitude, longitude in degrees), closed
AREA = (
    (40.925398, -73.117393), (40.926034, -73.124602), (40.912822, -73.138967), (40.909763, -73.136451), (40.908006, -73.126973), (40.908452, -73.124195),
    (40.906895, -73.121700), (40.905286, -73.122594), (40.902669, -73.131498), (40.893097, -73.127557), (40.893881, -73.120148), (40.900724, -73.122800),
    (40.904083, -73.107499), (40.908453, -73.107537), (40.914851, -73.114094), (40.925398, -73.117393),
)


def nano_polygon(corners: Sequence[tuple[float, float]] = AREA) -> list[tuple[int, int]]:
    return [(round(a * 1e9), round(b * 1e9)) for a, b in corners]


def degrees(nano: Column) -> Column:
    return nano / 1e9


def nanodegrees(degree: Column) -> Column:
    """Rounded half to even."""
    return F.rint(degree * 1e9).cast("long")


def _a(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    p, q = F.radians(lat1), F.radians(lat2)
    return F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)


def haversine(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in degrees, by atan2."""
    a = _a(lat1, lon1, lat2, lon2)
    return 2 * EARTH_M * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def haversine_asin(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    """Metres between points in degrees, by asin."""
    return 2 * EARTH_M * F.asin(F.sqrt(_a(lat1, lon1, lat2, lon2)))


def nano_distance(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    return haversine(degrees(lat1), degrees(lon1), degrees(lat2), degrees(lon2))


def project(lat: Column, lon: Column, a_lat: Column, a_lon: Column, b_lat: Column, b_lon: Column) -> tuple[Column, Column, Column]:
    """The point of segment AB (degrees) nearest to a point in an equirectangular plane: latitude, longitude, and its share t of AB."""
    k = F.cos(F.radians(lat))
    dx, dy = b_lon * k - a_lon * k, b_lat - a_lat
    t = ((lon * k - a_lon * k) * dx + (lat - a_lat) * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(t, F.lit(0.0))))
    return a_lat + t * dy, (a_lon * k + t * dx) / k, t


def in_polygon(lat: Column, lon: Column, polygon: Sequence[tuple[int, int]]) -> Column:
    """Even-odd rule on whole nanodegrees with truncating division; polygon may be closed or open. For extents up to about 3 degrees.

    lat and lon are read once for all edges, so formulas in their place do not multiply.
    """
    pairs = [(a, b) for a, b in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True) if a[0] != b[0]]
    number = lambda x, name: F.lit(x).cast("long").alias(name)
    edges = F.array(*[F.struct(number(a[0], "a"), number(b[0], "b"), number(a[1], "lon"), number(b[1] - a[1], "run")) for a, b in pairs])

    def crossed(point: Column, edge: Column) -> Column:
        at = F.call_function("div", (point["lat"] - edge["a"]) * edge["run"], edge["b"] - edge["a"]) + edge["lon"]
        return ((point["lat"] < edge["a"]) != (point["lat"] < edge["b"])) & (point["lon"] < at)

    here = F.array(F.struct(lat.alias("lat"), lon.alias("lon")))
    return F.get(F.transform(here, lambda point: F.size(F.filter(edges, lambda edge: crossed(point, edge))) % 2 == 1), F.lit(0))


def in_polygon_degrees(lat: Column, lon: Column, corners: Sequence[tuple[float, float]] = AREA) -> Column:
    """Even-odd rule in floating point degrees."""
    crossings = F.lit(0)
    for (a_lat, a_lon), (b_lat, b_lon) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        if a_lat == b_lat:
            continue
        at = (lat - a_lat) * ((b_lon - a_lon) / (b_lat - a_lat)) + a_lon
        crossings = crossings + F.when(((lat < a_lat) != (lat < b_lat)) & (lon < at), 1).otherwise(0)
    return crossings % 2 == 1
