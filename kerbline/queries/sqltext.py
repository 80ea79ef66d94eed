"""SQL text of the checks that several queries share."""

from __future__ import annotations

from ..functions.geo import AREA, nano_polygon

R = "6371000.0"


def hav(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    """Metres between points in degrees."""
    a = f"(pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))"
    return f"(2 * {R} * atan2(sqrt({a}), sqrt(1 - {a})))"


def hav_asin(a_lat: str, a_lon: str, b_lat: str, b_lon: str) -> str:
    return f"(2 * {R} * asin(sqrt(pow(sin((radians({b_lat}) - radians({a_lat})) / 2), 2) + cos(radians({a_lat})) * cos(radians({b_lat})) * pow(sin(radians({b_lon} - {a_lon}) / 2), 2))))"


def nano(a: str, b: str) -> str:
    """Metres between the points of two table aliases with lat and lon in nanodegrees."""
    return hav(f"{a}.lat / 1e9", f"{a}.lon / 1e9", f"{b}.lat / 1e9", f"{b}.lon / 1e9")


#: Edges of the closed polygon as rows, in whole nanodegrees.
POLYGON = "poly(a_lat, a_lon, b_lat, b_lon) AS (VALUES " + ", ".join(f"(CAST({a[0]} AS BIGINT), CAST({a[1]} AS BIGINT), CAST({b[0]} AS BIGINT), CAST({b[1]} AS BIGINT))" for a, b in zip(nano_polygon(), nano_polygon()[1:], strict=False)) + ")"
#: The same in degrees.
POLYGON_DEGREES = "polyd(a_lat, a_lon, b_lat, b_lon) AS (VALUES " + ", ".join(f"({a[0]!r}::DOUBLE, {a[1]!r}::DOUBLE, {b[0]!r}::DOUBLE, {b[1]!r}::DOUBLE)" for a, b in zip(AREA, AREA[1:], strict=False)) + ")"


def inside(nodes: str) -> str:
    """id and whether the node lies in POLYGON."""
    return f"""inside AS (SELECT n.id, sum(CASE WHEN ((poly.a_lat > n.lat) <> (poly.b_lat > n.lat))
        AND n.lon < (poly.b_lon - poly.a_lon) * (n.lat - poly.a_lat) // nullif(poly.b_lat - poly.a_lat, 0) + poly.a_lon THEN 1 ELSE 0 END) % 2 = 1 AS inside
        FROM {nodes} n, poly GROUP BY n.id)"""


WALKABLE = """walkable AS (SELECT way_id FROM way_tags GROUP BY way_id
    HAVING bool_or(k IN ('footway', 'highway') AND v NOT IN ('trunk', 'motorway', 'secondary', 'road', 'primary', 'tertiary', 'unclassified'))
    AND NOT bool_or(k = 'surface' AND v = 'ground'))"""


def split(vertices: str) -> str:
    """Legs of ways between junctions: way_id, seq (from 0), pos, a, b, d."""
    d = hav("lat / 1e9", "lon / 1e9", "b_lat / 1e9", "b_lon / 1e9")
    return f"""legs AS (SELECT way_id, seq - 1 AS seq, pos, node_id AS a, b, {d} AS d FROM (
        SELECT v.way_id, v.pos, v.node_id, v.lat, v.lon, lead(v.node_id) OVER w AS b, lead(v.lat) OVER w AS b_lat, lead(v.lon) OVER w AS b_lon,
        sum(CASE WHEN c.n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.way_id ORDER BY v.pos ROWS UNBOUNDED PRECEDING) AS seq,
        sum(CASE WHEN c.n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY v.way_id) AS n_junctions
        FROM {vertices} v JOIN (SELECT node_id, count(*) AS n FROM {vertices} GROUP BY 1) c ON v.node_id = c.node_id
        WINDOW w AS (PARTITION BY v.way_id ORDER BY v.pos)) WHERE seq >= 1 AND seq < n_junctions AND b IS NOT NULL)"""


#: Every pair of consecutive vertices of the dense graph.
DENSE_EDGES = f"""dense_edges AS (SELECT way_id * 10000 + pos AS edge_id, way_id, pos AS seq, node_id AS u, v, {hav("lat / 1e9", "lon / 1e9", "b_lat / 1e9", "b_lon / 1e9")} AS d,
    lat AS u_lat, lon AS u_lon, b_lat AS v_lat, b_lon AS v_lon FROM (SELECT way_id, pos, node_id, lat, lon, lead(node_id) OVER w AS v, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon
    FROM dense_vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos)) WHERE v IS NOT NULL)"""
