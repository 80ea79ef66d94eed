"""Geometry, polylines, snapping and walkways against plain Python."""

import math
import random

import pytest
from pyspark.sql import functions as F

from kerbline.functions import geo, polyline
from kerbline.operators import snap, stairs, walkways, ways


def metres(a, b):
    p, q, d = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(d / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(h))


def foot(p, a, b):
    k = math.cos(math.radians(p[0]))
    dx, dy = (b[1] - a[1]) * k, b[0] - a[0]
    t = 0 if dx == dy == 0 else max(0, min(1, (((p[1] - a[1]) * k) * dx + (p[0] - a[0]) * dy) / (dx * dx + dy * dy)))
    return (a[0] + t * dy, a[1] + t * (b[1] - a[1])), t


def test_haversine_forms_agree(spark):
    rng = random.Random(1)
    rows = [tuple(rng.uniform(-89, 89) if i % 2 == 0 else rng.uniform(-180, 180) for i in range(4)) for _ in range(200)] + [(1.0, 2.0, 1.0, 2.0)]
    c = [F.col(x) for x in "abcd"]
    for r in spark.createDataFrame(rows, "a double, b double, c double, d double").select("*", geo.haversine(*c).alias("x"), geo.haversine_asin(*c).alias("y")).collect():
        assert r.x == pytest.approx(metres((r.a, r.b), (r.c, r.d)), rel=1e-9, abs=1e-6) and r.y == pytest.approx(r.x, rel=1e-7, abs=1e-4)


def test_polygon_may_be_open_or_closed(spark):
    square = [(0, 0), (0, 10), (10, 10), (10, 0)]
    points = spark.createDataFrame([(5, 5), (15, 5), (-1, 5), (5, -3)], "lat long, lon long")
    for polygon in (square, [*square, square[0]]):
        assert [r[0] for r in points.select(geo.in_polygon(F.col("lat"), F.col("lon"), polygon)).collect()] == [True, False, False, False]


def test_truncating_division_decides_at_the_border(spark):
    """Edges cross a row at a_lon + trunc((lat - a_lat) * dlon / dlat), seen from each edge's own first corner."""
    polygon = [(0, 0), (7, 3), (7, -9), (0, -9)]

    def inside(lat, lon):
        n = 0
        for (a, o), (b, q) in zip(polygon, [polygon[-1], *polygon[:-1]], strict=True):
            if (a > lat) != (b > lat):
                x = (q - o) * (lat - a)
                n += lon < abs(x) // abs(b - a) * (1 if (x < 0) == (b - a < 0) else -1) + o
        return n % 2 == 1

    points = spark.createDataFrame([(lat, lon) for lat in range(8) for lon in range(-12, 5)], "lat long, lon long")
    for r in points.select("*", geo.in_polygon(F.col("lat"), F.col("lon"), polygon).alias("x")).collect():
        assert r.x == inside(r.lat, r.lon)


def test_polyline_known_value_and_round_trip(spark):
    known = [(38.5, -120.2), (40.7, -120.95), (43.252, -126.453)]  # the format's published example
    rng = random.Random(2)
    lines = [(0, known), (1, [(round(rng.uniform(-90, 90), 5), round(rng.uniform(-180, 180), 5)) for _ in range(50)]), (2, []), (3, [(0.0, 0.0)])]
    df = spark.createDataFrame(lines, "id long, pts array<struct<lat: double, lon: double>>").select("id", polyline.encode(F.col("pts")).alias("text"))
    assert {r.id: r.text for r in df.collect()}[0] == "_p~iF~ps|U_ulLnnqC_mqNvxq`@"
    back = {}
    for r in polyline.decode(df, ["id"], "text").orderBy("id", "pos").collect():
        back.setdefault(r.id, []).append((round(r.lat, 5), round(r.lon, 5)))
    assert back == {i: pts for i, pts in lines if pts}


def test_combine_drops_shared_vertices(spark):
    df = spark.createDataFrame([([[1, 2], [2, 3, 4], [4, 5]],), ([[7, 8]],), ([],)], "lines array<array<int>>")
    assert [r[0] for r in df.select(polyline.combine(F.col("lines"))).collect()] == [[1, 2, 3, 4, 5], [7, 8], []]


def test_snap_matches_brute_force_at_any_first_radius(spark):
    rng = random.Random(3)
    nano = lambda: (int(rng.uniform(40.89, 40.92) * 1e9), int(rng.uniform(-73.14, -73.11) * 1e9))
    segs = []
    for i in range(60):
        a = nano()
        b = nano() if i % 10 == 0 else (a[0] + rng.randrange(-900000, 900000), a[1] + rng.randrange(-900000, 900000))
        segs.append((i, 0, *a, *(a if i == 5 else b)))
    points = [(i, rng.uniform(40.88, 40.93), rng.uniform(-73.15, -73.10)) for i in range(40)] + [(99, 41.5, -70.0), (98, 89.9, 10.0)]
    nowhere = [(200, float("nan"), 1.0), (201, 1e30, 5.0), (202, 95.0, 10.0), (203, None, 1.0), (204, float("inf"), 1.0)]
    p, s = spark.createDataFrame([*points, *nowhere], "req_id long, lat double, lon double"), spark.createDataFrame(segs, "edge_id long, seg int, a_lat long, a_lon long, b_lat long, b_lon long")
    want = {}
    for i, lat, lon in points:
        want[i] = min((metres((lat, lon), foot((lat, lon), (x[2] / 1e9, x[3] / 1e9), (x[4] / 1e9, x[5] / 1e9))[0]), x[0]) for x in segs)
    for first in (None, 2000.0):
        got = {r.req_id: (r.distance, r.edge_id) for r in snap.nearest(p, s, first).collect()}
        assert {i: e for i, (_, e) in got.items()} == {i: e for i, (_, e) in want.items()}
        assert all(got[i][0] == pytest.approx(want[i][0], abs=1e-6) for i in want)
    assert snap.nearest(p, s.limit(0)).count() == 0


def test_two_snaps_cut_an_edge_in_order(spark):
    v = lambda i, lat: (i, lat, 0)
    edge = spark.createDataFrame([(4, 9, 1, [v(9, 3000), v(5, 2000), v(1, 0)])], "edge_id long, u long, v long, polyline array<struct<id: long, lat: long, lon: long>>")
    snaps = spark.createDataFrame([(1, -1, 4, 1, 0.5, 2500, 0), (1, -2, 4, 0, 0.5, 1000, 0), (2, -1, 4, 0, 0.0, 0, 0)], "req_id long, node_id long, edge_id long, seg int, t double, q_lat long, q_lon long")
    got = {(r.req_id, r.piece): [p.lat for p in r.polyline] for r in snap.split_edges(snaps, edge).collect()}
    assert got == {(1, 0): [0, 1000], (1, 1): [1000, 2000, 2500], (1, 2): [2500, 3000], (2, 0): [0, 0], (2, 1): [0, 2000, 3000]}


@pytest.mark.parametrize("threshold", [0.001, 5.0, 300.0])
def test_stairs_within_threshold_match_brute_force(spark, threshold):
    rng = random.Random(4)
    at = lambda: (int(rng.uniform(59.99, 60.01) * 1e9), int(rng.uniform(-0.02, 0.02) * 1e9))
    steps = [at() for _ in range(40)]
    points = [(i, *at()) for i in range(300)] + [(1000 + i, *s) for i, s in enumerate(steps[:5])] + [(2000 + i, s[0] + 20000, s[1]) for i, s in enumerate(steps)]
    want = {i for i, a, o in points if any(metres((a / 1e9, o / 1e9), (x / 1e9, y / 1e9)) <= threshold for x, y in steps)}
    got = stairs.near_stairs(spark.createDataFrame(points, "edge_id long, lat long, lon long"), spark.createDataFrame(steps, "lat long, lon long"), threshold)
    assert {r.edge_id for r in got.collect()} == want


def test_clip_rejoins_pieces_and_densify_keeps_first_point(spark):
    square = [(0.0, 0.0), (0.0, 1.0), (1.0, 1.0), (1.0, 0.0), (0.0, 0.0)]
    pts = "line_id long, pts array<struct<lat: double, lon: double>>"
    lines = spark.createDataFrame([(1, [(0.5, -1.0), (0.5, 0.5), (0.6, 0.6), (0.5, 2.0), (0.5, 0.5)]), (2, [(0.1, 0.1), (0.2, 0.2)]), (3, [(5.0, 5.0), (6.0, 6.0)])], pts)
    got = {(r.line_id, r.piece): [(round(p.lat, 3), round(p.lon, 3)) for p in r.pts] for r in walkways.clip(lines, square).collect()}
    assert got == {(1, 0): [(0.5, 0.0), (0.5, 0.5), (0.6, 0.6), (0.571, 1.0)], (1, 1): [(0.5, 1.0), (0.5, 0.5)], (2, 0): [(0.1, 0.1), (0.2, 0.2)]}
    step = 10 / geo.DEGREE_M
    dense = spark.createDataFrame([(1, [(0.0, 0.0), (step, 0.0), (step + 1e-6, 0.0)]), (2, []), (3, [(1.0, 1.0)])], pts).select("line_id", F.size(walkways.densify(F.col("pts"), 3.0)).alias("n"))
    assert {r.line_id: r.n for r in dense.collect()} == {1: 5, 2: 0, 3: 1}


def test_new_ids_follow_the_requests_in_ranges(spark, monkeypatch):
    rows = [(i * 37 % 1000,) for i in range(1000)]
    parts, write = [], snap.materialize
    monkeypatch.setattr(snap, "materialize", lambda df, label: parts.append(df.select("__part").distinct().count()) or write(df, label))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges as small as these would be put together
    try:
        got = snap.new_ids(spark.createDataFrame([(7,), (50,)], "id long"), spark.createDataFrame(rows, "req_id long")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.req_id, r.node_id) for r in got) == [(i, 51 + i) for i in range(1000)]
    assert parts[0] > 1  # no task numbers them all


def test_many_polygons_match_the_single_one(spark):
    rng = random.Random(6)
    polygons = {}
    for k in range(150):
        y, x, r = rng.randrange(-10**7, 10**7), rng.randrange(-10**7, 10**7), rng.choice([50, 10**4, 10**6, 3 * 10**7])
        polygons[k] = [(int(y + r * rng.uniform(0.3, 1) * math.sin(a)), int(x + r * rng.uniform(0.3, 1) * math.cos(a))) for a in (2 * math.pi * i / 11 for i in range(11))]
    sides = [(k, *a, *b) for k, p in polygons.items() for a, b in zip(p, [*p[1:], p[0]], strict=True)]
    nodes = spark.createDataFrame([(i, rng.randrange(-10**7, 10**7), rng.randrange(-10**7, 10**7)) for i in range(400)], "id long, lat long, lon long")
    found = ways.inside_polygons(nodes, spark.createDataFrame(sides, "polygon_id long, a_lat long, a_lon long, b_lat long, b_lon long"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan

    def crosses(lat, lon, p):
        n = 0
        for (a, o), (b, q) in zip(p, [*p[1:], p[0]], strict=True):
            if (lat < a) != (lat < b):
                x = (lat - a) * (q - o)
                n += lon < abs(x) // abs(b - a) * (1 if (x < 0) == (b - a < 0) else -1) + o
        return n % 2

    want = {(r.id, k) for r in nodes.collect() for k, p in polygons.items() if crosses(r.lat, r.lon, p)}
    assert {(r.id, r.polygon_id) for r in found.collect()} == want and len(want) > 400
