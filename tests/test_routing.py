"""Search, directions, sources and the model on small inputs."""

import json
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from kerbline.jobs.best_route import alternatives
from kerbline.jobs.directions import directions, parse_point, steps
from kerbline.operators import alternatives as alt
from kerbline.operators import edges, routing, scoring, ways
from kerbline.sources import io, pbf


def graph(seed, n=12, m=22):
    rng = random.Random(seed)
    return [(i, rng.randrange(n), rng.randrange(n), rng.choice([1.0, 1.5, 2.0, 3.25])) for i in range(m)]


def arcs_of(spark, g):
    return spark.createDataFrame([r for e, u, v, w in g for r in ((u, v, e, w), (v, u, e, w))], "src long, dst long, edge_id long, weight double")


def all_paths(g, src, dst, cost=0.0, seen=()):
    seen = (*seen, src)
    if src == dst:
        yield cost, seen
        return
    for _, u, v, w in g:
        for a, b in {(u, v), (v, u)}:
            if a == src and b not in seen:
                yield from all_paths(g, b, dst, cost + w, seen)


def test_paths_match_enumeration(spark):
    g = graph(1)
    pairs = [(i, i % 12, (i * 5 + 3) % 12) for i in range(12)] + [(50, 3, 3), (51, 0, 77)]
    problems = spark.createDataFrame(pairs, "req_id long, src long, dst long")
    want = {i: sorted(c for c, _ in all_paths(g, a, b)) for i, a, b in pairs}
    got = {r.req_id: r for r in routing.shortest_paths(problems, arcs_of(spark, g)).collect()}
    assert {i: r.cost for i, r in got.items()} == {i: c[0] for i, c in want.items() if c}
    assert got[50].cost == 0 and got[50].edge_ids == [] and got[50].nodes == [3] and 51 not in got
    weight = {e: w for e, _, _, w in g}
    assert all(sum(weight[e] for e in r.edge_ids) == r.cost and len(r.nodes) == len(r.edge_ids) + 1 for r in got.values())
    best = {}
    for r in alt.k_shortest_paths(problems, arcs_of(spark, g), 4).collect():
        best.setdefault(r.req_id, []).append((r.rank, r.cost))
        assert len(set(r.nodes)) == len(r.nodes)
    for i, c in want.items():
        assert [x for _, x in sorted(best.get(i, []))] == pytest.approx(c[:4]), i


def grid(n, rng):
    """A grid of streets with a dead end, parallel edges and a loop; whole lengths, so that ties are exact."""
    g = []
    for i in range(n):
        for j in range(n):
            for a, b in ((i + 1, j), (i, j + 1)):
                if a < n and b < n:
                    g.append((len(g), i * n + j, a * n + b, float(rng.choice([1, 2, 3]))))
    return [*g, (len(g), 0, 500, 2.0), (len(g) + 1, 1, 2, 1.0), (len(g) + 2, 3, 3, 1.0), (len(g) + 3, 600, 601, 1.0)]


def simple_paths(g, src, dst):
    """(cost, nodes, edges) of all loopless paths."""
    out, todo = [], [(0.0, (src,), ())]
    while todo:
        cost, nodes, used = todo.pop()
        if nodes[-1] == dst:
            out.append((cost, list(nodes), list(used)))
            continue
        for e, u, v, w in g:
            for a, b in {(u, v), (v, u)}:
                if a == nodes[-1] and b not in nodes:
                    todo.append((cost + w, (*nodes, b), (*used, e)))
    return sorted(out)


def test_k_paths_match_all_paths_of_a_grid(spark, monkeypatch):
    g = grid(4, random.Random(5))
    pairs = [(1, 0, 15), (2, 3, 12), (3, 500, 10), (4, 500, 0), (5, 7, 7), (6, 0, 600), (7, 600, 601), (8, 0, 999), (9, 2, 1)]
    problems = spark.createDataFrame(pairs, "req_id long, src long, dst long")
    want = {i: simple_paths(g, a, b)[:5] for i, a, b in pairs}

    def got(found):
        out = {i: [] for i, _, _ in pairs}
        for r in sorted(found.collect(), key=lambda r: (r.req_id, r.rank)):
            out[r.req_id].append((r.cost, r.nodes, r.edge_ids))
        return out

    assert got(alt.k_shortest_paths(problems, arcs_of(spark, g), 5)) == want
    # bounds that leave paths out are widened, and in the end there is none
    monkeypatch.setattr(alt, "SPARE", 1)
    monkeypatch.setattr(alt, "WIDER", ())
    assert got(alt.k_shortest_paths(problems.where("req_id in (1, 4, 8)"), arcs_of(spark, g), 5)) == {i: want[i] if i in (1, 4, 8) else [] for i in want}


def test_ways_come_in_order_from_arcs():
    for seed in range(30):
        rng = random.Random(seed)
        g = [(e, rng.randrange(7), rng.randrange(7), float(rng.choice([0, 1, 1, 2, 5]))) for e in range(rng.choice([6, 12, 15]))]
        arcs = {(a, b, e, w) for e, u, v, w in g for a, b in ((u, v), (v, u)) if a != b}
        for src, dst in ((0, 6), (3, 2)):
            for k in (1, 4, 1000):
                found = [(c, list(n), list(e)) for c, n, e in alt.ways_in_order(arcs, src, dst, k)]
                assert found == simple_paths(g, src, dst)[:k]


def test_a_lost_round_is_written_again(spark):
    """No round reads folders that are gone: what a search returns can be computed twice."""
    g = graph(3)
    found = routing.shortest_paths(spark.createDataFrame([(1, 0, 5), (2, 3, 9)], "req_id long, src long, dst long"), arcs_of(spark, g))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, found.repartition(3).collect()))


def square(spark):
    """A square of four edges with stairs on the short way, and a loop."""
    at = {1: (40_900_000_000, -73_120_000_000), 2: (40_901_000_000, -73_120_000_000), 3: (40_901_000_000, -73_119_000_000), 4: (40_900_000_000, -73_117_000_000)}
    rows = [(10, 1, 2), (11, 2, 3), (12, 3, 4), (13, 1, 4), (14, 2, 2)]
    full = [(e, u, v, [(u, *at[u]), (v, *at[v])]) for e, u, v in rows]
    df = spark.createDataFrame(full, "edge_id long, u long, v long, polyline array<struct<id: long, lat: long, lon: long>>")
    leg = lambda i: F.get("polyline", F.lit(i))
    from kerbline.functions.geo import nano_distance

    return df.withColumn("distance", nano_distance(leg(0)["lat"], leg(0)["lon"], leg(1)["lat"], leg(1)["lon"]))


def test_directions_statuses_and_stairs(spark):
    e = square(spark)
    stairs = spark.createDataFrame([(40_901_000_000, -73_119_000_000)], "lat long, lon long")
    requests = spark.createDataFrame([(1, "40.9002,-73.12", "40.9,-73.1171"), (2, "north", "40.9,-73.1"), (3, "40.9002, -73.1200001", "40.9002,-73.1200001"), (4, "40.9002,-73.12", "40.9008,-73.12"), (5, None, "1,2"), (6, "40.9002,-73.12", "40.901,-73.1191")], "req_id long, start string, end string")
    out = {r.req_id: r for r in directions(requests, e, stairs).collect()}
    assert {i: r.status for i, r in out.items()} == {1: 200, 2: 400, 3: 200, 4: 200, 5: 400, 6: 200}
    body = json.loads(out[1].body)
    assert body["routes"][0]["legs"][0]["distance"]["value"] == out[1].cost < 1000 and body["request"]["travelMode"] == "WALKING"
    assert out[4].cost == pytest.approx(66.7, abs=0.2)  # both points on one edge: only its middle piece
    assert 150 < out[6].cost < 1e6  # the piece up to the stop does not touch the stairs itself
    bad = [(7, "nan,1", "1,2"), (8, "1e30,5", "1,2"), (9, "40.9,-73.12", "95,10"), (10, "40.9,-73.12", "Infinity,3"), (11, "40.9002,-73.12", "40.9008,-73.12")]
    again = directions(spark.createDataFrame(bad, "req_id long, start string, end string"), e, stairs).collect()
    assert {r.req_id: r.status for r in again} == {7: 400, 8: 400, 9: 400, 10: 400, 11: 200}
    none = directions(requests, e.limit(0), stairs).collect()
    assert {r.req_id: r.status for r in none} == {1: 404, 2: 400, 3: 404, 4: 404, 5: 400, 6: 404}


def test_points_and_steps(spark):
    lat, lon = parse_point(F.col("t"))
    got = spark.createDataFrame([("1.5,-2",), (" 3 , 4 ",), ("5",), ("a,b",), ("1,2,3",), (None,)], "t string").select(lat.alias("a"), lon.alias("b")).collect()
    assert [tuple(r) for r in got][:2] == [(1.5, -2.0), (3.0, 4.0)] and all(r.a is None or r.b is None for r in got[2:])
    step = {"start_location": {"lat": 1, "lng": 2}, "end_location": {"lat": 1, "lng": 2}, "distance": {"value": 5}, "duration": {"value": 6}, "polyline": {"points": "x"}}
    docs = [(1, json.dumps({"routes": [{"legs": [{"steps": [step, {"distance": {"value": 1}}]}, {"steps": [step]}]}, {"legs": [{"steps": [step]}]}]})), (2, "no json"), (3, "{}"), (4, None)]
    assert sorted((r.id, r.leg, r.step) for r in steps(spark.createDataFrame(docs, "id long, body string")).collect()) == [(1, 0, 0), (1, 1, 0)]


def test_junctions_split_ways(spark):
    refs = {1: [1, 2, 3, 4, 5], 2: [9, 3, 8], 3: [5, 7, 5], 4: [20, 21]}
    rows = [(w, i, n, n * 1_000_000, 0) for w, ns in refs.items() for i, n in enumerate(ns)]
    cut = edges.split_at_junctions(spark.createDataFrame(rows, "way_id long, pos int, node_id long, lat long, lon long")).collect()
    assert sorted((r.way_id, r.seq, r.u, r.v, [p.id for p in r.polyline]) for r in cut) == [(1, 0, 3, 5, [3, 4, 5]), (3, 0, 5, 5, [5, 7, 5])]


def test_resolved_ways_round_trip(spark, tmp_path):
    refs = spark.createDataFrame([(1, 0, 5), (1, 1, 6), (2, 0, 5)], "way_id long, pos int, node_id long")
    nodes = spark.createDataFrame([(5, 50, 51)], "id long, lat long, lon long")
    io.write_ways(ways.resolved_ways(ways.resolve_refs(refs, nodes)), f"{tmp_path}/w")
    got = {r.way_id: [tuple(p) for p in r.refs] for r in io.read_ways(spark, f"{tmp_path}/w", lines=True).collect()}
    assert got == {1: [(5, 50, 51), (6, 0, 0)], 2: [(5, 50, 51)]}
    assert ways.resolve_refs(refs, nodes, "null").where("lat is null").count() == 1
    (tmp_path / "a.json").write_text(json.dumps([{"way_id": 9, "refs": [{"id": 1, "lat": 2, "lon": 3}]}]))
    assert io.read_ways(spark, f"{tmp_path}/a.json").first().refs[0].lon == 3
    (tmp_path / "n.json").write_text(json.dumps([{"id": 1, "lat": 2, "lon": 3}]))
    assert io.read_nodes(spark, f"{tmp_path}/n.json").count() == 1
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"geometry": [{"lat": 1.0, "lon": 2.0}]}, {"type": "node"}]}))
    assert io.read_overpass(spark, f"{tmp_path}/o.json").count() == 1
    seg = edges.way_segments(square(spark).withColumn("way_id", F.lit(7)).withColumn("seq", (F.col("edge_id") - 10).cast("int")))
    io.write_segments(seg, f"{tmp_path}/s")
    assert sorted((r.seq, r.u, r.v) for r in io.read_edges(spark, f"{tmp_path}/s", lines=True).collect()) == [(0, 1, 2), (1, 2, 3), (2, 3, 4), (3, 1, 4), (4, 2, 2)]


# ---- a test-only PBF writer


def varint(n):
    n &= (1 << 64) - 1
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


zig = lambda n: (n << 1) ^ (n >> 63)
num = lambda f, n: varint(f << 3) + varint(n)
raw = lambda f, b: varint(f << 3 | 2) + varint(len(b)) + b
packed = lambda f, ns: raw(f, b"".join(map(varint, ns)))
deltas = lambda ns: [zig(b - a) for a, b in zip([0, *ns], ns)]


def blob(kind, block, compress=True):
    body = num(2, len(block)) + raw(3, zlib.compress(block)) if compress else raw(1, block)
    head = raw(1, kind) + num(3, len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf_round_trip(spark, tmp_path):
    box = raw(1, b"".join(num(f, zig(n)) for f, n in ((1, -73_139), (2, -73_101), (3, 40_926), (4, 40_893))))
    dense = [(7, 409_000_001, -731_000_001), (12_405_623_394, 409_000_500, -731_200_000), (3, -5, 6)]
    strings = raw(1, b"".join(raw(1, s.encode()) for s in ("", "highway", "steps", "näme", "ü")))
    group1 = raw(2, raw(2, packed(1, deltas([n[0] for n in dense])) + packed(8, deltas([n[1] for n in dense])) + packed(9, deltas([n[2] for n in dense]))))
    way = num(1, 55) + packed(2, [1, 3]) + packed(3, [2, 4]) + packed(8, deltas([7, 3, 7]))
    group2 = raw(2, raw(1, num(1, zig(99)) + num(8, zig(10)) + num(9, zig(-20))) + raw(3, way) + raw(3, num(1, 56)))
    data = blob(b"OSMHeader", box) + blob(b"OSMData", strings + group1 + group2) + blob(b"OSMData", strings + group1 + num(17, 1000) + num(19, 500), compress=False)
    path = tmp_path / "x.osm.pbf"
    path.write_bytes(data)
    spark.dataSource.register(pbf.OsmPbf)
    read = lambda kind: spark.read.format("osmpbf").option("kind", kind).option("partitionBytes", 1).load(str(path))
    want = [(i, a * 100, o * 100) for i, a, o in dense] + [(99, 1000, -2000)] + [(i, 500 + a * 1000, o * 1000) for i, a, o in dense]
    assert sorted(tuple(r) for r in read("nodes").collect()) == sorted(want)
    got = {r.way_id: (r.refs, r.tags) for r in read("ways").collect()}
    assert got == {55: ([7, 3, 7], {"highway": "steps", "näme": "ü"}), 56: ([], {})}
    assert tuple(read("header").first()) == (40_893, 40_926, -73_139, -73_101)
    # a folder of extracts, and what the options leave out
    (tmp_path / "all" / "deep").mkdir(parents=True)
    (tmp_path / "all" / "a.osm.pbf").write_bytes(data)
    (tmp_path / "all" / "deep" / "b.pbf").write_bytes(blob(b"OSMHeader", box) + blob(b"OSMData", strings + group2))
    (tmp_path / "all" / "notes.txt").write_text("no extract")
    folder = lambda kind, **options: spark.read.format("osmpbf").options(kind=kind, **options).load(str(tmp_path / "all"))
    again = [*want, (99, 1000, -2000)]
    assert sorted(tuple(r) for r in folder("nodes").collect()) == sorted(again)
    assert sorted(r.way_id for r in folder("ways").collect()) == [55, 55, 56, 56] and folder("header").count() == 2
    assert sorted(tuple(r) for r in folder("nodes", box="0,-5000,2000,0").collect()) == sorted(n for n in again if 0 <= n[1] <= 2000 and -5000 <= n[2] <= 0)
    assert sorted(tuple(r) for r in folder("nodes", ids="7,99").collect()) == sorted(n for n in again if 7 <= n[0] <= 99)
    assert [r.way_id for r in folder("ways", tag="highway").collect()] == [55, 55] and folder("ways", ids="56,56").count() == 2
    reader = pbf.Reader(str(tmp_path / "all"), "nodes", 1)
    sizes = [sum(n for _, n in r.blobs) for r in reader.partitions()]
    assert len(sizes) == 3 and sizes == sorted(sizes, reverse=True)


def test_cost_model(spark, tmp_path):
    rows = [(1200.0, 0.02, 0.0, 20.0), (1500.0, 0.05, 1.0, 40.0), (1000.0, 0.01, 0.0, 15.0), (2000.0, 0.03, 0.0, 30.0), (1800.0, 0.04, 2.0, 45.0)]
    model = scoring.train(spark.createDataFrame(rows, "distance double, avg_slope double, stairs double, cost double"))
    scoring.save(model, f"{tmp_path}/m")
    two = spark.createDataFrame([(1, 1, 1200.0, 0.0, 0.0), (1, 2, 1500.0, 0.0, 1.0), (2, 1, 900.0, 0.0, 0.0), (2, 2, 900.0, 0.0, 0.0)], "req_id long, cand_id long, distance double, avg_slope double, stairs double")
    best = scoring.best(scoring.predict(scoring.load(f"{tmp_path}/m"), two)).collect()
    assert sorted((r.req_id, r.cand_id) for r in best) == [(1, 1), (2, 1)]


def test_slope_rules(spark):
    path = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0), (1, 1, 0.0, 0.0, 9.0), (1, 2, 0.001, 0.0, 20.0), (2, 0, 0.0, 0.0, 1.0), (3, 0, 0.0, 0.0, None), (3, 1, 0.1, 0.0, 3.0)], "route_id long, pos int, lat double, lon double, elevation double")
    got = {r.route_id: r.avg_slope for r in scoring.average_slope(path).collect()}
    assert got[1] == pytest.approx(11 / 111.19, rel=1e-3) and got[2] == 0 and got[3] == 0


def test_alternatives_count_stairs(spark):
    g = [(0, 1, 2, 1.0), (1, 2, 3, 1.0), (2, 1, 3, 3.0)]
    out = alternatives(spark.createDataFrame([(1, 1, 3)], "req_id long, src long, dst long"), arcs_of(spark, g), spark.createDataFrame([(1,)], "edge_id long"), 3).collect()
    assert sorted((r.cand_id, r.distance, r.stairs) for r in out) == [(1, 2.0, 1), (2, 3.0, 0)]


def test_streamed_requests(spark, tmp_path):
    from kerbline.streaming.directions import serve

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"req_id": 1, "start": "40.9002,-73.12", "end": "40.9,-73.1171"}\n{"req_id": 2, "start": "x", "end": "y"}\n')
    q = serve(spark, str(tmp_path / "in"), square(spark), spark.createDataFrame([], "lat long, lon long"), str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination(120)
    assert {(r.req_id, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(1, 200), (2, 400)}


def test_alternatives_of_points_to_the_best_route(spark, tmp_path):
    from kerbline.jobs.best_route import best_routes
    from kerbline.jobs.directions import alternatives as ways_of

    e = square(spark)
    stairs = spark.createDataFrame([(40_901_000_000, -73_119_000_000)], "lat long, lon long")
    requests = spark.createDataFrame([(1, "40.9002,-73.12", "40.9,-73.1171"), (2, "x", "1,2"), (3, "40.9002,-73.12", "40.9008,-73.12")], "req_id long, start string, end string")
    found = ways_of(requests, e, stairs, 3)
    rows = {(r.req_id, r["rank"]): r for r in found.collect()}
    assert sorted(rows) == [(1, 1), (1, 2), (3, 1), (3, 2)]
    assert rows[1, 1].total_distance < rows[1, 2].total_distance and (rows[1, 1].stairs, rows[1, 2].stairs) == (0, 2)
    assert rows[3, 1].total_distance == pytest.approx(66.7, abs=0.2)
    io.write_routes(found, f"{tmp_path}/routes")
    back = {(r.req_id, r["rank"]): r.encoded_polyline for r in spark.read.json(f"{tmp_path}/routes").collect()}
    assert back == {k: r.encoded_polyline for k, r in rows.items()} and all(back.values())
    training = [(1200.0, 0.02, 0.0, 20.0), (1500.0, 0.05, 1.0, 40.0), (1000.0, 0.01, 0.0, 15.0), (2000.0, 0.03, 0.0, 30.0), (1800.0, 0.04, 2.0, 45.0)]
    model = scoring.train(spark.createDataFrame(training, "distance double, avg_slope double, stairs double, cost double"))
    heights = spark.createDataFrame([(1, 5.0), (2, 5.0), (3, 5.0), (4, 5.0)], "id long, elevation double")
    best = {r.req_id: r for r in best_routes(requests, e, stairs, heights, model, 2).collect()}
    assert {i: r.cand_id for i, r in best.items()} == {1: 1, 3: 1} and best[1].encoded_polyline == rows[1, 1].encoded_polyline and best[1].avg_slope == 0


def test_long_ways_walk_back_and_bounds(spark):
    g = [(i, i, i + 1, 1.0) for i in range(9)]
    out = routing.shortest_paths(spark.createDataFrame([(1, 0, 9, None), (2, 0, 9, 8.5), (3, 9, 3, 6.0)], "req_id long, src long, dst long, most double"), arcs_of(spark, g)).collect()
    assert {r.req_id: r.nodes for r in out} == {1: list(range(10)), 3: list(range(9, 2, -1))}
