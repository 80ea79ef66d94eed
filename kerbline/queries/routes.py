"""Stairs, snapping, search, polylines, walkways and scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geo, polyline
from ..jobs import best_route, directions
from ..jobs import walkways as walkway_job
from ..operators import alternatives, edges, routing, scoring, snap, stairs, walkways
from ..sources.fixtures import ctes, load
from .sqltext import DENSE_EDGES, POLYGON_DEGREES, hav, hav_asin

QUERIES, ORACLES = {}, {}
#: Metres; at this distance some edges touch stairs without sharing a vertex with them.
FAR_STAIRS_M = 25.0


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def dense_edges(spark, sf):
    return edges.segment_edges(load(spark, sf, "dense_vertices"))


NEAR = f"""touching AS (SELECT DISTINCT edge_id FROM (SELECT edge_id, u_lat AS lat, u_lon AS lon FROM dense_edges UNION ALL SELECT edge_id, v_lat, v_lon FROM dense_edges) e
    JOIN (SELECT DISTINCT lat AS s_lat, lon AS s_lon FROM stairs) s ON s_lat BETWEEN lat - {{nano}} AND lat + {{nano}} AND {hav("lat / 1e9", "lon / 1e9", "s_lat / 1e9", "s_lon / 1e9")} <= {{metres}})"""


def near(metres: float) -> str:
    return NEAR.format(metres=metres, nano=int(metres / 111_000 * 1e9) + 100)


@query("J3_edge_stairs", f"{ctes('dense_vertices', 'stairs')}, {DENSE_EDGES}, {near(FAR_STAIRS_M)} SELECT edge_id FROM touching")
def edge_stairs(spark, sf):
    return stairs.near_stairs(stairs.edge_vertices(dense_edges(spark, sf)), load(spark, sf, "stairs"), FAR_STAIRS_M)


@query("A10_penalty", f"{ctes('dense_vertices', 'stairs')}, {DENSE_EDGES}, {near(0.001)} SELECT edge_id, CASE WHEN t.edge_id IS NULL THEN 0.0::DOUBLE ELSE 1e6::DOUBLE END AS penalty FROM dense_edges e LEFT JOIN touching t USING (edge_id)")
def penalty(spark, sf):
    return stairs.with_penalty(dense_edges(spark, sf), load(spark, sf, "stairs")).select("edge_id", "penalty")


PROJECT = """proj AS (SELECT req_id, edge_id, lat, lon, a_lat / 1e9 AS a_lat, a_lon / 1e9 AS a_lon, b_lat / 1e9 AS b_lat, b_lon / 1e9 AS b_lon, cos(radians(lat)) AS k FROM points, segments),
share AS (SELECT *, greatest(0.0, least(1.0, coalesce(((lon * k - a_lon * k) * (b_lon * k - a_lon * k) + (lat - a_lat) * (b_lat - a_lat))
    / nullif((b_lon * k - a_lon * k) * (b_lon * k - a_lon * k) + (b_lat - a_lat) * (b_lat - a_lat), 0.0), 0.0))) AS t FROM proj),
snapped AS (SELECT req_id, edge_id, t, lat, lon, a_lat + t * (b_lat - a_lat) AS q_lat, (a_lon * k + t * (b_lon * k - a_lon * k)) / k AS q_lon FROM share)"""
SNAP = f"{ctes('points', 'segments')}, {PROJECT}, best AS (SELECT req_id, min({{edge_id: d, e: edge_id, t: t, q_lat: q_lat, q_lon: q_lon}}) AS m FROM (SELECT *, {hav('lat', 'lon', 'q_lat', 'q_lon')} AS d FROM snapped) GROUP BY req_id)".replace("edge_id: d", "d: d")


def snaps(spark, sf):
    return snap.nearest(load(spark, sf, "points"), load(spark, sf, "segments").withColumn("seg", F.lit(0)))


@query("J4_snap", f"{SNAP} SELECT req_id, round(m.d, 3) AS distance, round(m.t, 6) AS t FROM best")
def nearest(spark, sf):
    return snaps(spark, sf).select("req_id", F.round("distance", 3).alias("distance"), F.round("t", 6).alias("t"))


@query("M3_project", f"{ctes('points', 'segments')}, {PROJECT} SELECT req_id, round(q_lat, 7) AS q_lat, round(q_lon, 7) AS q_lon, round(t, 6) AS t FROM snapped WHERE edge_id = req_id")
def project(spark, sf):
    pairs = load(spark, sf, "points").join(load(spark, sf, "segments"), F.col("req_id") == F.col("edge_id"))
    q_lat, q_lon, t = geo.project(F.col("lat"), F.col("lon"), F.col("a_lat") / 1e9, F.col("a_lon") / 1e9, F.col("b_lat") / 1e9, F.col("b_lon") / 1e9)
    return pairs.select("req_id", F.round(q_lat, 7).alias("q_lat"), F.round(q_lon, 7).alias("q_lon"), F.round(t, 6).alias("t"))


@query("U2_split_edges", f"""{SNAP}, cut AS (SELECT req_id, s.*, CAST(round_even(m.q_lat * 1e9, 0) AS BIGINT) AS q_lat, CAST(round_even(m.q_lon * 1e9, 0) AS BIGINT) AS q_lon FROM best JOIN segments s ON s.edge_id = m.e)
    SELECT req_id, 0 AS piece, round({hav('a_lat / 1e9', 'a_lon / 1e9', 'q_lat / 1e9', 'q_lon / 1e9')}, 2) AS distance FROM cut
    UNION ALL SELECT req_id, 1, round({hav('q_lat / 1e9', 'q_lon / 1e9', 'b_lat / 1e9', 'b_lon / 1e9')}, 2) FROM cut""")
def split_edges(spark, sf):
    vertex = lambda i, a: F.struct(F.lit(i).cast("long").alias("id"), F.col(f"{a}_lat").alias("lat"), F.col(f"{a}_lon").alias("lon"))
    lines = load(spark, sf, "segments").select("edge_id", F.lit(0).alias("u"), F.lit(1).alias("v"), F.array(vertex(0, "a"), vertex(1, "b")).alias("polyline"))
    pieces = snap.split_edges(snaps(spark, sf).withColumn("node_id", F.lit(2).cast("long")), lines)
    return pieces.select("req_id", "piece", F.round("distance", 2).alias("distance"))


@query("W4_new_ids", f"{ctes('points', 'dense_nodes')} SELECT req_id, (SELECT max(id) FROM dense_nodes) + row_number() OVER (ORDER BY req_id) AS node_id FROM points")
def new_ids(spark, sf):
    return snap.new_ids(load(spark, sf, "dense_nodes"), load(spark, sf, "points")).select("req_id", "node_id")


def search(weights: str, requests: str = "requests") -> str:
    """Costs no way beyond that along the request's own way."""
    return f"""{ctes('dense_vertices', 'stairs', requests)}, {DENSE_EDGES}, {near(0.001)},
    weighed AS (SELECT e.*, {weights} AS w FROM dense_edges e LEFT JOIN touching t USING (edge_id)),
    arcs AS (SELECT u AS src, v AS dst, w FROM weighed UNION ALL SELECT v, u, w FROM weighed),
    reqs AS (SELECT req_id, src, dst, coalesce((SELECT sum(w) FROM weighed e WHERE e.way_id = r.req_id), 0) + 0.001 AS most FROM {requests} r),
    reach(req_id, node, cost, most) USING KEY (req_id, node) AS (SELECT req_id, src, 0.0::DOUBLE, most::DOUBLE FROM reqs UNION
        SELECT f.req_id, a.dst, min(f.cost + a.w), min(f.most) FROM reach f JOIN arcs a ON a.src = f.node LEFT JOIN recurring.reach r ON r.req_id = f.req_id AND r.node = a.dst
        WHERE f.cost + a.w <= f.most AND (r.cost IS NULL OR f.cost + a.w < r.cost) GROUP BY f.req_id, a.dst)
    SELECT q.req_id, round(cost, 3) AS cost FROM reqs q JOIN reach r ON r.req_id = q.req_id AND r.node = q.dst"""


def placed_arcs(spark, sf, penalised: bool):
    """Arcs of the dense graph with the places of their ends."""
    graph = stairs.with_penalty(dense_edges(spark, sf), load(spark, sf, "stairs")) if penalised else dense_edges(spark, sf).withColumn("penalty", F.lit(0.0))
    return directions.both_arcs(graph, F.col("distance") + F.col("penalty"))


def placed_requests(spark, sf, name: str = "requests"):
    nodes = load(spark, sf, "dense_nodes")
    place = lambda node, of: nodes.select(F.col("id").alias(node), (F.col("lat") / 1e9).alias(f"{of}_lat"), (F.col("lon") / 1e9).alias(f"{of}_lon"))
    return load(spark, sf, name).join(place("src", "src"), "src").join(place("dst", "goal"), "dst")


@query("G2_step_free_paths", search("d + CASE WHEN t.edge_id IS NULL THEN 0.0 ELSE 1e6 END"))
def step_free_paths(spark, sf):
    return routing.shortest_paths(placed_requests(spark, sf), placed_arcs(spark, sf, True)).select("req_id", F.round("cost", 3).alias("cost"))


@query("G2_shortest_paths", search("d"))
def shortest_paths(spark, sf):
    return routing.shortest_paths(placed_requests(spark, sf), placed_arcs(spark, sf, False)).select("req_id", F.round("cost", 3).alias("cost"))


@query("K1_k_shortest")
def k_shortest(spark, sf):
    found = alternatives.k_shortest_paths(placed_requests(spark, sf), placed_arcs(spark, sf, False), 5)
    return found.select("req_id", "rank", F.round("cost", 3).alias("cost"), F.size("edge_ids").alias("n_edges"))


@query("U3_distinct_candidates", f"{ctes('dense_refs')} SELECT DISTINCT way_id AS req_id, node_id % 3 AS a, node_id % 5 AS b FROM dense_refs")
def distinct_candidates(spark, sf):
    rows = load(spark, sf, "dense_refs").select(F.col("way_id").alias("req_id"), F.array(F.col("node_id") % 3).alias("nodes"), F.array(F.col("node_id") % 5).alias("edge_ids"))
    return routing.distinct_candidates(rows).select("req_id", F.get("nodes", F.lit(0)).alias("a"), F.get("edge_ids", F.lit(0)).alias("b"))


SEGMENT_COLUMNS = [f"{a} / 1e9" for a in ("a_lat", "a_lon", "b_lat", "b_lon")]


@query("M1_haversine", f"{ctes('segments')} SELECT edge_id, round({hav(*SEGMENT_COLUMNS)}, 3) AS metres FROM segments")
def haversine(spark, sf):
    return load(spark, sf, "segments").select("edge_id", F.round(geo.nano_distance(F.col("a_lat"), F.col("a_lon"), F.col("b_lat"), F.col("b_lon")), 3).alias("metres"))


@query("M2_haversine_asin", f"{ctes('segments')} SELECT edge_id, round({hav_asin(*SEGMENT_COLUMNS)}, 3) AS metres FROM segments")
def haversine_asin(spark, sf):
    return load(spark, sf, "segments").select("edge_id", F.round(geo.haversine_asin(*[F.col(c) / 1e9 for c in ("a_lat", "a_lon", "b_lat", "b_lon")]), 3).alias("metres"))


def lines(spark, sf):
    point = lambda a: F.struct((F.col(f"{a}_lat") / 1e9).alias("lat"), (F.col(f"{a}_lon") / 1e9).alias("lon"))
    return load(spark, sf, "segments").select(F.col("edge_id").alias("line_id"), F.array(point("a"), point("b")).alias("pts"))


DENSIFIED = f"""seg AS (SELECT edge_id AS line_id, a_lat / 1e9 AS a_lat, a_lon / 1e9 AS a_lon, b_lat / 1e9 AS b_lat, b_lon / 1e9 AS b_lon, {hav_asin(*SEGMENT_COLUMNS)} AS d FROM segments),
dense AS (SELECT line_id, 0 AS j, a_lat AS lat, a_lon AS lon FROM seg UNION ALL SELECT line_id, 1, b_lat, b_lon FROM seg WHERE d <= 2.0
    UNION ALL SELECT line_id, j, a_lat + (b_lat - a_lat) * (j * 2.0::DOUBLE / d), a_lon + (b_lon - a_lon) * (j * 2.0::DOUBLE / d) FROM seg, unnest(range(1, CAST(floor(d / 2.0) AS BIGINT) + 1)) t(j) WHERE d > 2.0)"""


@query("M4_densify", f"{ctes('segments')}, {DENSIFIED} SELECT line_id, count(*) AS n_points, round(sum(lat), 5) AS lat, round(sum(lon), 5) AS lon FROM dense GROUP BY line_id")
def densify(spark, sf):
    dense = lines(spark, sf).select("line_id", F.explode(walkways.densify(F.col("pts"))).alias("p"))
    return dense.groupBy("line_id").agg(F.count("*").alias("n_points"), F.round(F.sum("p.lat"), 5).alias("lat"), F.round(F.sum("p.lon"), 5).alias("lon"))


GRAPH = f"""{ctes('segments')}, {DENSIFIED}, pts AS (SELECT line_id, j, round(lat, 7) AS lat, round(lon, 7) AS lon FROM dense),
pairs AS (SELECT * FROM (SELECT lat, lon, lead(lat) OVER w AS lat2, lead(lon) OVER w AS lon2 FROM pts WINDOW w AS (PARTITION BY line_id ORDER BY j)) WHERE lat2 IS NOT NULL),
once AS (SELECT DISTINCT least((lat, lon), (lat2, lon2)) AS a, greatest((lat, lon), (lat2, lon2)) AS b FROM pairs)"""


@query("A8_dense_counts", f"{GRAPH} SELECT (SELECT count(*) FROM (SELECT DISTINCT lat, lon FROM pts)) AS n_nodes, (SELECT count(*) FROM once) AS n_edges")
def dense_counts(spark, sf):
    nodes, links = walkways.dense_graph(lines(spark, sf), digits=7)
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(links.agg(F.count("*").alias("n_edges")))  # one row each


@query("G4_dense_graph", f"{GRAPH} SELECT cell, count(*) AS n, round(sum(w), 2) AS metres FROM (SELECT CAST(floor(a[1] * 1000) AS BIGINT) AS cell, {hav_asin('a[1]', 'a[2]', 'b[1]', 'b[2]')} AS w FROM (SELECT [a[1], a[2]] AS a, [b[1], b[2]] AS b FROM once)) GROUP BY 1")
def dense_graph(spark, sf):
    _, links = walkways.dense_graph(lines(spark, sf), digits=7)
    return links.groupBy(F.floor(F.col("a.lat") * 1000).alias("cell")).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 2).alias("metres"))


CLIP = f"""{ctes('segments')}, {POLYGON_DEGREES}, seg AS (SELECT edge_id AS line_id, a_lat / 1e9 AS y0, a_lon / 1e9 AS x0, b_lat / 1e9 AS y1, b_lon / 1e9 AS x1 FROM segments),
hit AS (SELECT line_id, ((a_lon - x0) * (b_lat - a_lat) - (a_lat - y0) * (b_lon - a_lon)) / nullif((x1 - x0) * (b_lat - a_lat) - (y1 - y0) * (b_lon - a_lon), 0.0) AS t,
    ((a_lon - x0) * (y1 - y0) - (a_lat - y0) * (x1 - x0)) / nullif((x1 - x0) * (b_lat - a_lat) - (y1 - y0) * (b_lon - a_lon), 0.0) AS s FROM seg, polyd),
ts AS (SELECT line_id, t FROM hit WHERE t > 0 AND t < 1 AND s BETWEEN 0 AND 1 UNION SELECT line_id, 0.0 FROM seg UNION SELECT line_id, 1.0 FROM seg),
part AS (SELECT line_id, t AS t0, lead(t) OVER (PARTITION BY line_id ORDER BY t) AS t1 FROM ts),
geo AS (SELECT p.line_id, t0, t1, y0 + t0 * (y1 - y0) AS ay, x0 + t0 * (x1 - x0) AS ax, y0 + t1 * (y1 - y0) AS cy, x0 + t1 * (x1 - x0) AS cx, y0 + (t0 + t1) / 2 * (y1 - y0) AS my, x0 + (t0 + t1) / 2 * (x1 - x0) AS mx FROM part p JOIN seg USING (line_id) WHERE t1 IS NOT NULL),
odd AS (SELECT g.line_id, g.t0, sum(CASE WHEN ((a_lat > my) <> (b_lat > my)) AND mx < (my - a_lat) * ((b_lon - a_lon) / nullif(b_lat - a_lat, 0.0)) + a_lon THEN 1 ELSE 0 END) % 2 AS n FROM geo g, polyd GROUP BY g.line_id, g.t0)
SELECT line_id, round(sum({hav('ay', 'ax', 'cy', 'cx')}), 2) AS metres FROM geo JOIN odd USING (line_id, t0) WHERE n = 1 GROUP BY line_id"""


@query("J5_clip", CLIP)
def clip(spark, sf):
    pieces = walkways.clip(lines(spark, sf))
    return pieces.groupBy("line_id").agg(F.round(F.sum(polyline.length_m(F.col("pts"))), 2).alias("metres"))


def way_points(spark, sf):
    v = load(spark, sf, "dense_vertices").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", (F.col("lat") / 1e9).alias("lat"), (F.col("lon") / 1e9).alias("lon")))).alias("s"))
    return v.select("way_id", F.transform("s", lambda x: F.struct(x["lat"], x["lon"])).alias("pts"))


ENCODE = f"""{ctes('dense_vertices')}, steps AS (SELECT way_id, pos, unnest([1, 2]) AS k, unnest([CAST(round_even((lat / 1e9 - coalesce(lag(lat / 1e9) OVER w, 0.0)) * 1e5, 0) AS BIGINT), CAST(round_even((lon / 1e9 - coalesce(lag(lon / 1e9) OVER w, 0.0)) * 1e5, 0) AS BIGINT)]) AS v
    FROM dense_vertices WINDOW w AS (PARTITION BY way_id ORDER BY pos)), shifted AS (SELECT way_id, pos, k, CASE WHEN v < 0 THEN -v * 2 - 1 ELSE v * 2 END AS n, v FROM steps)"""


@query("M6_encode", f"{ENCODE}, chunks AS (SELECT way_id, pos, k, i, chr(CAST(63 + (n >> (5 * i)) % 32 + CASE WHEN n >> (5 * (i + 1)) > 0 THEN 32 ELSE 0 END AS INT)) AS ch FROM shifted, unnest(range(0, 7)) t(i) WHERE i = 0 OR n >> (5 * i) > 0) SELECT way_id, string_agg(ch, '' ORDER BY pos, k, i) AS encoded FROM chunks GROUP BY way_id")
def encode(spark, sf):
    return way_points(spark, sf).select("way_id", polyline.encode(F.col("pts")).alias("encoded"))


@query("M7_decode", f"{ENCODE} SELECT way_id, pos, round(sum(v) FILTER (k = 1) OVER w / 1e5, 5) AS lat, round(sum(v) FILTER (k = 2) OVER w / 1e5, 5) AS lon FROM shifted WINDOW w AS (PARTITION BY way_id ORDER BY pos, k ROWS UNBOUNDED PRECEDING) QUALIFY k = 2")
def decode(spark, sf):
    decoded = polyline.decode(way_points(spark, sf).select("way_id", polyline.encode(F.col("pts")).alias("text")), ["way_id"], "text")
    return decoded.select("way_id", F.col("pos").cast("long").alias("pos"), F.round("lat", 5).alias("lat"), F.round("lon", 5).alias("lon"))


@query("M5_combine", f"{ctes('dense_refs')} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS line FROM dense_refs GROUP BY way_id HAVING count(*) > 1")
def combine(spark, sf):
    pairs = dense_edges(spark, sf).groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("seq", "polyline"))), lambda x: x["polyline"]).alias("lines"))
    return pairs.select("way_id", F.array_join(F.transform(polyline.combine(F.col("lines")), lambda p: p["id"]), ",").alias("line"))


@query("M12_reverse", f"{ctes('dense_refs')} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos DESC) AS line FROM dense_refs GROUP BY way_id")
def reverse(spark, sf):
    rows = load(spark, sf, "dense_refs").groupBy("way_id").agg(F.sort_array(F.collect_list(F.struct("pos", "node_id"))).alias("s"))
    return rows.select("way_id", F.array_join(F.reverse(F.transform("s", lambda x: x["node_id"])), ",").alias("line"))


BAD_TEXTS = ("north", "40.9", "nan,1", "1e30,5", "95,10", "Infinity,3", "12,180.5", "1,2,3", ",", "4,-inf")
TEXTS = f"CASE WHEN c_custkey % 20 < 10 THEN element_at(array({', '.join(repr(t) for t in BAD_TEXTS)}), CAST(c_custkey % 20 + 1 AS INT)) ELSE '40.' || (900 + c_custkey % 90) || ', -73.' || (100 + c_custkey % 30) END"


@query("M9_parse_point", "SELECT c_custkey AS req_id, CASE WHEN c_custkey % 20 < 10 THEN 400 ELSE 200 END AS status, CASE WHEN c_custkey % 20 >= 10 THEN CAST('40.' || (900 + c_custkey % 90) AS DOUBLE) END AS lat, CASE WHEN c_custkey % 20 >= 10 THEN CAST('-73.' || (100 + c_custkey % 30) AS DOUBLE) END AS lon FROM customer")
def parse_point(spark, sf):
    rows = load(spark, sf, "customer").selectExpr("c_custkey AS req_id", f"{TEXTS} AS text")
    lat, lon = directions.parse_point(F.col("text"))
    return rows.select("req_id", F.when(lat.isNull() | lon.isNull(), 400).otherwise(200).alias("status"), lat.alias("lat"), lon.alias("lon"))


@query("M10_response", "SELECT c_custkey AS req_id, 'pts' || c_custkey AS points, CAST(c_custkey * 1.5 AS DOUBLE) AS value, 'o' || c_custkey AS origin FROM customer")
def response(spark, sf):
    c = F.col("c_custkey")
    body = directions.response(F.concat(F.lit("pts"), c), c * F.lit(1.5), F.concat(F.lit("o"), c), F.concat(F.lit("d"), c))
    rows = load(spark, sf, "customer").select(c.alias("req_id"), body.alias("body"))
    at = lambda path: F.get_json_object("body", path)
    return rows.select("req_id", at("$.routes[0].overview_polyline.points").alias("points"), at("$.routes[0].legs[0].distance.value").cast("double").alias("value"), at("$.request.origin").alias("origin"))


@query("M11_steps", "SELECT user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS step, value AS distance, 'p' || event_id AS points FROM events")
def steps(spark, sf):
    step = F.struct(F.struct(F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng")).alias("start_location"), F.struct(F.col("value")).alias("distance"), F.struct(F.col("value")).alias("duration"), F.struct(F.concat(F.lit("p"), F.col("event_id")).alias("points")).alias("polyline"))
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("ts", "event_id", step.alias("s")))), lambda x: x["s"])
    documents = load(spark, sf, "events").groupBy("user_id").agg(ordered.alias("steps"))
    documents = documents.select("user_id", F.to_json(F.struct(F.array(F.struct(F.array(F.struct("steps")).alias("legs"))).alias("routes"))).alias("body"))
    return directions.steps(documents).select("user_id", "step", "distance", "points")


ELEVATED = f"""{ctes('dense_vertices', 'elevations')}, path AS (SELECT way_id AS route_id, pos, lat / 1e9 AS lat, lon / 1e9 AS lon, elevation FROM dense_vertices v LEFT JOIN elevations e ON e.id = v.node_id),
legs AS (SELECT route_id, elevation, {hav('lat', 'lon', 'lead(lat) OVER w', 'lead(lon) OVER w')} AS d, lead(elevation) OVER w - elevation AS rise FROM path WINDOW w AS (PARTITION BY route_id ORDER BY pos)),
slope AS (SELECT route_id, CASE WHEN bool_or(elevation IS NULL) THEN 0.0 ELSE coalesce(avg(CASE WHEN d > 0 THEN rise / d END), 0.0) END AS avg_slope FROM legs GROUP BY route_id)"""


def path(spark, sf):
    return load(spark, sf, "dense_vertices").select(F.col("way_id").alias("route_id"), "pos", "node_id", (F.col("lat") / 1e9).alias("lat"), (F.col("lon") / 1e9).alias("lon"))


@query("J7_elevations", f"{ELEVATED} SELECT route_id, pos, elevation FROM path")
def elevations(spark, sf):
    return scoring.with_elevation(path(spark, sf), load(spark, sf, "elevations")).select("route_id", "pos", "elevation")


@query("A9_average_slope", f"{ELEVATED} SELECT route_id, round(avg_slope, 7) AS avg_slope FROM slope")
def average_slope(spark, sf):
    return scoring.average_slope(scoring.with_elevation(path(spark, sf), load(spark, sf, "elevations"))).select("route_id", F.round("avg_slope", 7).alias("avg_slope"))


@query("L1_features", f"{ELEVATED} SELECT o_orderkey AS route_id, o_totalprice AS distance, round(coalesce(avg_slope, 0.0), 7) AS avg_slope, CAST(CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey % 3 END AS DOUBLE) AS stairs FROM orders LEFT JOIN slope ON route_id = o_orderkey")
def features(spark, sf):
    routes = load(spark, sf, "orders").select(F.col("o_orderkey").alias("route_id"), F.col("o_totalprice").alias("distance"), F.nullif(F.col("o_orderkey") % 3, F.lit(0)).alias("stairs"))
    found = scoring.features(routes, path(spark, sf), load(spark, sf, "elevations"))
    return found.select("route_id", "distance", F.round("avg_slope", 7).alias("avg_slope"), "stairs")


# least squares with three features by Cramer's rule on covariances
M = [[f"covar_pop({a}, {b})" for b in ("distance", "avg_slope", "stairs")] for a in ("distance", "avg_slope", "stairs")]
Y = [f"covar_pop({a}, cost)" for a in ("distance", "avg_slope", "stairs")]


def det(m: list[list[str]]) -> str:
    a, b, c = m
    return f"({a[0]} * ({b[1]} * {c[2]} - {b[2]} * {c[1]}) - {a[1]} * ({b[0]} * {c[2]} - {b[2]} * {c[0]}) + {a[2]} * ({b[0]} * {c[1]} - {b[1]} * {c[0]}))"


N = [[f"m{i}{j}" for j in range(3)] for i in range(3)]
REPLACED = [[[f"y{i}" if j == k else N[i][j] for j in range(3)] for i in range(3)] for k in range(3)]
OLS = f"""{ctes('candidates')}, sums AS (SELECT {', '.join(f'{M[i][j]} AS m{i}{j}' for i in range(3) for j in range(3))}, {', '.join(f'{Y[i]} AS y{i}' for i in range(3))}, avg(distance) AS ad, avg(avg_slope) AS aa, avg(stairs) AS ast, avg(cost) AS ac FROM candidates),
model AS (SELECT {', '.join(f'{det(REPLACED[k])} / {det(N)} AS w{k}' for k in range(3))}, ad, aa, ast, ac FROM sums),
scored AS (SELECT req_id, cand_id, ac + w0 * (distance - ad) + w1 * (avg_slope - aa) + w2 * (stairs - ast) AS prediction FROM candidates, model)"""


def model(spark, sf):
    return scoring.train(load(spark, sf, "candidates"))


@query("L2_train", f"{OLS} SELECT round(w0, 5) AS distance, round(w1, 3) AS avg_slope, round(w2, 4) AS stairs FROM model")
def train(spark, sf):
    fitted = model(spark, sf)
    raw = [w / s for w, s in zip(fitted.stages[2].coefficients, fitted.stages[1].std, strict=True)]
    return load(spark, sf, "candidates").limit(1).select(F.round(F.lit(float(raw[0])), 5).alias("distance"), F.round(F.lit(float(raw[1])), 3).alias("avg_slope"), F.round(F.lit(float(raw[2])), 4).alias("stairs"))


@query("L3_predict", f"{OLS} SELECT req_id, cand_id, round(prediction, 3) AS prediction FROM scored")
def predict(spark, sf):
    found = scoring.predict(model(spark, sf), load(spark, sf, "candidates"))
    return found.select("req_id", F.col("cand_id").cast("long").alias("cand_id"), F.round("prediction", 3).alias("prediction"))


@query("L4_select_best", f"{OLS} SELECT req_id, cand_id, round(prediction, 3) AS prediction FROM scored QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY prediction, cand_id) = 1")
def select_best(spark, sf):
    found = scoring.best(scoring.predict(model(spark, sf), load(spark, sf, "candidates")))
    return found.select("req_id", F.col("cand_id").cast("long").alias("cand_id"), F.round("prediction", 3).alias("prediction"))


@query("K2_best_candidate", f"{ctes('candidates')} SELECT req_id, cand_id FROM candidates QUALIFY row_number() OVER (PARTITION BY req_id ORDER BY cost, cand_id) = 1")
def best_candidate(spark, sf):
    found = scoring.best(load(spark, sf, "candidates").withColumnRenamed("cost", "prediction"))
    return found.select("req_id", F.col("cand_id").cast("long").alias("cand_id"))


@query("W5_first_minimum", f"{ctes('candidates')} SELECT req_id, min(cost) AS cost FROM candidates GROUP BY req_id")
def first_minimum(spark, sf):
    return scoring.best(load(spark, sf, "candidates").withColumnRenamed("cost", "prediction")).select("req_id", F.col("prediction").alias("cost"))


def text_requests(spark, sf):
    """Points some metres from the ends of the requests, as text."""
    text = F.concat_ws(",", F.col("lat") / 1e9 + 0.0001, F.col("lon") / 1e9)
    nodes = load(spark, sf, "dense_nodes")
    a, b = nodes.select(F.col("id").alias("src"), text.alias("start")), nodes.select(F.col("id").alias("dst"), text.alias("end"))
    return load(spark, sf, "requests").join(a, "src", "left").join(b, "dst", "left").select("req_id", "start", "end")


@query("G5_directions")
def batch_directions(spark, sf):
    out = directions.directions(text_requests(spark, sf), dense_edges(spark, sf), load(spark, sf, "stairs"))
    return out.select("req_id", "status", "error", F.round("cost", 3).alias("cost"), F.round("length_m", 3).alias("length_m"), "body")


@query("WC_best_routes")
def best_routes(spark, sf):
    """Requests to their best of five alternatives, by a model that candidates trained."""
    found = best_route.best_routes(text_requests(spark, sf), dense_edges(spark, sf), load(spark, sf, "stairs"), load(spark, sf, "elevations"), model(spark, sf))
    return found.select("req_id", "cand_id", F.round("distance", 3).alias("distance"), "stairs", F.round("prediction", 3).alias("prediction"), "encoded_polyline")


@query("WD_walkway_graph")
def walkway_graph(spark, sf):
    """Nodes and edges of the walkways' graph, by rows of cells some hundred metres high."""
    nodes, links = walkway_job.walkway_graph(lines(spark, sf), digits=7)
    cell = lambda lat: F.floor(lat * 1000).alias("cell")
    ends = nodes.groupBy(cell(F.col("lat"))).agg(F.count("*").alias("n_nodes"))
    ways = links.groupBy(cell(F.col("a.lat"))).agg(F.count("*").alias("n_edges"), F.round(F.sum("weight"), 1).alias("metres"))
    return ends.join(ways, "cell", "full").select("cell", F.coalesce("n_nodes", F.lit(0)).alias("n_nodes"), F.coalesce("n_edges", F.lit(0)).alias("n_edges"), F.coalesce("metres", F.lit(0.0)).alias("metres"))
