"""Extract, filters, lookups and edges."""

from __future__ import annotations

import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import geo, polyline
from ..operators import edges, ways
from ..sources import io
from ..sources.fixtures import ctes, load
from ..sources.shared import shared_path
from .sqltext import DENSE_EDGES, POLYGON, WALKABLE, inside, split

QUERIES, ORACLES = {}, {}
BOX = (40900000000, -73130000000, 40910000000, -73115000000)


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


@query("W1_split_ways", f"{ctes('vertices')}, {split('vertices')} SELECT way_id, CAST(seq AS INT) AS seq, arg_min(a, pos) AS u, arg_max(b, pos) AS v, count(*) + 1 AS n_vertices, round(sum(d), 3) AS distance FROM legs GROUP BY way_id, seq")
def split_ways(spark, sf):
    cut = edges.split_at_junctions(load(spark, sf, "vertices"))
    return cut.select("way_id", "seq", "u", "v", F.size("polyline").cast("long").alias("n_vertices"), F.round("distance", 3).alias("distance"))


@query("A1_ref_counts", f"{ctes('way_refs')} SELECT node_id, count(*) AS n FROM way_refs GROUP BY node_id")
def ref_counts(spark, sf):
    return ways.ref_counts(load(spark, sf, "way_refs"))


@query("A2_edge_lengths", f"{ctes('vertices')}, {split('vertices')} SELECT way_id, CAST(seq AS INT) AS seq, round(sum(d), 3) AS by_array FROM legs GROUP BY way_id, seq")
def edge_lengths(spark, sf):
    cut = edges.split_at_junctions(load(spark, sf, "vertices"))
    points = F.transform("polyline", lambda p: F.struct((p["lat"] / 1e9).alias("lat"), (p["lon"] / 1e9).alias("lon")))
    return cut.select("way_id", "seq", F.round(polyline.length_m(points), 3).alias("by_array"))


@query("A3_way_totals", f"{ctes('vertices')}, {split('vertices')} SELECT way_id, round(sum(d), 3) AS total_distance, count(DISTINCT seq) AS n_edges, arg_min(a, pos) AS first_node FROM legs GROUP BY way_id")
def way_totals(spark, sf):
    segments = edges.way_segments(edges.split_at_junctions(load(spark, sf, "vertices")))
    return segments.select("way_id", F.round("total_distance", 3).alias("total_distance"), F.size("edges").cast("long").alias("n_edges"), F.get("edges", F.lit(0))["u"].alias("first_node"))


@query("P1_in_polygon", f"{ctes('all_nodes')}, {POLYGON}, {inside('all_nodes')} SELECT id, inside FROM inside")
def in_polygon(spark, sf):
    return load(spark, sf, "all_nodes").select("id", geo.in_polygon(F.col("lat"), F.col("lon"), geo.nano_polygon()).alias("inside"))


#: Triangles around the segments' first ends, some of them large: as many polygons as parts.
TRIANGLES = """tri AS (SELECT edge_id AS polygon_id, a_lat AS y, a_lon AS x, CASE WHEN edge_id % 50 = 0 THEN 9000000 ELSE 300000 END AS r FROM segments),
corners AS (SELECT polygon_id, y - r AS a_lat, x - r AS a_lon, y - r // 3 AS b_lat, x + r AS b_lon FROM tri UNION ALL SELECT polygon_id, y - r // 3, x + r, y + r, x - r // 5 FROM tri UNION ALL SELECT polygon_id, y + r, x - r // 5, y - r, x - r FROM tri)"""


@query("P1_in_polygons", f"""{ctes('all_nodes', 'segments')}, {TRIANGLES}, box AS (SELECT *, y - r AS s, y + r AS n FROM tri),
    near AS (SELECT id, lat, lon, polygon_id FROM all_nodes JOIN box ON lat >= s AND lat <= n WHERE lon BETWEEN x - r AND x + r)
    SELECT id, polygon_id FROM near JOIN corners USING (polygon_id) GROUP BY id, polygon_id
    HAVING sum(CASE WHEN ((lat < a_lat) <> (lat < b_lat)) AND lon < (lat - a_lat) * (b_lon - a_lon) // nullif(b_lat - a_lat, 0) + a_lon THEN 1 ELSE 0 END) % 2 = 1""")
def in_polygons(spark, sf):
    segments = load(spark, sf, "segments")
    corners = spark.sql("WITH " + re.sub(r"(\w+) // (\d)", r"(\1 div \2)", TRIANGLES).replace("FROM segments", "FROM {segments}") + " SELECT * FROM corners", segments=segments)
    return ways.inside_polygons(load(spark, sf, "all_nodes"), corners)


@query("P2_walkable", f"{ctes('way_tags')}, {WALKABLE} SELECT way_id FROM walkable")
def walkable(spark, sf):
    return ways.walkable(load(spark, sf, "way_tags"))


@query("P3_stairs", f"{ctes('way_tags')} SELECT DISTINCT way_id FROM way_tags WHERE k = 'highway' AND v = 'steps'")
def stairs(spark, sf):
    return ways.stairs(load(spark, sf, "way_tags"))


@query("P4_in_box", f"{ctes('way_tags', 'way_refs', 'nodes')} SELECT DISTINCT r.way_id FROM way_refs r JOIN nodes n ON r.node_id = n.id JOIN way_tags t ON t.way_id = r.way_id AND k = 'highway' AND v = 'footway' WHERE lat BETWEEN {BOX[0]} AND {BOX[2]} AND lon BETWEEN {BOX[1]} AND {BOX[3]}")
def in_box(spark, sf):
    return ways.in_box(load(spark, sf, "way_tags"), load(spark, sf, "way_refs"), load(spark, sf, "nodes"), *BOX)


@query("P5_node_lookup", f"{ctes('nodes')} SELECT id, lat, lon FROM nodes WHERE id IN (SELECT c_custkey * 100 FROM customer)")
def node_lookup(spark, sf):
    return ways.lookup_nodes(load(spark, sf, "nodes"), load(spark, sf, "customer").select((F.col("c_custkey") * 100).alias("id")))


@query("P6_way_refs", f"{ctes('way_refs')} SELECT way_id, string_agg(CAST(node_id AS VARCHAR), ',' ORDER BY pos) AS refs FROM way_refs WHERE way_id IN (SELECT c_custkey FROM customer) GROUP BY way_id")
def refs_lookup(spark, sf):
    found = ways.lookup_refs(load(spark, sf, "way_refs"), load(spark, sf, "customer").select(F.col("c_custkey").alias("way_id")))
    return found.select("way_id", F.array_join("refs", ",").alias("refs"))


@query("P7_tag_lookup", f"{ctes('way_tags')} SELECT a.way_id, a.k, t.v FROM (SELECT c_custkey AS way_id, CASE WHEN c_custkey % 2 = 0 THEN 'surface' ELSE 'name' END AS k FROM customer) a LEFT JOIN way_tags t ON a.way_id = t.way_id AND a.k = t.k")
def tag_lookup(spark, sf):
    asked = load(spark, sf, "customer").select(F.col("c_custkey").alias("way_id"), F.when(F.col("c_custkey") % 2 == 0, "surface").otherwise("name").alias("k"))
    return ways.lookup_tags(load(spark, sf, "way_tags"), asked)


@query("P8_two_junctions", f"{ctes('way_refs')} SELECT r.way_id FROM way_refs r JOIN (SELECT node_id FROM way_refs GROUP BY 1 HAVING count(*) > 1) c ON r.node_id = c.node_id GROUP BY 1 HAVING count(*) >= 2")
def two_junctions(spark, sf):
    return edges.split_at_junctions(load(spark, sf, "vertices")).select("way_id").distinct()


@query("P9_adjacent", f"{ctes('way_refs')} SELECT DISTINCT way_id FROM way_refs WHERE node_id IN (SELECT node_id FROM way_refs GROUP BY 1 HAVING count(*) > 1)")
def adjacent(spark, sf):
    return ways.adjacent(load(spark, sf, "way_refs"))


@query("P11_degrees", f"{ctes('all_nodes')} SELECT id, lat / 1e9 AS lat_degrees, CAST(round_even(lon / 1e9 * 1e9, 0) AS BIGINT) AS lon FROM all_nodes")
def to_degrees(spark, sf):
    return load(spark, sf, "all_nodes").select("id", geo.degrees(F.col("lat")).alias("lat_degrees"), geo.nanodegrees(geo.degrees(F.col("lon"))).alias("lon"))


@query("P12_pbf_scaling", f"{ctes('all_nodes')} SELECT id, 500 + 100 * (lat // 100) AS lat, 100 * (lon // 100) AS lon FROM all_nodes")
def pbf_scaling(spark, sf):
    raw = load(spark, sf, "all_nodes").selectExpr("id", "lat div 100 AS lat", "lon div 100 AS lon")
    return raw.select("id", ways.pbf_coordinate(F.col("lat"), 100, 500).cast("long").alias("lat"), ways.pbf_coordinate(F.col("lon")).cast("long").alias("lon"))


@query("J1_resolve_refs", f"{ctes('way_refs', 'nodes')} SELECT way_id, string_agg(node_id || ':' || coalesce(lat, 0) || ':' || coalesce(lon, 0), ',' ORDER BY pos) AS refs FROM way_refs r LEFT JOIN nodes n ON r.node_id = n.id GROUP BY way_id")
def resolve(spark, sf):
    resolved = ways.resolved_ways(ways.resolve_refs(load(spark, sf, "way_refs"), load(spark, sf, "nodes")))
    return resolved.select("way_id", F.array_join(F.transform("refs", lambda v: F.concat_ws(":", v["id"], v["lat"], v["lon"])), ",").alias("refs"))


@query("J2_inside_polygon", f"{ctes('way_refs', 'nodes')}, {POLYGON}, {inside('nodes')} SELECT way_id FROM way_refs r LEFT JOIN inside i ON r.node_id = i.id GROUP BY way_id HAVING bool_and(coalesce(inside, false))")
def inside_polygon(spark, sf):
    return ways.inside_polygon(load(spark, sf, "way_refs"), load(spark, sf, "nodes"), geo.nano_polygon())


@query("J6_decode_tags", f"{ctes('way_tags')} SELECT way_id, k, v FROM way_tags")
def decode_tags(spark, sf):
    tags = load(spark, sf, "way_tags")
    long = tags.select((F.col("way_id") % 8).alias("blob_id"), "way_id", "k", "v")
    strings = long.select("blob_id", F.explode(F.array("k", "v")).alias("s")).distinct().withColumn("idx", F.row_number().over(W.partitionBy("blob_id").orderBy("s")) - 1)
    coded = long.join(strings.toDF("blob_id", "k", "key"), ["blob_id", "k"]).join(strings.toDF("blob_id", "v", "val"), ["blob_id", "v"]).select("blob_id", "way_id", "key", "val")
    return ways.decode_tags(coded, strings)


@query("A4_summary", f"{ctes('nodes', 'way_refs')} SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(DISTINCT way_id) FROM way_refs) AS n_ways")
def summary(spark, sf):
    return ways.summary(load(spark, sf, "nodes"), load(spark, sf, "way_refs"))


@query("A5_bounding_box", f"{ctes('nodes')} SELECT id % 10 AS tile, min(lat) AS min_lat, max(lat) AS max_lat, min(lon) AS min_lon, max(lon) AS max_lon FROM nodes GROUP BY 1")
def bounding_box(spark, sf):
    return ways.bounding_box(load(spark, sf, "nodes").withColumn("tile", F.col("id") % 10), ["tile"])


@query("A6_graph_nodes", f"{ctes('vertices')}, {split('vertices')} SELECT id, lat / 1e9 AS lat, lon / 1e9 AS lon FROM all_nodes WHERE id IN (SELECT arg_min(a, pos) FROM legs GROUP BY way_id, seq UNION SELECT arg_max(b, pos) FROM legs GROUP BY way_id, seq)")
def graph_nodes(spark, sf):
    return edges.graph_nodes(edges.split_at_junctions(load(spark, sf, "vertices")))


@query("A7_unique_vertices", f"{ctes('vertices')} SELECT node_id AS id, min(lat) AS lat, min(lon) AS lon FROM vertices GROUP BY node_id")
def unique_vertices(spark, sf):
    return ways.unique_vertices(load(spark, sf, "vertices"))


@query("W2_vertex_pairs", f"{ctes('dense_vertices')}, {DENSE_EDGES} SELECT edge_id, u, v, round(d, 3) AS distance FROM dense_edges")
def vertex_pairs(spark, sf):
    return edges.segment_edges(load(spark, sf, "dense_vertices")).select("edge_id", "u", "v", F.round("distance", 3).alias("distance"))


@query("W3_delta_decode", f"{ctes('way_refs')} SELECT way_id, pos, node_id FROM way_refs")
def delta_decode(spark, sf):
    refs = load(spark, sf, "way_refs")
    deltas = refs.withColumn("node_id", F.col("node_id") - F.coalesce(F.lag("node_id").over(W.partitionBy("way_id").orderBy("pos")), F.lit(0)))
    return ways.delta_decode(deltas, ["way_id"], "pos", ["node_id"])


@query("M8_zigzag", f"{ctes('way_refs')} SELECT way_id, pos, CASE WHEN node_id % 2 = 0 THEN node_id // 2 ELSE -((node_id + 1) // 2) END AS value FROM way_refs")
def zigzag(spark, sf):
    return load(spark, sf, "way_refs").select("way_id", "pos", polyline.zigzag_decode(F.col("node_id")).alias("value"))


@query("U1_arcs", f"{ctes('dense_vertices')}, {DENSE_EDGES} SELECT src, dst, count(*) AS n, round(sum(d), 3) AS weight, sum(first) AS first_ids FROM (SELECT u AS src, v AS dst, d, u AS first FROM dense_edges UNION ALL SELECT v, u, d, v FROM dense_edges) GROUP BY 1, 2")
def arcs(spark, sf):
    both = edges.arcs(edges.segment_edges(load(spark, sf, "dense_vertices")))
    return both.groupBy("src", "dst").agg(F.count("*").alias("n"), F.round(F.sum("weight"), 3).alias("weight"), F.sum(F.get("polyline", F.lit(0))["id"]).alias("first_ids"))


@query("P10_canonical_arcs", f"{ctes('dense_vertices')}, {DENSE_EDGES} SELECT edge_id, least(u, v) AS src, greatest(u, v) AS dst FROM dense_edges WHERE u <> v")
def canonical(spark, sf):
    return edges.canonical(edges.arcs(edges.segment_edges(load(spark, sf, "dense_vertices")))).select("edge_id", "src", "dst")


@query("G1_graph", f"{ctes('dense_vertices')}, {DENSE_EDGES} SELECT id, degree, round(lat / 1e9, 9) AS lat, round(lon / 1e9, 9) AS lon FROM (SELECT src AS id, count(*) AS degree FROM (SELECT u AS src FROM dense_edges UNION ALL SELECT v FROM dense_edges) GROUP BY 1) JOIN dense_nodes USING (id)")
def graph(spark, sf):
    segments = edges.segment_edges(load(spark, sf, "dense_vertices"))
    degree = edges.arcs(segments).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))
    return edges.graph_nodes(segments).join(degree, "id").select("id", "degree", F.round("lat", 9).alias("lat"), F.round("lon", 9).alias("lon"))


@query("WA_extract", f"{ctes('dense_refs', 'way_tags', 'dense_nodes')}, {WALKABLE}, {POLYGON}, {inside('dense_nodes')}, kept AS (SELECT r.way_id FROM dense_refs r JOIN walkable USING (way_id) LEFT JOIN inside i ON r.node_id = i.id GROUP BY 1 HAVING bool_and(coalesce(inside, false))), kv AS (SELECT r.way_id, pos, node_id, lat, lon FROM dense_refs r JOIN kept USING (way_id) JOIN dense_nodes n ON n.id = r.node_id), {split('kv')} SELECT way_id, CAST(seq AS INT) AS seq, arg_min(a, pos) AS u, arg_max(b, pos) AS v, round(sum(d), 3) AS distance FROM legs GROUP BY way_id, seq")
def extract(spark, sf):
    from ..jobs.extract import walkable_edges

    cut = walkable_edges(load(spark, sf, "dense_refs"), load(spark, sf, "way_tags"), load(spark, sf, "dense_nodes"))
    return cut.select("way_id", "seq", "u", "v", F.round("distance", 3).alias("distance"))


@query("S5_ways_files", f"{ctes('way_refs', 'nodes')} SELECT way_id, count(*) AS n, sum(coalesce(lat, 0)) AS lat, sum(coalesce(lon, 0)) AS lon FROM way_refs r LEFT JOIN nodes n ON r.node_id = n.id GROUP BY way_id")
def ways_files(spark, sf):
    """Resolved ways written as JSON lines and read again."""
    io.write_ways(ways.resolved_ways(ways.resolve_refs(load(spark, sf, "way_refs"), load(spark, sf, "nodes"))), path := shared_path(spark, "ways"))
    read = io.read_ways(spark, path, lines=True).select("way_id", F.explode("refs").alias("p"))
    return read.groupBy("way_id").agg(F.count("*").alias("n"), F.sum("p.lat").cast("decimal(38,0)").alias("lat"), F.sum("p.lon").cast("decimal(38,0)").alias("lon"))


@query("S7_segment_files", f"{ctes('vertices')}, {split('vertices')} SELECT way_id, CAST(seq AS INT) AS seq, arg_min(a, pos) AS u, arg_max(b, pos) AS v, round(sum(d), 3) AS distance FROM legs GROUP BY way_id, seq")
def segment_files(spark, sf):
    """Edges written by way as JSON lines and read again."""
    io.write_segments(edges.way_segments(edges.split_at_junctions(load(spark, sf, "vertices"))), path := shared_path(spark, "segments"))
    return io.read_edges(spark, path, lines=True).select("way_id", F.col("seq").cast("int").alias("seq"), "u", "v", F.round("distance", 3).alias("distance"))
