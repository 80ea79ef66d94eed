"""Ways cut at junctions into edges, and the graph they form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import nano_distance
from .ways import ref_counts


def split_at_junctions(vertices: DataFrame) -> DataFrame:
    """Edges (way_id, seq, u, v, distance, polyline) of vertices(way_id, pos, node_id, lat, lon).

    A junction is a node with more than one reference. Edges run from junction to junction; what is before a way's first
    and after its last is dropped. One shuffle on the node flags junctions, one on the way cuts, with a sort inside.
    """
    junctions = ref_counts(vertices).where("n > 1").select("node_id", F.lit(1).alias("junction"))
    flagged = vertices.join(junctions, "node_id", "left")
    way = W.partitionBy("way_id").orderBy("pos")
    legs = flagged.select(
        "way_id", "pos", F.struct(F.col("node_id").alias("id"), "lat", "lon").alias("a"),
        F.lead(F.struct(F.col("node_id").alias("id"), "lat", "lon")).over(way).alias("b"),
        F.sum(F.coalesce("junction", F.lit(0))).over(way.rowsBetween(W.unboundedPreceding, 0)).alias("seq"),
        F.sum(F.coalesce("junction", F.lit(0))).over(W.partitionBy("way_id")).alias("n_junctions"),
    ).where("seq >= 1 and seq < n_junctions and b is not null")
    legs = legs.withColumn("d", nano_distance(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
    cut = legs.groupBy("way_id", "seq").agg(F.sum("d").alias("distance"), F.sort_array(F.collect_list(F.struct("pos", "a"))).alias("s"), F.max_by("b", "pos").alias("last"))
    line = F.concat(F.transform("s", lambda x: x["a"]), F.array("last"))
    return cut.select("way_id", (F.col("seq") - 1).cast("int").alias("seq"), F.get("s", F.lit(0))["a"]["id"].alias("u"), F.col("last.id").alias("v"), "distance", line.alias("polyline"))


def segment_edges(vertices: DataFrame) -> DataFrame:
    """Every pair of consecutive vertices as an edge (edge_id, way_id, seq, u, v, distance, polyline); edge_id comes from way and position."""
    way = W.partitionBy("way_id").orderBy("pos")
    vertex = F.struct(F.col("node_id").alias("id"), "lat", "lon")
    pairs = vertices.select("way_id", F.col("pos").cast("long").alias("seq"), vertex.alias("a"), F.lead(vertex).over(way).alias("b")).where("b is not null")
    distance = nano_distance(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon"))
    return pairs.select((F.col("way_id") * 10_000 + F.col("seq")).alias("edge_id"), "way_id", "seq", F.col("a.id").alias("u"), F.col("b.id").alias("v"), distance.alias("distance"), F.array("a", "b").alias("polyline"))


def way_segments(edges: DataFrame) -> DataFrame:
    """way_id, total_distance, edges in order."""
    parts = F.sort_array(F.collect_list(F.struct("seq", "u", "v", "distance", "polyline")))
    return edges.groupBy("way_id").agg(F.sum("distance").alias("total_distance"), parts.alias("edges"))


def arcs(edges: DataFrame) -> DataFrame:
    """Each edge in both directions: src, dst, edge_id, weight, polyline."""
    there = edges.select(F.col("u").alias("src"), F.col("v").alias("dst"), "edge_id", F.col("distance").alias("weight"), "polyline")
    return there.unionByName(edges.select(F.col("v").alias("src"), F.col("u").alias("dst"), "edge_id", F.col("distance").alias("weight"), F.reverse("polyline").alias("polyline")))


def canonical(arcs: DataFrame) -> DataFrame:
    """Each edge once, from the smaller to the larger node; no loops."""
    return arcs.where("src < dst")


def graph_nodes(edges: DataFrame) -> DataFrame:
    """id, lat, lon (degrees) of edge ends; the first in order of way, sequence, start before end."""
    end = lambda i, side: edges.select(F.element_at("polyline", i).alias("p"), F.struct("way_id", "seq", F.lit(side)).alias("o"))
    both = end(1, 0).union(end(-1, 1))
    return both.groupBy("p.id").agg(F.min_by("p", "o").alias("p")).select("id", (F.col("p.lat") / 1e9).alias("lat"), (F.col("p.lon") / 1e9).alias("lon"))
