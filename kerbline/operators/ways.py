"""Filters, lookups, joins and counts on map extracts: nodes(id, lat, lon), way_refs(way_id, pos, node_id), way_tags(way_id, k, v)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from ..sources.shared import materialize

# fixed values: tag keys and values of the walkable rule
WAY_KEYS = ("footway", "highway")
ROAD_VALUES = ("trunk", "motorway", "secondary", "road", "primary", "tertiary", "unclassified")


#: Counted rows up to which a table is broadcast.
BROADCAST_ROWS = 1_000_000
#: Edges of a polygon for each of the bands of latitude that it is cut into, and most bands.
BAND_EDGES, MOST_BANDS = 4, 4096
#: Most edges of a polygon that go along with it, and how many powers of two its grid is finer than its box.
FEW_EDGES, FINER = 64, 2
#: Most edges of a polygon that are tested by compiled code, edge by edge.
UNROLLED = 8


def union(tables: Sequence[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, tables)


def small(keys: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """keys with a broadcast hint if its counted rows are few; else as it is."""
    return F.broadcast(keys) if keys.count() <= most else keys


def way_refs(ways: DataFrame) -> DataFrame:
    """Long form of ways(way_id, refs)."""
    return ways.select("way_id", F.posexplode("refs").alias("pos", "node_id"))


def ref_counts(refs: DataFrame) -> DataFrame:
    """How often each node is referenced, repeats in one way included."""
    return refs.groupBy("node_id").agg(F.count("*").alias("n"))


def walkable(tags: DataFrame) -> DataFrame:
    """way_id of ways with a foot or highway tag that is no road, unless the surface is bare ground."""
    path = F.col("k").isin(*WAY_KEYS) & ~F.col("v").isin(*ROAD_VALUES)
    ground = (F.col("k") == "surface") & (F.col("v") == "ground")
    return tags.groupBy("way_id").agg(F.bool_or(path).alias("path"), F.bool_or(ground).alias("ground")).where("path and not ground").select("way_id")


def stairs(tags: DataFrame) -> DataFrame:
    return tags.where("k = 'highway' and v = 'steps'").select("way_id").distinct()


def in_box(tags: DataFrame, refs: DataFrame, nodes: DataFrame, south: int, west: int, north: int, east: int) -> DataFrame:
    """Footways with a node in the box; the box filter reaches the scan of the nodes."""
    inside = nodes.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).select(F.col("id").alias("node_id"))
    ways = tags.where("k = 'highway' and v = 'footway'").select("way_id").distinct()
    touching = refs.join(ways, "way_id", "left_semi").join(inside, "node_id", "left_semi")
    return touching.select("way_id").distinct()


def lookup_nodes(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    return ids.select("id").distinct().join(nodes, "id")


def lookup_refs(refs: DataFrame, ids: DataFrame) -> DataFrame:
    """way_id and its nodes in order."""
    found = refs.join(ids.select("way_id").distinct(), "way_id", "left_semi")
    return found.groupBy("way_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "node_id"))), lambda x: x["node_id"]).alias("refs"))


def lookup_tags(tags: DataFrame, asked: DataFrame) -> DataFrame:
    """(way_id, k) with the value, or null."""
    return asked.join(tags, ["way_id", "k"], "left")


def adjacent(refs: DataFrame) -> DataFrame:
    """way_id of ways with a node that is referenced more than once."""
    shared = ref_counts(refs).where("n > 1").select("node_id")
    return refs.join(shared, "node_id", "left_semi").select("way_id").distinct()


def resolve_refs(refs: DataFrame, nodes: DataFrame, missing: str = "zero") -> DataFrame:
    """way_id, pos, node_id, lat, lon; a missing node has coordinates 0, or null with missing='null'."""
    out = refs.join(nodes, refs.node_id == nodes.id, "left").select("way_id", "pos", "node_id", "lat", "lon")
    return out.na.fill(0, ["lat", "lon"]) if missing == "zero" else out


def resolved_ways(vertices: DataFrame) -> DataFrame:
    """way_id, refs: array of (id, lat, lon) in order."""
    ordered = F.sort_array(F.collect_list(F.struct("pos", F.col("node_id").alias("id"), "lat", "lon")))
    return vertices.groupBy("way_id").agg(F.transform(ordered, lambda v: F.struct(v["id"], v["lat"], v["lon"])).alias("refs"))


def inside_polygon(refs: DataFrame, nodes: DataFrame, polygon: Sequence[tuple[int, int]]) -> DataFrame:
    """way_id of ways of which every node exists and lies inside."""
    located = refs.join(in_area(nodes, polygon).withColumnRenamed("id", "node_id"), "node_id", "left")
    return located.groupBy("way_id").agg(F.bool_and(F.col("lat").isNotNull()).alias("all")).where("all").select("way_id")


def in_area(nodes: DataFrame, polygon: Sequence[tuple[int, int]]) -> DataFrame:
    """nodes(id, lat, lon) inside the polygon; its box reaches their scan."""
    lats, lons = [a for a, _ in polygon], [o for _, o in polygon]
    boxed = nodes.where(F.col("lat").between(min(lats), max(lats)) & F.col("lon").between(min(lons), max(lons)))
    return boxed.where(in_polygon(F.col("lat"), F.col("lon"), polygon)).select("id", "lat", "lon")


def located_inside(refs: DataFrame, nodes: DataFrame, polygon: Sequence[tuple[int, int]]) -> DataFrame:
    """way_id, pos, node_id, lat, lon of ways of which every node exists and lies inside: one join with the nodes, one grouping by way."""
    located = refs.join(in_area(nodes, polygon).withColumnRenamed("id", "node_id"), "node_id", "left").select("way_id", "pos", "node_id", "lat", "lon")
    whole = W.partitionBy("way_id").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return located.withColumn("whole", F.bool_and(F.col("lat").isNotNull()).over(whole)).where("whole").drop("whole")


def inside_polygons(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, polygon_id) for many polygons given by edges(polygon_id, a_lat, a_lon, b_lat, b_lon).

    A polygon lies in a grid whose cells are a quarter to an eighth of its box (a power of two); a node asks
    one cell of each grid that is in use (64 at most). A polygon of FEW_EDGES at most brings its edges along to its cells, so that pairs are
    settled where they meet. The edges of others lie in bands of latitude, and a node meets those of its band only. All joins are on equal keys.
    """
    boxes = edges.groupBy("polygon_id").agg(F.min(F.least("a_lat", "b_lat")).alias("s"), F.max(F.greatest("a_lat", "b_lat")).alias("n"), F.min(F.least("a_lon", "b_lon")).alias("w"), F.max(F.greatest("a_lon", "b_lon")).alias("e"), F.count("*").alias("k"))
    level = F.ceil(F.log2(F.greatest(F.col("n") - F.col("s"), F.col("e") - F.col("w"), F.lit(1)).cast("double") + 1)).cast("int")
    level = F.greatest(level - FINER, F.lit(0))
    bands = F.least(F.greatest(F.expr(f"k div {BAND_EDGES}"), F.lit(1)), F.lit(MOST_BANDS))
    boxes = boxes.withColumn("level", level).withColumn("tall", F.expr("(n - s)") / bands + 1).withColumn("tall", F.ceil("tall").cast("long"))
    boxes = materialize(boxes, "boxes")
    down = lambda c: F.call_function("shiftright", F.col(c), F.col("level"))
    cells = boxes.withColumn("row", F.explode(F.sequence(down("s"), down("n")))).withColumn("col", F.explode(F.sequence(down("w"), down("e"))))
    levels = [r["level"] for r in boxes.select("level").distinct().collect()]  # at most 64
    asked = nodes.select("id", "lat", "lon", F.explode(F.array(*[F.lit(x) for x in levels]).cast("array<int>")).alias("level")).withColumn("row", down("lat")).withColumn("col", down("lon"))
    at = lambda a_lat, a_lon, b_lat, b_lon: F.call_function("div", (F.col("lat") - a_lat) * (b_lon - a_lon), F.nullif(b_lat - a_lat, F.lit(0))) + a_lon
    crosses = lambda a_lat, a_lon, b_lat, b_lon: ((F.col("lat") < a_lat) != (F.col("lat") < b_lat)) & (F.col("lon") < at(a_lat, a_lon, b_lat, b_lon))
    ends = ("a_lat", "a_lon", "b_lat", "b_lon")
    inside = F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e"))
    few, many = cells.where(F.col("k") <= FEW_EDGES), cells.where(F.col("k") > FEW_EDGES)
    of_few = edges.join(boxes.where(F.col("k") <= FEW_EDGES).select("polygon_id"), "polygon_id", "left_semi").groupBy("polygon_id").agg(F.collect_list(F.struct(*ends)).alias("line"))
    near = asked.join(few.join(of_few, "polygon_id").select("polygon_id", "level", "row", "col", "s", "n", "w", "e", "line").hint("merge"), ["level", "row", "col"])
    longest = boxes.where(F.col("k") <= FEW_EDGES).agg(F.max("k")).first()[0] or 0
    if longest <= UNROLLED:
        crossings = sum((F.when(crosses(*[F.get("line", F.lit(i))[c] for c in ends]), 1).otherwise(0) for i in range(longest)), F.lit(0))
    else:
        crossings = F.size(F.filter("line", lambda x: crosses(*[x[c] for c in ends])))
    found = near.where(inside).where(crossings % 2 == 1).select("id", "polygon_id")
    if boxes.where(F.col("k") > FEW_EDGES).isEmpty():
        return found
    near = asked.join(many.select("polygon_id", "level", "row", "col", "s", "n", "w", "e", "tall"), ["level", "row", "col"]).where(inside)
    near = near.select("id", "lat", "lon", "polygon_id", F.expr("(lat - s) div tall").alias("band"))
    cut = edges.join(boxes.where(F.col("k") > FEW_EDGES).select("polygon_id", "s", "tall"), "polygon_id")
    cut = cut.withColumn("band", F.explode(F.expr("sequence((least(a_lat, b_lat) - s) div tall, (greatest(a_lat, b_lat) - s) div tall)"))).drop("s", "tall")
    pairs = near.join(cut, ["polygon_id", "band"]).groupBy("id", "polygon_id").agg(F.sum(F.when(crosses(*map(F.col, ends)), 1).otherwise(0)).alias("n"))
    return found.unionByName(pairs.where("n % 2 = 1").select("id", "polygon_id"))


def summary(nodes: DataFrame, refs: DataFrame) -> DataFrame:
    ways = refs.select("way_id").distinct().agg(F.count("*").alias("n_ways"))
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(ways)  # one row each


def bounding_box(nodes: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return nodes.groupBy(*by).agg(F.min("lat").alias("min_lat"), F.max("lat").alias("max_lat"), F.min("lon").alias("min_lon"), F.max("lon").alias("max_lon"))


def unique_vertices(vertices: DataFrame) -> DataFrame:
    return vertices.groupBy(F.col("node_id").alias("id")).agg(F.min(F.struct("lat", "lon")).alias("p")).select("id", "p.lat", "p.lon")


def decode_tags(coded: DataFrame, strings: DataFrame) -> DataFrame:
    """way_id, k, v of coded(blob_id, way_id, key, val) through strings(blob_id, idx, s)."""
    k, v = (strings.select("blob_id", F.col("idx").alias(i), F.col("s").alias(s)) for i, s in (("key", "k"), ("val", "v")))
    return coded.join(k, ["blob_id", "key"]).join(v, ["blob_id", "val"]).select("way_id", "k", "v")


def delta_decode(df: DataFrame, by: Sequence[str], order: str, columns: Sequence[str]) -> DataFrame:
    """Running sums of columns in order, within by."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    return df.withColumns({c: F.sum(c).over(w) for c in columns})


def pbf_coordinate(raw, granularity=100, offset=0):
    """Nanodegrees of a raw PBF coordinate."""
    return F.lit(offset) + F.lit(granularity) * raw
