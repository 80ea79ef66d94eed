"""Walkways: lines(line_id, pts: array of (lat, lon) in degrees) clipped to an area, densified and turned into a graph."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.geo import AREA, haversine_asin, in_polygon_degrees

SPACING_M = 2.0
POINT = "struct<lat: double, lon: double>"


def clip(lines: DataFrame, corners: Sequence[tuple[float, float]] = AREA) -> DataFrame:
    """line_id, piece, pts: the parts of each line inside the polygon.

    Each segment is cut where it crosses the border; a part is kept if its middle is inside; parts that follow each other
    without a gap join to one piece. Lines wholly outside the polygon's box are dropped before.
    """
    south, north = min(a for a, _ in corners), max(a for a, _ in corners)
    west, east = min(o for _, o in corners), max(o for _, o in corners)
    lines = lines.where((F.array_max(F.transform("pts", lambda p: p["lat"])) >= south) & (F.array_min(F.transform("pts", lambda p: p["lat"])) <= north) & (F.array_max(F.transform("pts", lambda p: p["lon"])) >= west) & (F.array_min(F.transform("pts", lambda p: p["lon"])) <= east))
    legs = lines.select("line_id", "pts", F.posexplode(F.slice("pts", 1, F.size("pts") - 1)).alias("leg", "a")).select("line_id", "leg", "a", F.get("pts", F.col("leg") + 1).alias("b"))

    def crossing(p: tuple[float, float], q: tuple[float, float]) -> Column:
        # where a + t (b - a) meets p + s (q - p), with both shares within [0, 1]
        dy, dx = F.col("b.lat") - F.col("a.lat"), F.col("b.lon") - F.col("a.lon")
        ey, ex = q[0] - p[0], q[1] - p[1]
        across = F.nullif(dx * ey - dy * ex, F.lit(0.0))
        oy, ox = F.lit(p[0]) - F.col("a.lat"), F.lit(p[1]) - F.col("a.lon")
        t, s = (ox * ey - oy * ex) / across, (ox * dy - oy * dx) / across
        return F.when((t > 0) & (t < 1) & (s >= 0) & (s <= 1), t)

    cuts = F.array(F.lit(0.0), F.lit(1.0), *[crossing(p, q) for p, q in zip(corners, [*corners[1:], corners[0]], strict=True) if p != q])
    legs = legs.withColumn("ts", F.array_sort(F.array_distinct(F.filter(cuts, lambda t: t.isNotNull()))))
    parts = legs.select("line_id", "leg", "a", "b", "ts", F.posexplode(F.slice("ts", 1, F.size("ts") - 1)).alias("n", "t0")).withColumn("t1", F.get("ts", F.col("n") + 1))
    at = lambda t: F.struct((F.col("a.lat") + t * (F.col("b.lat") - F.col("a.lat"))).alias("lat"), (F.col("a.lon") + t * (F.col("b.lon") - F.col("a.lon"))).alias("lon"))
    parts = parts.withColumn("mid", at((F.col("t0") + F.col("t1")) / 2))
    parts = parts.where(in_polygon_degrees(F.col("mid.lat"), F.col("mid.lon"), corners)).select("line_id", "leg", "t0", "t1", at(F.col("t0")).alias("p"), at(F.col("t1")).alias("q"))
    line = W.partitionBy("line_id").orderBy("leg", "t0")
    follows = ((F.col("leg") == F.lag("leg").over(line)) & (F.col("t0") == F.lag("t1").over(line))) | ((F.col("leg") == F.lag("leg").over(line) + 1) & (F.col("t0") == 0) & (F.lag("t1").over(line) == 1))
    parts = parts.withColumn("new", F.when(F.coalesce(follows, F.lit(False)), 0).otherwise(1)).withColumn("piece", F.sum("new").over(line) - 1)
    pieces = parts.groupBy("line_id", "piece").agg(F.sort_array(F.collect_list(F.struct("leg", "t0", "p", "q"))).alias("s"))
    return pieces.select("line_id", "piece", F.concat(F.array(F.get("s", F.lit(0))["p"]), F.transform("s", lambda x: x["q"])).cast(f"array<{POINT}>").alias("pts"))


def densify(pts: Column, spacing_m: float = SPACING_M) -> Column:
    """The first point; of each longer leg a point every spacing_m (its end left out), of each other leg its end."""

    def leg(p: Column, i: Column) -> Column:
        a = F.get(pts, i - 1)
        d = haversine_asin(a["lat"], a["lon"], p["lat"], p["lon"])
        n = F.floor(d / spacing_m).cast("int")
        steps = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda j: F.struct((a["lat"] + (p["lat"] - a["lat"]) * (j * spacing_m / d)).alias("lat"), (a["lon"] + (p["lon"] - a["lon"]) * (j * spacing_m / d)).alias("lon")))
        return F.when((i == 0) | (d <= spacing_m), F.array(F.struct(p["lat"].alias("lat"), p["lon"].alias("lon")))).otherwise(steps)

    return F.flatten(F.transform(pts, leg))


def dense_graph(lines: DataFrame, spacing_m: float = SPACING_M, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes (lat, lon) and edges (a, b, weight), undirected and once each; digits rounds coordinates first, so that near-equal floats meet."""
    dense = lines.select("line_id", densify(F.col("pts"), spacing_m).alias("pts"))
    if digits is not None:
        dense = dense.withColumn("pts", F.transform("pts", lambda p: F.struct(F.round(p["lat"], digits).alias("lat"), F.round(p["lon"], digits).alias("lon"))))
    nodes = dense.select(F.explode("pts").alias("p")).select("p.lat", "p.lon").distinct()
    pairs = dense.select(F.explode(F.transform(F.slice("pts", 1, F.size("pts") - 1), lambda p, i: F.struct(p.alias("p"), F.get("pts", i + 1).alias("q")))).alias("e")).select("e.*")
    pairs = pairs.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b")).distinct()
    return nodes, pairs.withColumn("weight", haversine_asin(F.col("a.lat"), F.col("a.lon"), F.col("b.lat"), F.col("b.lon")))
