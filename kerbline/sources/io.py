"""Readers and writers of map files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schemas


def read_ways(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """way_id, refs from a JSON array (or JSON lines) of resolved ways; stairs have the same form."""
    return spark.read.schema(schemas.WAYS_GEO).option("multiLine", not lines).json(path)


def read_edges(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """way_id, seq, u, v, distance, polyline from a JSON array (or lines) of ways with their edges."""
    rows = spark.read.schema(schemas.SEGMENTS).option("multiLine", not lines).json(path)
    return rows.select("way_id", F.posexplode("edges").alias("seq", "e")).select("way_id", "seq", F.col("e.start.id").alias("u"), F.col("e.end.id").alias("v"), "e.distance", "e.polyline")


def read_nodes(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    return spark.read.schema(schemas.NODES).option("multiLine", not lines).json(path)


def read_overpass(spark: SparkSession, path: str) -> DataFrame:
    """pts (array of lat, lon in degrees) of the elements that have a geometry."""
    rows = spark.read.schema(schemas.OVERPASS).option("multiLine", True).json(path)
    return rows.select(F.explode("elements").alias("e")).where("e.geometry is not null").select(F.col("e.geometry").alias("pts"))


def write_ways(resolved: DataFrame, path: str) -> None:
    """JSON lines of way_id, refs."""
    resolved.select("way_id", "refs").write.json(path)


def write_segments(segments: DataFrame, path: str) -> None:
    """JSON lines of ways with their edges, in the form that read_edges() takes."""
    edge = lambda e: F.struct(F.get(e["polyline"], F.lit(0)).alias("start"), F.element_at(e["polyline"], -1).alias("end"), e["polyline"].alias("polyline"), e["distance"].alias("distance"))
    segments.select("way_id", "total_distance", F.transform("edges", edge).alias("edges")).write.json(path)


def write_routes(routes: DataFrame, path: str) -> None:
    """One JSON line for each request and rank: encoded polyline and total distance."""
    routes.select("req_id", "rank", "encoded_polyline", "total_distance").write.json(path)
