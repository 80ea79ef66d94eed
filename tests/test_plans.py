"""Plans that must not send large tables to the driver, or copy pairs."""

import pytest
from pyspark.sql import functions as F

from kerbline.operators import snap, stairs, ways


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def lines(spark, n):
    return spark.range(n).select(F.col("id").alias("edge_id"), F.lit(0).alias("seg"), *[(F.col("id") * 1000 + i).alias(c) for i, c in enumerate(("a_lat", "a_lon", "b_lat", "b_lon"))])


def test_snapping_broadcasts_nothing(spark, monkeypatch):
    """The size of files, from which Spark takes a table's size, is small before rows are spread over cells."""
    made, write = [], snap.materialize
    monkeypatch.setattr(snap, "materialize", lambda df, label: made.append(plan(df)) or write(df, label))
    points = spark.range(50).select(F.col("id").alias("req_id"), (F.col("id") / 1e6).alias("lat"), (F.col("id") / 1e6).alias("lon"))
    found = snap.nearest(points, lines(spark, 50))
    vertex = lambda i: F.struct(F.lit(i).cast("long").alias("id"), F.lit(1).cast("long").alias("lat"), F.lit(2).cast("long").alias("lon"))
    edges = spark.range(50).select(F.col("id").alias("edge_id"), F.lit(0).alias("u"), F.lit(1).alias("v"), F.array(vertex(0), vertex(1)).alias("polyline"))
    pieces = snap.split_edges(found.withColumn("node_id", F.lit(2).cast("long")), edges)
    assert found.count() == 50 and pieces.count() == 100
    assert not [p for p in [*made, plan(found), plan(pieces)] if "BroadcastHashJoin" in p]


@pytest.mark.parametrize("few", [64, 4])
def test_polygons_of_few_edges_are_settled_where_they_meet(spark, monkeypatch, few):
    """No pair of node and polygon is shuffled for them; those of many edges keep their bands."""
    monkeypatch.setattr(ways, "FEW_EDGES", few)
    ring = [(0, 0), (0, 900), (300, 900), (300, 300), (900, 300), (900, 0)]
    sides = [(k, a + 100 * k, o, b + 100 * k, q) for k in range(5) for (a, o), (b, q) in zip(ring, [*ring[1:], ring[0]])]
    nodes = spark.createDataFrame([(i, 37 * i % 1500, 91 * i % 1100) for i in range(300)], "id long, lat long, lon long")
    found = ways.inside_polygons(nodes, spark.createDataFrame(sides, "polygon_id long, a_lat long, a_lon long, b_lat long, b_lon long"))
    want = {(r.id, k) for r in nodes.collect() for k in range(5) if (0 <= (y := r.lat - 100 * k) < 300 and r.lon < 900) or (300 <= y < 900 and r.lon < 300)}
    assert {(r.id, r.polygon_id) for r in found.collect()} == want and len(want) > 100
    assert ("HashAggregate(keys=[id" in plan(found)) == (few == 4)


def test_stairs_make_no_pair_for_each_vertex(spark, monkeypatch):
    """Many edges at one place are asked about once."""
    asked, write = [], stairs.materialize
    monkeypatch.setattr(stairs, "materialize", lambda df, label: asked.append(df) or write(df, label))
    vertices = spark.range(200).select(F.col("id").alias("edge_id"), (F.col("id") % 4 * 1_000_000).alias("lat"), F.lit(0).cast("long").alias("lon"))
    steps = spark.range(50).select((F.col("id") * 10).alias("lat"), F.lit(0).cast("long").alias("lon"))
    found = stairs.near_stairs(vertices, steps, 25.0)
    assert sorted(r.edge_id for r in found.collect()) == [i for i in range(200) if i % 4 == 0]
    assert asked[-1].count() == 1
