"""Map tables derived from the driver's tables, as one SQL text for Spark and for the checking engine."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

BASE = ("lineitem", "orders", "part", "customer", "nation", "supplier", "events")

#: {name} stands for another derived table or one of BASE.
TABLES = {
    # about 26% of these references are junctions
    "way_refs": """SELECT l_orderkey AS way_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
        l_partkey * 100 + CAST(l_quantity AS BIGINT) - 1 + 50 * (l_linenumber % 2) AS node_id FROM {lineitem}""",
    # consecutive references are edges of a routing graph
    "dense_refs": """SELECT l_orderkey AS way_id,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS pos,
        l_partkey * 4 + CAST(l_quantity AS BIGINT) % 4 AS node_id FROM {lineitem}""",
    "all_nodes": """SELECT id, 40893000000 + ((id * 7919) % 33000) * 1000 AS lat, -73139000000 + ((id * 104729) % 31500) * 1000 AS lon
        FROM (SELECT DISTINCT node_id AS id FROM {way_refs}) t""",
    # without about 1% of the nodes
    "nodes": "SELECT id, lat, lon FROM {all_nodes} WHERE id % 97 <> 0",
    "dense_nodes": """SELECT id, 40893000000 + ((id * 7919) % 33000) * 1000 AS lat, -73139000000 + ((id * 104729) % 31500) * 1000 AS lon
        FROM (SELECT DISTINCT node_id AS id FROM {dense_refs}) t""",
    "vertices": "SELECT way_id, pos, node_id, lat, lon FROM {way_refs} r JOIN {all_nodes} n ON r.node_id = n.id",
    "dense_vertices": "SELECT way_id, pos, node_id, lat, lon FROM {dense_refs} r JOIN {dense_nodes} n ON r.node_id = n.id",
    "way_tags": """SELECT o_orderkey AS way_id, 'highway' AS k, CASE o_orderpriority WHEN '1-URGENT' THEN 'footway' WHEN '2-HIGH' THEN 'steps'
        WHEN '3-MEDIUM' THEN 'primary' WHEN '4-NOT SPECIFIED' THEN 'path' ELSE 'motorway' END AS v FROM {orders}
        UNION ALL SELECT o_orderkey, 'surface', CASE o_orderstatus WHEN 'F' THEN 'ground' ELSE 'asphalt' END FROM {orders}""",
    # every way that is tagged as steps
    "stairs": """SELECT r.node_id AS id, n.lat, n.lon FROM {dense_refs} r JOIN {dense_nodes} n ON r.node_id = n.id
        JOIN {orders} o ON o.o_orderkey = r.way_id WHERE o.o_orderpriority = '2-HIGH'""",
    "segments": """SELECT p_partkey AS edge_id, 40893000000 + ((p_partkey * 7919) % 33000) * 1000 AS a_lat,
        -73139000000 + ((p_partkey * 104729) % 31500) * 1000 AS a_lon,
        40893000000 + ((p_partkey * 7919) % 33000) * 1000 + (p_size - 25) * 20000 AS b_lat,
        -73139000000 + ((p_partkey * 104729) % 31500) * 1000 + (p_partkey % 51 - 25) * 20000 AS b_lon FROM {part}""",
    "points": """SELECT c_custkey AS req_id, (40893000 + (c_custkey * 4799) % 33000) / 1e6 AS lat,
        (-73139000 + (c_custkey * 15485863) % 31500) / 1e6 AS lon FROM {customer}""",
    # from the first to the last node of the way that bears a customer's number
    "requests": """SELECT way_id AS req_id, min_by(node_id, pos) AS src, max_by(node_id, pos) AS dst FROM {dense_refs} r
        JOIN {customer} c ON c.c_custkey = r.way_id GROUP BY way_id""",
    "elevations": "SELECT id, CAST((id * 31) % 400 / 10e0 AS DOUBLE) AS elevation FROM {nodes}",
    "candidates": """SELECT l_orderkey AS req_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cand_id,
        l_extendedprice AS distance, l_discount AS avg_slope, CAST(l_linenumber % 3 AS DOUBLE) AS stairs,
        0.01 * l_extendedprice + 120 * l_discount + 5 * (l_linenumber % 3) + l_tax AS cost FROM {lineitem}""",
}


def base(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name in BASE:
        return base(spark, sf_dir, name)
    needs = set(re.findall(r"\{(\w+)\}", TABLES[name]))
    return spark.sql(TABLES[name], **{n: load(spark, sf_dir, n) for n in needs})


def ctes(*names: str) -> str:
    """WITH RECURSIVE and the named tables with all they need."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in BASE or name in done:
            return
        for n in re.findall(r"\{(\w+)\}", TABLES[name]):
            add(n)
        done[name] = TABLES[name].format(**{n: n for n in (*BASE, *TABLES)})

    for name in names:
        add(name)
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({text})" for n, text in done.items())
