"""A map extract to the walkable edge table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.geo import nano_polygon
from ..operators.edges import split_at_junctions
from ..operators.ways import located_inside, walkable


def walkable_edges(refs: DataFrame, tags: DataFrame, nodes: DataFrame, polygon: Sequence[tuple[int, int]] | None = None) -> DataFrame:
    """Tags first, then geometry; references are counted over the ways that survive both."""
    ways = refs.join(walkable(tags), "way_id", "left_semi")
    return split_at_junctions(located_inside(ways, nodes, polygon or nano_polygon()))
