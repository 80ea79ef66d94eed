"""Stored walkway responses to a dense graph of the walkways inside an area."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.geo import AREA
from ..operators.walkways import SPACING_M, clip, dense_graph


def walkway_graph(lines: DataFrame, corners: Sequence[tuple[float, float]] = AREA, spacing_m: float = SPACING_M, digits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of lines(line_id, pts) clipped to the area, with a point every spacing_m."""
    return dense_graph(clip(lines, corners).select("line_id", "pts"), spacing_m, digits)
