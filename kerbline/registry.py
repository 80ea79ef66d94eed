"""Queries over the driver's tables and the SQL that checks them."""

from __future__ import annotations

from .queries import maps, routes

MODULES = (maps, routes)
QUERIES = {k: f for m in MODULES for k, f in m.QUERIES.items()}
ORACLES = {k: s for m in MODULES for k, s in m.ORACLES.items()}
FLAGSHIP = "W1_split_ways"
