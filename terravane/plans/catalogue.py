"""All queries by name, with the SQL that gives the same rows where there is one."""

from __future__ import annotations

from . import aggregate_queries, graph_queries, kernel_queries, placement_queries, planar_queries, raster_queries, rule_queries, scalar_queries, sequence_queries, source_queries, spatial_queries, structure_queries  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
