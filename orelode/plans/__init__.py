"""Registered queries over the driver's tables, each with its SQL twin where SQL can say it."""

from . import drillhole_queries, grid_queries, ingest_queries, line_queries, model_queries, stats_queries, version_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
