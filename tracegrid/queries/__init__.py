"""Queries over the driver's tables, one for each operator, with the SQL that gives the same rows."""

from . import cases, catalog, evidence, graph, logs, timeline
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "cases", "catalog", "evidence", "graph", "logs", "timeline"]
