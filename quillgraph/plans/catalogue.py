"""Every query of the catalogue and its SQL."""

from __future__ import annotations

from . import graph_queries, language_queries, table_queries, text_queries
from .registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "graph_queries", "language_queries", "table_queries", "text_queries"]
