"""All registered queries of the library's own operators."""

from __future__ import annotations

from . import catalog_queries, classify_queries, line_queries, lookup_queries, receipt_queries, signal_queries
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES", "catalog_queries", "classify_queries", "line_queries", "lookup_queries", "receipt_queries", "signal_queries"]
