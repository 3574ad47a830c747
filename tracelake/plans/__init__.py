"""Queries over the supplied tables."""

from . import alert_queries, event_queries, fact_queries, lineage_queries, log_queries, result_queries, run_queries, store_queries  # noqa: F401
from .registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
