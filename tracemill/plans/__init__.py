"""The queries, by operator id."""

from . import filter_queries, function_queries, join_queries, search_queries, source_queries, window_queries
from .catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "filter_queries", "function_queries", "join_queries", "search_queries", "source_queries", "window_queries"]
