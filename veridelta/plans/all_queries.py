"""Importing this module registers all queries."""

from . import evidence_queries, file_queries, graph_queries, log_queries, table_queries  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
