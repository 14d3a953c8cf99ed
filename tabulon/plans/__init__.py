"""Registered queries with their oracles."""

from tabulon.plans import aggregate_queries, catalogue_queries, scalar_queries, table_queries  # noqa: F401
from tabulon.plans.registry import ORACLES, QUERIES  # noqa: F401
