"""Importing this module registers every query."""

from tidemark.plans import kpi_queries, model_queries, table_queries, text_queries, tool_queries  # noqa: F401
from tidemark.plans.registry import CHECKS, QUERIES  # noqa: F401
