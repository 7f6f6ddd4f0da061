"""Queries of the screen analysis over the given tables, with the SQL that states the same results."""

from locusmill.plans import composite_queries, join_queries, model_queries, scalar_queries, source_queries, stat_queries  # noqa: F401
from locusmill.plans.registry import QUERIES, SQL  # noqa: F401
