"""Registered queries over the given tables."""

from .registry import ORACLE, QUERIES  # noqa: F401
from . import (  # noqa: F401, E402
    aggregate_queries, join_queries, matching_queries, plot_queries, row_queries,
    scoring_queries, shape_queries, source_queries, stat_queries,
)
