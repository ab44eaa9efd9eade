"""Runnable queries by inventory key."""

from layerlab.queries import (  # noqa: F401  (importing registers the queries)
    evaluation_queries,
    experiment_queries,
    probe_queries,
    source_queries,
    table_queries,
    text_queries,
    vector_queries,
)
from layerlab.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
