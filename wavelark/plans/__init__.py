"""All registered queries."""

from wavelark.plans import (  # noqa: F401
    window_queries, context_queries, model_queries, integrity_queries, store_queries, capture_queries, stream_queries,
)
from wavelark.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
