"""Queries over the driver tables, one or more per operator, with SQL twins."""

from tidegauge.queries import (
    base,
    cohort_queries,
    feature_queries,
    inventory_queries,
    model_queries,
    rule_queries,
    source_queries,
    split_queries,
    window_queries,
)
from tidegauge.queries.base import REGISTRY

__all__ = [
    "REGISTRY",
    "base",
    "cohort_queries",
    "feature_queries",
    "inventory_queries",
    "model_queries",
    "rule_queries",
    "source_queries",
    "split_queries",
    "window_queries",
]
