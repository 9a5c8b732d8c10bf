"""All catalogue queries; importing the modules registers them."""

from tagloom.plans import (  # noqa: F401
    column_queries,
    event_queries,
    flagship,
    model_queries,
    source_queries,
    stat_queries,
)
from tagloom.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
