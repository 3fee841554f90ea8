"""All queries of the climate operators, and their SQL."""

from . import array_queries, compound_queries, more_queries, series_queries, source_queries, stream_queries, subset_queries  # noqa: F401  register on import
from .base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
