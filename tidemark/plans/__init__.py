"""Metrics analytics on Spark."""
from . import operations, registry, summaries  # noqa: F401  (registers the queries)
