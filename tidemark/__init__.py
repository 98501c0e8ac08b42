"""Metrics analytics on Spark."""
