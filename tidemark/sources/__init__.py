"""Readers, writers, and text encodings of metrics and spans."""
