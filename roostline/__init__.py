"""Roostline: rental-snapshot ingest, filtered vector search and run analytics as Spark jobs."""

__version__ = "0.1.0"
