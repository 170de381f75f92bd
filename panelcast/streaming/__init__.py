"""Incremental ingest and daily aggregates over arriving files."""
