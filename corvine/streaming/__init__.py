"""Structured Streaming ingest and debounce."""
