"""Structured Streaming: ingestion, windows, deduplication and keyed state."""
