"""Incremental (Structured Streaming) ingest of newly arriving trip files."""
