"""Incremental ingest of landed station files (Structured Streaming)."""
