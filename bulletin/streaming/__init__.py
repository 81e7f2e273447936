"""Structured Streaming twins of the counters and of the incremental ingest."""
