"""Whole jobs: ingest, statistics and the serving slices."""
