"""Readers and writers of notices, counters and the source dimension."""
