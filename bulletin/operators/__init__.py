"""DataFrame operators over notices, their counters and their sources."""
