"""Transparency logs as Spark tables: migrate, serve in batches, verify, compare."""
