"""Whole jobs: migrate logs, answer request batches, validate a copy."""
