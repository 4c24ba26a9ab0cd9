"""Streams of leaves that still arrive."""
