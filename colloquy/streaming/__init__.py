"""Incremental commits on Structured Streaming."""
