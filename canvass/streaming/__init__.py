"""Incremental sync as Structured Streaming."""
