"""Incremental processing by Structured Streaming."""
