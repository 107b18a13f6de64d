"""Incremental appends through Structured Streaming."""
