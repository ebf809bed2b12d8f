"""Structured Streaming forms of the incremental paths."""
