"""Incremental linkage over Structured Streaming."""
