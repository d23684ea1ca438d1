"""Ordered, batch-by-batch iteration with Structured Streaming."""
