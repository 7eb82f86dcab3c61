"""Structured Streaming over evaluation records as they arrive."""
