"""Structured Streaming over the append-only tables."""
