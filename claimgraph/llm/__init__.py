"""Operators of a training-data pipeline: extraction, filters, near duplicates, mixing, formatting."""
