"""Column expressions: time, confidence, text and JSON."""
