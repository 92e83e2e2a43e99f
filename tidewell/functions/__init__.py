"""Column expressions: timestamps, question texts, market records and wire messages."""
