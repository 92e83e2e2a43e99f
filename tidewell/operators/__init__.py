"""Relational, as-of, deduplication, sequence, latch and reporting operators over DataFrames."""
