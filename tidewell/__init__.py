"""A PySpark-native engine for market-data lakehouses: scans, as-of alignment, last-writer-wins
maintenance, sequence operators, semi-structured parsing, quality reports and streaming."""

__version__ = "0.1.0"
