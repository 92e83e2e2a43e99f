"""The query catalogue over the driver's tables, with the DuckDB SQL of each query."""

from . import lakehouse, parsing, relational, reports, series, stores
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "lakehouse", "parsing", "relational", "reports", "series", "stores"]
