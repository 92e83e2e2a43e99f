"""Queries of the driver's tables by name, each with the DuckDB SQL of the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import prepare

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


class Tables:
    """The driver's tables of a folder, by attribute."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = prepare(spark), folder

    def __getattr__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @property
    def e(self) -> DataFrame:
        """Events with ms (epoch milliseconds) and k (the number in props)."""
        return self.events.select("*", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), F.get_json_object("props", "$.k").cast("bigint").alias("k"))


#: The same in DuckDB, as the start of a WITH clause.
E = "WITH e AS (SELECT *, epoch_us(ts) // 1000 AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"


def query(name: str, sql: str | None = None):
    """Register a function of Tables under a name."""

    def add(f: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = name, f.__doc__
        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def money(c: Column | str) -> Column:
    """An exact sum of amounts with two decimals, as a double."""
    return F.sum((F.col(c) if isinstance(c, str) else c).cast("decimal(18,2)")).cast("double")
