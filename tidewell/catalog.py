"""The table catalogue: typed loaders, views over whatever exists, and ad-hoc SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .schemas import CULTURE_MARKETS, HEARTBEATS, MARKETS, ORDERBOOK, PRICES, SPOT_PRICES, TICKS, Table
from .session import prepare
from .sources.hive import Filter, canonical, data_files, dnf, path_exists, read_table

VIEWS: dict[str, tuple[str, Table]] = {"markets": ("markets.parquet", MARKETS), "prices": ("prices", PRICES), "ticks": ("ticks", TICKS), "orderbook": ("orderbook", ORDERBOOK), "spot_prices": ("spot_prices", SPOT_PRICES), "heartbeats": ("heartbeats", HEARTBEATS)}
#: Shards that await consolidation stay beside the tables, so that no view shows a row twice.
STAGING = "_staging"


def load_markets(spark: SparkSession, path: str, table: Table = MARKETS) -> DataFrame:
    """The market dimension, typed and with defaults; an absent file is an empty table."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], table.schema)
    return canonical(spark.read.parquet(path), table)


def load_culture_markets(spark: SparkSession, path: str) -> DataFrame:
    """The multi-outcome market dimension."""
    return load_markets(spark, path, CULTURE_MARKETS)


def load_partitioned(spark: SparkSession, root: str, table: Table, filters: list | None = None) -> DataFrame:
    """A partitioned table under a filter in disjunctive normal form, which prunes partitions and reaches the files."""
    df, condition = read_table(spark, root, table), dnf(filters)
    return df if condition is None else df.where(condition)


def load_prices(spark: SparkSession, root: str, filters: list[list[Filter]] | list[Filter] | None = None) -> DataFrame:
    return load_partitioned(spark, root, PRICES, filters)


def load_prices_for_timeframe(spark: SparkSession, root: str, timeframe: str) -> DataFrame:
    return load_prices(spark, root, [("timeframe", "=", timeframe)])


def load_ticks(spark: SparkSession, root: str, filters: list[list[Filter]] | list[Filter] | None = None) -> DataFrame:
    return load_partitioned(spark, root, TICKS, filters)


def load_ticks_for_market(spark: SparkSession, root: str, market_id: str, **partition: str | None) -> DataFrame:
    """One market's ticks in time order; naming its partition (crypto=..., timeframe=...) reads that one only."""
    hints = [(c, "=", v) for c, v in partition.items() if v]
    return load_ticks(spark, root, [*hints, ("market_id", "=", market_id)]).orderBy("timestamp_ms")


def market_records(spark: SparkSession, path: str, **wanted: list[str]) -> DataFrame:
    """Markets as the collectors take them: typed, '' for missing texts, restricted to what is asked for (crypto=[...], timeframe=[...]; nothing asked: all)."""
    df = load_markets(spark, path)
    for name, values in wanted.items():
        if values:
            df = df.where(F.col(name).isin(values))
    return df.na.fill("", "question condition_id up_token_id down_token_id slug".split())


def spot_lookup(spark: SparkSession, root: str) -> DataFrame:
    """(crypto, ts_ms, price) of the exchange's dollar-pegged pairs."""
    df = read_table(spark, root, SPOT_PRICES).where("source = 'binance' AND symbol LIKE '%usdt'")
    return df.select(F.upper(F.expr("substring(symbol, 1, length(symbol) - 4)")).alias("crypto"), "ts_ms", "price")


def register_views(spark: SparkSession, root: str, **paths: str) -> list[str]:
    """A temporary view of each table of which there are files; a path given by the table's name stands in for the usual place.

    A table without files has no view, so that a query of it fails with the table's name.
    """
    made = []
    for name, (place, table) in VIEWS.items():
        path = paths.get(name, f"{root.rstrip('/')}/{place}")
        if not (data_files(spark, path) if not path.endswith(".parquet") else path_exists(spark, path)):
            spark.catalog.dropTempView(name)
            continue
        df = load_markets(spark, path) if name == "markets" else read_table(spark, path, table)
        df.createOrReplaceTempView(name)
        made.append(name)
    return made


def query(spark: SparkSession, sql: str, root: str | None = None, limit: int | None = None) -> DataFrame:
    """Any SQL over the views, lazily; limit applies to the result, whatever the text says."""
    prepare(spark)
    if root:
        register_views(spark, root)
    df = spark.sql(sql)
    return df if limit is None else df.limit(limit)


def markdown(df: DataFrame, rows: int = 1000) -> str:
    """A result as a Markdown table; '(no results)' without a row. For showing: at most rows rows are fetched."""
    found = df.limit(rows).collect()
    if not found:
        return "(no results)"
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in found])
