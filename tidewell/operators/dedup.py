"""Last-writer-wins deduplication, in its two kinds, and the override of legacy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import TICKS

#: The order of writers that hive.provenance adds.
WRITERS = ("_src_mtime", "_src_file", "_src_row")
TICK_KEY = TICKS.key
_LEGACY_KEY = TICK_KEY[:4]


def latest_value(column: str, order: Column) -> Column:
    """The column's value in the latest row where it is not null."""
    return F.max_by(column, F.when(F.col(column).isNotNull(), order))


def merge_columns(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """One row a key, in which every column has its latest non-null value; columns may come from different rows."""
    rest = [c for c in df.columns if c not in key and not c.startswith("_")]
    return df.groupBy(*key).agg(*[latest_value(c, order).alias(c) for c in rest]).select(*[c for c in df.columns if not c.startswith("_")])


def keep_last(df: DataFrame, key: list[str], order: list[Column] | list[str]) -> DataFrame:
    """The latest whole row of each key, nulls and all: one aggregate, which thins the rows before they are sent."""
    by = [F.col(c) if isinstance(c, str) else c for c in order]
    rest = [c for c in df.columns if c not in key]
    if not rest:
        return df.select(*key).distinct()
    latest = F.max_by(F.struct(*rest), F.struct(*[c.alias(f"_{i}") for i, c in enumerate(by)]))
    return df.groupBy(*key).agg(latest.alias("_row")).select(*[F.col(c) if c in key else F.col("_row")[c].alias(c) for c in df.columns])


def drop_overridden(ticks: DataFrame, partition: tuple[str, ...] = ()) -> DataFrame:
    """Without legacy chain rows (a tx_hash, no order_hash) of which the newer source has the same trade.

    Rows of the live feed are never legacy, even where they carry a hash. One exchange by trade, which
    the merge behind it can use again.
    """
    key = [*partition, *_LEGACY_KEY]
    chain = (F.col("tx_hash") != "") & (F.coalesce(F.col("source"), F.lit("")) != "websocket")
    legacy = F.coalesce(chain & F.col("order_hash").isNull(), F.lit(False))
    newer = F.coalesce(chain & F.col("order_hash").isNotNull(), F.lit(False))
    whole = F.lit(True)
    for c in key:  # a trade with an unknown part is the same as none
        whole = whole & F.col(c).isNotNull()
    marked = ticks.withColumn("_newer", F.max(newer).over(Window.partitionBy(*key)))
    return marked.where(~(legacy & F.col("_newer") & whole)).select(*ticks.columns)


def dedup_ticks(ticks: DataFrame, order: Column | None = None, partition: tuple[str, ...] = ()) -> DataFrame:
    """Ticks after the override, merged by their seven-part key (a missing order_hash is '' and a missing receive time 0 in it)."""
    order = order if order is not None else F.struct(*WRITERS)
    df = drop_overridden(ticks, partition)
    # the key's two nullable parts compare by their stand-ins and keep their own values
    df = df.withColumns({"_k1": F.coalesce("order_hash", F.lit("")), "_k2": F.coalesce("local_recv_ts_ns", F.lit(0).cast("bigint"))})
    plain = [*partition, *[c for c in TICK_KEY if c not in ("order_hash", "local_recv_ts_ns")]]
    rest = [c for c in df.columns if c not in plain and not c.startswith("_")]
    merged = df.groupBy(*plain, "_k1", "_k2").agg(*[latest_value(c, order).alias(c) for c in rest])
    return merged.select(*[c for c in ticks.columns if not c.startswith("_")])


def dedup_orderbook(book: DataFrame, partition: tuple[str, ...] = ()) -> DataFrame:
    """The most recently received quote of each (ts_ms, market_id, token_id, outcome); equals by the greater bid, then ask."""
    key = [*partition, "ts_ms", "market_id", "token_id", "outcome"]
    recency = F.coalesce(F.col("local_recv_ts_ns"), F.col("ts_ms") * 1_000_000)
    order = F.struct(recency, "best_bid", "best_ask", "best_bid_size", "best_ask_size")
    quotes = ("best_bid", "best_ask", "best_bid_size", "best_ask_size")
    out = book.groupBy(*key).agg(*[latest_value(c, order).alias(c) for c in quotes], F.max("local_recv_ts_ns").alias("local_recv_ts_ns"))
    return out.select(*[c for c in book.columns if not c.startswith("_")])


def last_by_group(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Every column's last non-null value by group, in the order of a column."""
    return merge_columns(df, key, F.col(order))


def upsert(existing: DataFrame, new: DataFrame, key: list[str], order: list[str] | None = None) -> DataFrame:
    """New rows over existing ones of the same key; within new rows the latest by order counts."""
    both = existing.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)), allowMissingColumns=True)
    return keep_last(both, key, ["_p", *(order or [])]).drop("_p")


def distinct_keys(df: DataFrame, key: list[str]) -> DataFrame:
    return df.select(*key).distinct()
