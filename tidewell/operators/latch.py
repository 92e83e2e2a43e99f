"""State that messages update in part, as windows over a recorded stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.wire import valid_bbo

QUOTES = ("best_bid", "best_ask", "best_bid_size", "best_ask_size")


def latch_quotes(updates: DataFrame, key: str = "token_id", order: tuple[str, ...] = ("local_recv_ts_ns",), snapshot: str = "is_snapshot", category: str | None = None) -> DataFrame:
    """The book's top behind every update, where it is valid.

    A snapshot sets all four numbers (missing ones to 0), a change only those it has; before
    the first message all are 0. Invalid states are remembered but give no row. With a category column, only
    crypto rows give rows, and changes of others change nothing.
    """
    if category:
        updates = updates.where(F.col(snapshot) | (F.col(category) == "crypto"))
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    put = {q: F.when(F.col(snapshot), F.coalesce(q, F.lit(0.0))).otherwise(F.col(q)) for q in QUOTES}
    state = updates.withColumns(put).withColumns({q: F.coalesce(F.last(q, ignorenulls=True).over(so_far), F.lit(0.0)) for q in QUOTES})
    out = state.where(valid_bbo())
    return out.where(F.col(category) == "crypto") if category else out


def latch_trades(trades: DataFrame, key: str = "market_id", order: tuple[str, ...] = ("local_recv_ts_ns",), side: str = "outcome", price: str = "price", default: float = 0.5) -> DataFrame:
    """Behind every trade the latest price of both sides; a side without a trade yet has the default."""
    so_far = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = lambda s: F.coalesce(F.last(F.when(F.lower(side) == s, F.col(price)), ignorenulls=True).over(so_far), F.lit(default))
    return trades.withColumns({"up_price": last("up"), "down_price": last("down")})


def latest_prices(prices: DataFrame, key: list[str], ts: str = "timestamp") -> DataFrame:
    """The last row of each series."""
    rest = [c for c in prices.columns if c not in key]
    return prices.groupBy(*key).agg(F.max_by(F.struct(*rest), ts).alias("_r")).select(*key, "_r.*")


def heartbeat_ages(beats: DataFrame, key: list[str], ts: str, now_ms: int) -> DataFrame:
    """Milliseconds since each series was last seen, -1 if it never was (a null time)."""
    return beats.groupBy(*key).agg(F.coalesce(F.lit(now_ms) - F.max(ts), F.lit(-1)).cast("bigint").alias("last_event_age_ms"))


def stale(ages: DataFrame, thresholds: dict[str, int], name: str = "source", started_ms: int = 0, now_ms: int = 0, grace_ms: int = 0) -> DataFrame:
    """Series above their threshold, once the grace after the start is over; one that was never seen is as old as can be."""
    limit = F.coalesce(*[F.when(F.col(name) == k, F.lit(v)) for k, v in thresholds.items()], F.lit(None).cast("int"))
    age = F.when(F.col("last_event_age_ms") < 0, F.lit(9223372036854775807)).otherwise(F.col("last_event_age_ms"))
    return ages.where((F.lit(now_ms - started_ms) > grace_ms) & (age > limit))
