"""Feed messages into rows: price changes, trades, books, spot updates and fills."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.relational import dimension
from .scalars import safe_double, safe_long, text_or_null

#: Units of a currency amount in a fill.
AMOUNT = 1_000_000
SPOT_CEILING = 1e9
_LEVEL = "array<struct<price:string,size:string>>"


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf")))


def valid_bbo(bid: str = "best_bid", ask: str = "best_ask", bid_size: str = "best_bid_size", ask_size: str = "best_ask_size") -> Column:
    """Both sides there, finite and above zero, at most 1, and not crossed."""
    cols = [F.col(x).cast("double") for x in (bid, ask, bid_size, ask_size)]
    ok = F.lit(True)
    for c in cols:
        ok = ok & _finite(c) & (c > 0)
    return ok & (cols[0] < cols[1]) & (cols[0] <= 1) & (cols[1] <= 1)


def parse_price_changes(messages: DataFrame, body: str = "value") -> DataFrame:
    """One row an element of price_changes with an asset_id; numbers that do not parse are null (unchanged). Other columns stay."""
    fields = ("best_bid", "best_ask", "best_bid_size", "best_ask_size")
    kind = f"struct<price_changes:array<struct<asset_id:string,{','.join(f'{f}:string' for f in fields)}>>>"
    rows = messages.withColumn("_c", F.explode(F.from_json(body, kind)["price_changes"])).where("_c.asset_id <> ''")
    return rows.select(*messages.columns, F.col("_c.asset_id").alias("asset_id"), *[safe_double(f"_c.{f}").alias(f) for f in fields])


def parse_trades(messages: DataFrame, body: str = "value") -> DataFrame:
    """Last-trade messages: time above 0, price in [0, 1]; a missing size is 0 and a missing side a buy."""
    names = ("asset_id", "timestamp", "price", "size", "amount", "side", "type_side", "hash", "tx_hash")
    m = F.from_json(body, "struct<" + ",".join(f"{n}:string" for n in names) + ">")
    df = messages.withColumn("_m", m)
    side = F.upper(F.coalesce(text_or_null("_m.side"), text_or_null("_m.type_side"), F.lit("")))
    size = safe_double(F.coalesce("_m.size", "_m.amount"))
    out = df.select(
        *messages.columns,
        F.col("_m.asset_id").alias("asset_id"),
        safe_long("_m.timestamp").alias("timestamp_ms"),
        safe_double("_m.price").alias("price"),
        F.when(size >= 0, size).otherwise(F.lit(0.0)).alias("size_shares"),
        F.when(side.isin("BUY", "SELL"), side).otherwise("BUY").alias("trade_side"),
        F.coalesce(text_or_null("_m.hash"), text_or_null("_m.tx_hash"), F.lit("")).alias("tx_hash"),
    )
    return out.where("asset_id <> '' AND timestamp_ms > 0 AND price BETWEEN 0 AND 1")


def parse_books(messages: DataFrame, body: str = "value") -> DataFrame:
    """Book snapshots: the first level of either side, 0 where there is none."""
    df = messages.withColumn("_m", F.from_json(body, f"struct<asset_id:string,bids:{_LEVEL},asks:{_LEVEL}>"))
    level = lambda side, f: F.coalesce(safe_double(F.get(F.col(f"_m.{side}"), F.lit(0))[f]), F.lit(0.0))
    return df.where("_m.asset_id <> ''").select(
        *messages.columns,
        F.col("_m.asset_id").alias("asset_id"),
        level("bids", "price").alias("best_bid"),
        level("asks", "price").alias("best_ask"),
        level("bids", "size").alias("best_bid_size"),
        level("asks", "size").alias("best_ask_size"),
    )


def parse_spot(messages: DataFrame, body: str = "value") -> DataFrame:
    """Spot updates with a symbol, a price between 0 and the ceiling, and a time; keepalives and other types are left out."""
    df = messages.withColumn("_m", F.from_json(body, "struct<type:string,topic:string,payload:struct<symbol:string,value:string,timestamp:string>>"))
    out = df.where("_m.type = 'update'").select(*messages.columns, F.coalesce("_m.topic", F.lit("")).alias("topic"), F.lower("_m.payload.symbol").alias("symbol"), safe_double("_m.payload.value").alias("price"), safe_long("_m.payload.timestamp").alias("ts_ms"))
    return out.where((F.col("symbol") != "") & (F.col("price") > 0) & (F.col("price") < SPOT_CEILING) & F.col("ts_ms").isNotNull())


def decode_fills(fills: DataFrame, tokens: DataFrame) -> DataFrame:
    """Exchange fills as ticks: the side of the maker, price and size from whole-number amounts.

    tokens: (token_id, market_id, outcome, crypto, timeframe), of equal token_ids the least row. Left out: fills without a known token or
    with two, amounts that are no positive whole numbers, and more paid than outcomes given. One side of nearly all
    fills is the currency, whose id is "0": it is never looked up, so its fills do not meet on one key.
    """
    dim = tokens.select("token_id", "market_id", "outcome", "crypto", "timeframe").where("token_id <> '0'")
    dim = dimension(dim.groupBy("token_id").agg(F.min(F.struct("market_id", "outcome", "crypto", "timeframe")).alias("_t")))
    maker, taker = F.col("makerAssetId"), F.col("takerAssetId")
    sides = fills.withColumns({"_m": F.coalesce(maker, F.lit("0")) != "0", "_k": F.coalesce(taker, F.lit("0")) != "0"})
    plain = sides.where("_m <> _k").withColumns({"_asset": F.when(F.col("_m"), maker).otherwise(taker), "_sells": F.col("_m")}).join(dim, F.col("_asset") == F.col("token_id"))
    # two ids that are no currency: the one known token counts
    left, right = (dim.select(F.col("token_id").alias(f"_{x}_id"), F.col("_t").alias(f"_{x}_t")) for x in "mk")
    swaps = sides.where("_m AND _k").join(left, maker == F.col("_m_id"), "left").join(right, taker == F.col("_k_id"), "left").where("isnull(_m_id) <> isnull(_k_id)")
    swaps = swaps.withColumns({"_asset": F.coalesce("_m_id", "_k_id"), "_sells": F.col("_m_id").isNotNull(), "token_id": F.coalesce("_m_id", "_k_id"), "_t": F.coalesce("_m_t", "_k_t")})
    df = plain.unionByName(swaps.select(*plain.columns))
    sells = F.col("_sells")
    pick = lambda name: F.col("token_id") if name == "token_id" else F.col("_t")[name]
    made, taken = (F.trim(F.col(c).cast("string")).try_cast("decimal(38,0)") for c in ("makerAmountFilled", "takerAmountFilled"))
    df = df.select("*", F.when(sells, made).otherwise(taken).alias("_shares"), F.when(sells, taken).otherwise(made).alias("_paid"), safe_long("timestamp").alias("_s"))
    df = df.where("_shares > 0 AND _paid > 0 AND _paid <= _shares AND _s IS NOT NULL")
    paid, shares = F.col("_paid").cast("double") / AMOUNT, F.col("_shares").cast("double") / AMOUNT
    return df.select(
        pick("market_id").alias("market_id"),
        pick("crypto").alias("crypto"),
        pick("timeframe").alias("timeframe"),
        (F.col("_s") * 1000).alias("timestamp_ms"),
        pick("token_id").alias("token_id"),
        pick("outcome").alias("outcome"),
        F.when(sells, "SELL").otherwise("BUY").alias("side"),
        F.bround(F.least(F.lit(1.0), F.greatest(F.lit(0.0), paid / shares)), 6).alias("price"),
        F.bround(paid, 6).alias("size_usdc"),
        F.coalesce("transactionHash", F.lit("")).alias("tx_hash"),
        F.lit(0).alias("block_number"),
        F.lit(0).alias("log_index"),
        F.lit("onchain").alias("source"),
        text_or_null("orderHash").alias("order_hash"),
    )
