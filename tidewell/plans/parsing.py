"""Texts, times, JSON and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import questions, scalars, wire
from ..functions.markets import RAW, normalize_markets
from ..sources.feeds import klines, scaled_price, second_grid
from .registry import E, Tables, query


@query("text_alias_match", "SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)\\b(?:the of|in to)\\b') THEN 'first' WHEN regexp_matches(text, '(?i)\\b(?:and)\\b') THEN 'second' END AS alias FROM documents WHERE lang = 'en'")
def text_alias_match(t: Tables):
    """The first of several choices whose phrases stand in a text."""
    return t.documents.where("lang = 'en'").select("doc_id", questions.first_match("text", {"first": ("the of", "in to"), "second": ("and",)}).alias("alias"))


_ASSETS = ["Bitcoin", "Ethereum", "solana", "XRP", "Dogecoin", "Nothing"]
_Q = "SELECT o_orderkey AS id, list_extract(['Bitcoin', 'Ethereum', 'solana', 'XRP', 'Dogecoin', 'Nothing'], CAST(o_orderkey % 6 + 1 AS INTEGER)) || ' Up or Down - March ' || (1 + o_orderkey % 28) || ', ' || (1 + o_orderkey % 12) || ':' || lpad(CAST(o_orderkey % 4 * 15 AS VARCHAR), 2, '0') || 'AM-' || (1 + o_orderkey % 12) || ':' || CASE WHEN o_orderkey % 2 = 0 THEN '15PM ET' ELSE '45AM ET' END AS question, o_orderkey % 12 + 1 AS h, o_orderkey % 4 * 15 AS m, o_orderkey % 2 AS odd FROM orders"


def question_rows(t: Tables):
    k = F.col("o_orderkey")
    hour = (1 + k % 12).cast("string")
    text = F.concat(F.element_at(F.array(*[F.lit(a) for a in _ASSETS]), (k % 6 + 1).cast("int")), F.lit(" Up or Down - March "), (1 + k % 28).cast("string"), F.lit(", "), hour, F.lit(":"), F.lpad((k % 4 * 15).cast("string"), 2, "0"), F.lit("AM-"), hour, F.lit(":"), F.when(k % 2 == 0, "15PM ET").otherwise("45AM ET"))
    return t.orders.select(k.alias("id"), text.alias("question"))


_GAP = "CASE WHEN odd = 0 THEN ((h % 12) * 60 + 735) - ((h % 12) * 60 + m) ELSE 45 - m END"
_MIN = f"CASE WHEN {_GAP} <= 0 THEN {_GAP} + 1440 ELSE {_GAP} END"


@query("time_range_parse", f"WITH q AS ({_Q}) SELECT id, CAST({_MIN} AS INTEGER) AS minutes FROM q")
def time_range_parse(t: Tables):
    return question_rows(t).select("id", questions.range_minutes("question").alias("minutes"))


@query("question_classification", f"WITH q AS ({_Q}) SELECT id, list_extract(['BTC', 'ETH', 'SOL', 'XRP', 'DOGE', NULL], CAST(id % 6 + 1 AS INTEGER)) AS asset, CASE {_MIN} WHEN 15 THEN '15-minute' WHEN 5 THEN '5-minute' WHEN 240 THEN '4-hour' ELSE '1-hour' END AS timeframe FROM q")
def question_classification(t: Tables):
    return question_rows(t).select("id", questions.extract_asset("question").alias("asset"), questions.extract_timeframe("question").alias("timeframe"))


@query("date_range_parse", "SELECT o_orderkey AS id, CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER)) * 1440 AS INTEGER) AS minutes FROM orders WHERE year(CAST(o_orderdate AS DATE) + CAST(o_orderkey % 30 AS INTEGER)) = year(o_orderdate)")
def date_range_parse(t: Tables):
    start = F.to_date("o_orderdate")
    end = F.date_add(start, (F.col("o_orderkey") % 30).cast("int"))
    text = F.concat(F.lit("from "), F.date_format(start, "MMMM d"), F.lit(" to "), F.date_format(end, "MMMM d, yyyy"))
    return t.orders.where(F.year(start) == F.year(end)).select(F.col("o_orderkey").alias("id"), questions.dates_minutes(F.regexp_replace(text, "^from ", "")).alias("minutes"))


@query("iso_parse", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN NULL WHEN o_orderkey % 5 = 1 THEN epoch(o_orderdate)::BIGINT - 7200 ELSE epoch(o_orderdate)::BIGINT END AS s FROM orders")
def iso_parse(t: Tables):
    """Times in the shapes that feeds give: Z, bare offsets, odd fractions, none, and broken."""
    k, at = F.col("o_orderkey") % 5, F.col("o_orderdate")
    text = (
        F.when(k == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
        .when(k == 1, F.date_format(at, "yyyy-MM-dd HH:mm:ss'+02'"))
        .when(k == 2, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'.6510299Z'"))
        .when(k == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss"))
        .otherwise(F.date_format(at, "yyyy/MM/dd"))
    )
    return t.orders.select(F.col("o_orderkey").alias("id"), scalars.iso_seconds(text).alias("s"))


@query("json_extract", f"{E} SELECT event_id, k, '{{\"k\":' || k || '}}' AS encoded FROM e")
def json_extract(t: Tables):
    m = F.from_json("props", "map<string,bigint>")
    return t.events.select("event_id", m["k"].alias("k"), scalars.token_json(m).alias("encoded"))


@query("json_array_zip", f"{E} SELECT event_id, 'Up' AS outcome, 'u' || k AS token FROM e UNION ALL SELECT event_id, 'Down', 'd' || k FROM e")
def json_array_zip(t: Tables):
    k = F.col("k").cast("string")
    df = t.e.select("event_id", F.lit('["Up", "Down"]').alias("names"), F.concat(F.lit('["u'), k, F.lit('", "d'), k, F.lit('"]')).alias("ids"))
    z = F.explode(F.arrays_zip(scalars.json_list("names").alias("a"), scalars.json_list("ids").alias("b")))
    return df.select("event_id", z.alias("z")).select("event_id", F.col("z.a").alias("outcome"), F.col("z.b").alias("token"))


@query("safe_numbers", "SELECT event_id, CASE WHEN event_id % 4 = 0 THEN value WHEN event_id % 4 = 1 THEN NULL WHEN event_id % 4 = 2 THEN NULL ELSE 1000.0 END AS v FROM events")
def safe_numbers(t: Tables):
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.col("value").cast("string")).when(k == 1, "NaN").when(k == 2, "abc").otherwise("1e3")
    return t.events.select("event_id", scalars.safe_double(text).alias("v"))


@query("unit_conversions", f"{E} SELECT event_id, ms // 1000 AS s, ms * 1000000 AS ns, round(value * 0.25, 4) AS amount, CASE WHEN k % 3 = 0 THEN -1 ELSE k % 2 END AS code FROM e")
def unit_conversions(t: Tables):
    return t.e.select("event_id", scalars.ms_to_s("ms").alias("s"), scalars.ms_to_ns("ms").alias("ns"), F.round(scalars.notional("value", F.lit(0.25)), 4).alias("amount"), scalars.resolution_code(F.when(F.col("k") % 3 != 0, F.col("k") % 2)).cast("int").alias("code"))


@query("symbol_maps", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'btcusdt' WHEN 1 THEN 'ethusdt' END AS exchange, CASE o_orderkey % 3 WHEN 0 THEN 'btc/usd' WHEN 1 THEN 'eth/usd' END AS oracle FROM orders")
def symbol_maps(t: Tables):
    k = F.col("o_orderkey") % 3
    df = t.orders.select(F.col("o_orderkey").alias("id"), F.when(k == 0, "BTC").when(k == 1, "ETH").otherwise("???").alias("a"))
    df = df.select("id", scalars.exchange_symbol("a").alias("exchange"))
    return df.withColumn("oracle", scalars.oracle_symbol("exchange"))


@query(
    "price_change_messages",
    f"{E} SELECT event_id, event_type AS asset_id, value / 100 AS best_bid, CASE WHEN k % 2 = 0 THEN k / 100 END AS best_ask FROM e WHERE k % 7 > 0",
)
def price_change_messages(t: Tables):
    k = F.col("k")
    change = F.struct(F.when(k % 7 > 0, F.col("event_type")).otherwise("").alias("asset_id"), (F.col("value") / 100).cast("string").alias("best_bid"), F.when(k % 2 == 0, (k / 100).cast("string")).otherwise("x").alias("best_ask"))
    messages = t.e.select("event_id", F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.array(change).alias("price_changes"))).alias("value"))
    return wire.parse_price_changes(messages).select("event_id", "asset_id", "best_bid", "best_ask")


@query("trade_messages", f"{E} SELECT event_id, user_id::VARCHAR AS asset_id, ms AS timestamp_ms, value / 50 AS price, CASE WHEN k % 3 = 0 THEN 0.0 ELSE k * 1.0 END AS size_shares, CASE WHEN k % 2 = 0 THEN 'SELL' ELSE 'BUY' END AS trade_side, '' AS tx_hash FROM e WHERE value / 50 BETWEEN 0 AND 1")
def trade_messages(t: Tables):
    k = F.col("k")
    body = F.struct(F.col("user_id").cast("string").alias("asset_id"), F.col("ms").cast("string").alias("timestamp"), (F.col("value") / 50).cast("string").alias("price"), F.when(k % 3 == 0, "-1").otherwise(k.cast("string")).alias("size"), F.when(k % 2 == 0, "sell").otherwise("hold").alias("side"))
    return wire.parse_trades(t.e.select("event_id", F.to_json(body).alias("value"))).drop("value")


@query("book_messages", f"{E} SELECT event_id, event_type AS asset_id, value / 200 AS best_bid, CASE WHEN k % 2 = 0 THEN 0.0 ELSE 0.9 END AS best_ask, k * 1.0::DOUBLE AS best_bid_size, CASE WHEN k % 2 = 0 THEN 0.0 ELSE 2.0 END AS best_ask_size FROM e")
def book_messages(t: Tables):
    level = lambda p, s: F.struct(p.cast("string").alias("price"), s.cast("string").alias("size"))
    bids = F.array(level(F.col("value") / 200, F.col("k")), level(F.lit(0.01), F.lit(1)))
    asks = F.when(F.col("k") % 2 == 0, F.array().cast("array<struct<price:string,size:string>>")).otherwise(F.array(level(F.lit(0.9), F.lit(2))))
    messages = t.e.select("event_id", F.to_json(F.struct(F.col("event_type").alias("asset_id"), bids.alias("bids"), asks.alias("asks"))).alias("value"))
    return wire.parse_books(messages).drop("value")


@query("spot_messages", f"{E} SELECT event_id, 'crypto' AS topic, 'btcusdt' AS symbol, value AS price, ms AS ts_ms FROM e WHERE value > 0 AND k % 5 > 0")
def spot_messages(t: Tables):
    body = F.struct(F.when(F.col("k") % 5 > 0, "update").otherwise("subscribed").alias("type"), F.lit("crypto").alias("topic"), F.struct(F.lit("BTCUSDT").alias("symbol"), F.col("value"), F.col("ms").alias("timestamp")).alias("payload"))
    return wire.parse_spot(t.e.select("event_id", F.to_json(body).alias("value"))).drop("value")


@query("bbo_validity", f"{E}, b AS (SELECT event_id, CASE k % 6 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE value / 100 END AS bid, CASE k % 5 WHEN 0 THEN NULL ELSE 0.6 END AS ask FROM e) SELECT event_id FROM b WHERE bid IS NOT NULL AND isfinite(bid) AND ask IS NOT NULL AND bid > 0 AND bid < ask AND bid <= 1")
def bbo_validity(t: Tables):
    k = F.col("k")
    df = t.e.select("event_id", F.when(k % 6 == 0, F.lit(float("nan"))).when(k % 6 == 1, F.lit(float("inf"))).otherwise(F.col("value") / 100).alias("best_bid"), F.when(k % 5 != 0, F.lit(0.6)).alias("best_ask"), F.lit(1.0).alias("best_bid_size"), F.lit(1.0).alias("best_ask_size"))
    return df.where(wire.valid_bbo()).select("event_id")


@query(
    "fill_decode",
    """WITH f AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_linenumber % 2 = 0 AS sells, CAST(round(l_extendedprice * 100) AS BIGINT) AS shares, CAST(round(l_extendedprice * 100 * (1 - l_discount * 12)) AS BIGINT) AS paid FROM lineitem)
SELECT l_orderkey, l_linenumber, 'm' || (l_suppkey % 10) AS market_id, CASE WHEN sells THEN 'SELL' ELSE 'BUY' END AS side, round(paid / shares, 6) AS price, round(paid / 1000000, 6) AS size_usdc FROM f WHERE paid > 0 AND shares > 0 AND paid <= shares AND l_suppkey % 3 > 0""",
)
def fill_decode(t: Tables):
    sells = F.col("l_linenumber") % 2 == 0
    token = F.concat(F.lit("T"), F.col("l_suppkey").cast("string"))
    shares = F.round(F.col("l_extendedprice") * 100).cast("bigint").cast("string")
    paid = F.round(F.col("l_extendedprice") * 100 * (1 - F.col("l_discount") * 12)).cast("bigint").cast("string")
    fills = t.lineitem.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("transactionHash"), F.lit("1700000000").alias("timestamp"), F.lit("").alias("orderHash"), F.when(sells, token).otherwise("0").alias("makerAssetId"), F.when(sells, "0").otherwise(token).alias("takerAssetId"), F.when(sells, shares).otherwise(paid).alias("makerAmountFilled"), F.when(sells, paid).otherwise(shares).alias("takerAmountFilled"))
    s = F.col("s_suppkey")
    tokens = t.supplier.where("s_suppkey % 3 > 0").select(F.concat(F.lit("T"), s.cast("string")).alias("token_id"), F.concat(F.lit("m"), (s % 10).cast("string")).alias("market_id"), F.lit("Up").alias("outcome"), F.lit("BTC").alias("crypto"), F.lit("1-hour").alias("timeframe"))
    out = wire.decode_fills(fills, tokens)
    key = F.split("tx_hash", "-")
    return out.select(key[0].cast("bigint").alias("l_orderkey"), key[1].cast("int").alias("l_linenumber"), "market_id", "side", "price", "size_usdc")


@query(
    "market_normalization",
    "SELECT CAST(o_orderkey AS VARCHAR) AS market_id, list_extract(['BTC', 'ETH', 'SOL', 'XRP', 'DOGE'], CAST(o_orderkey % 6 + 1 AS INTEGER)) AS crypto, '1-hour' AS timeframe, epoch(o_orderdate)::BIGINT AS start_ts, epoch(o_orderdate)::BIGINT + 3600 AS end_ts, CASE WHEN o_orderkey % 2 = 0 THEN CASE WHEN o_orderkey % 4 = 0 THEN 1 ELSE 0 END END::INTEGER AS resolution, 'u' || o_orderkey AS up_token_id, 'd' || o_orderkey AS down_token_id FROM orders WHERE o_orderkey % 6 < 5 AND o_orderkey % 11 > 0",
)
def market_normalization(t: Tables):
    k = F.col("o_orderkey")
    key, start = k.cast("string"), F.col("o_orderdate")
    quote = lambda a, b: F.concat(F.lit('["'), a, F.lit('", "'), b, F.lit('"]'))
    raw = {
        "id": key,
        "question": F.concat(F.element_at(F.array(*[F.lit(a) for a in _ASSETS]), (k % 6 + 1).cast("int")), F.lit(" Up or Down hourly")),
        "startDate": F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'"),
        "endDate": F.when(k % 11 == 0, F.date_format(start, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(start + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        "closed": k % 2 == 0,
        "outcomes": F.lit('["Up", "Down"]'),
        "clobTokenIds": quote(F.concat(F.lit("u"), key), F.concat(F.lit("d"), key)),
        "outcomePrices": F.when(k % 4 == 0, quote(F.lit("0.995"), F.lit("0.005"))).otherwise(quote(F.lit("0"), F.lit("1"))),
    }
    empty = t.spark.createDataFrame([], RAW)
    df = t.orders.select(*[raw[f.name].alias(f.name) if f.name in raw else F.lit(None).cast(f.dataType).alias(f.name) for f in empty.schema.fields])
    return normalize_markets(df).select("market_id", "crypto", "timeframe", "start_ts", "end_ts", F.col("resolution").cast("int").alias("resolution"), "up_token_id", "down_token_id")


@query("kline_closes", f"{E} SELECT ms + 59999 AS ts_ms, 'btcusdt' AS symbol, value AS price, 'binance' AS source FROM e WHERE value > 0")
def kline_closes(t: Tables):
    text = lambda c: c.cast("string")
    row = F.array(text(F.col("ms")), F.lit("0"), F.lit("0"), F.lit("0"), text(F.col("value")), F.lit("0"), text(F.col("ms") + 59999))
    return klines(t.e.select(row.alias("kline")), "BTCUSDT")


@query("second_grid", "WITH m AS (SELECT CAST(o_orderkey AS VARCHAR) AS market_id, epoch(o_orderdate)::BIGINT AS end_ts, o_orderkey % 2 AS odd FROM orders WHERE o_orderkey < 200) SELECT market_id, unnest(generate_series(end_ts - CASE WHEN odd = 0 THEN 30 ELSE 60 END, end_ts)) AS ts, 2.5 AS price FROM m")
def grid(t: Tables):
    """Every second of a market's last stretch, with a scaled price."""
    k = F.col("o_orderkey")
    m = t.orders.where("o_orderkey < 200").select(k.cast("string").alias("market_id"), F.lit("BTC").alias("crypto"), F.when(k % 2 == 0, "short").otherwise("long").alias("timeframe"), F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("end_ts"))
    return second_grid(m, {"short": 30, "long": 60}).withColumns({"p": F.lit(25), "expo": F.lit(-1)}).select("market_id", "ts", F.round(scaled_price("p"), 9).alias("price"))
