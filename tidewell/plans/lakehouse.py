"""The lakehouse end to end: loaders, consolidations, logs, feeds and streams, each checked against the rows it began with."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..catalog import load_culture_markets, load_markets, load_prices, load_ticks_for_market, market_records, query as adhoc, spot_lookup
from ..functions.markets import event_slug, split_categories
from ..operators.quality import audit
from ..schemas import CULTURE_MARKETS, CULTURE_PRICES, HEARTBEATS, ORDERBOOK, PRICES, SPOT_PRICES, TICKS
from ..session import scratch
from ..sources import feeds
from ..sources.hive import canonical
from ..sources.live import live_messages
from ..sources.logs import failed_windows, heartbeats, match_failed, reconnects
from ..storage.consolidate import compact, consolidate_heartbeats, consolidate_orderbook, consolidate_prices, consolidate_ticks, load_checkpoint, publish, save_checkpoint
from ..storage.consolidate import _ticks as fold_ticks
from ..storage.writers import append_staged, append_ticks_only, copy_to, persist, persist_ticks, replace_partitions, schema_version, split_culture, split_markets_prices
from ..streaming.pipelines import replay, route, run_to_table, session_counts, sliding, stage_stream, subscriptions
from ..streaming.stateful import burst_alerts
from .registry import E, Tables, query
from .series import HOUR
from .stores import _EVENTS

_ROWS = f"{E}, t AS (SELECT event_type AS crypto, CASE WHEN k % 2 = 0 THEN '1-hour' ELSE '4-hour' END AS timeframe, 'm' || (user_id % 30) AS market_id, ms, ms // {HOUR} * {HOUR} AS hour_ms, event_id, value, k, user_id FROM e)"


def _rows(t: Tables):
    crypto, market = F.col("event_type").alias("crypto"), F.concat(F.lit("m"), (F.col("user_id") % 30).cast("string")).alias("market_id")
    return t.e.select(crypto, F.when(F.col("k") % 2 == 0, "1-hour").otherwise("4-hour").alias("timeframe"), market, "ms", F.expr(f"ms div {HOUR} * {HOUR}").alias("hour_ms"), "event_id", "value", "k", "user_id")


def _as_ticks(df, ts: str = "ms", *more: str):
    return df.select(*more, "crypto", "timeframe", "market_id", F.col(ts).alias("timestamp_ms"), F.col("event_id").cast("string").alias("token_id"), F.lit("websocket").alias("source"), F.col("value").alias("price"))


@query("ticks_of_market", f"{_ROWS} SELECT ms AS timestamp_ms, CAST(event_id AS VARCHAR) AS token_id FROM t WHERE market_id = 'm7' AND timeframe = '1-hour' AND crypto = 'click'")
def ticks_of_market(t: Tables):
    """One market's ticks from its partition."""
    root = scratch(t.spark, "market-ticks")
    persist_ticks(_as_ticks(_rows(t)), root)
    return load_ticks_for_market(t.spark, f"{root}/ticks", "m7", crypto="click", timeframe="1-hour").select("timestamp_ms", "token_id")


@query("compacted_ticks", f"{_ROWS} SELECT crypto, timeframe, market_id, hour_ms AS timestamp_ms, arg_max(CAST(value AS FLOAT), (k >= 30, k >= 60, event_id))::DOUBLE AS price FROM t GROUP BY ALL")
def compacted_ticks(t: Tables):
    """Three passes make parts with rows of the same key; compaction folds them."""
    root = scratch(t.spark, "compaction")
    rows = _rows(t)
    for part in ("k < 30", "k >= 30 AND k < 60", "k >= 60"):
        some = rows.where(part).withColumns({"at": F.col("event_id"), "event_id": F.lit("t")})
        append_ticks_only(_as_ticks(some, "hour_ms", "at"), root, ["at"])
        consolidate_ticks(t.spark, root, compact_at=1000)
    compact(t.spark, root, TICKS, fold_ticks, 2)
    return t.spark.read.parquet(f"{root}/ticks").select("crypto", "timeframe", "market_id", "timestamp_ms", F.col("price").cast("double").alias("price"))


@query(
    "consolidated_orderbook",
    f"{_ROWS} SELECT crypto, timeframe, market_id, hour_ms AS ts_ms, arg_max(k, (event_id, k))::DOUBLE AS best_bid, max(event_id) AS local_recv_ts_ns FROM t GROUP BY ALL",
)
def consolidated_orderbook(t: Tables):
    """Quotes of two appends, of which the most recently received stays."""
    root = scratch(t.spark, "orderbook")
    book = _rows(t).select("crypto", "timeframe", "market_id", F.col("hour_ms").alias("ts_ms"), F.lit("t").alias("token_id"), F.lit("Up").alias("outcome"), F.col("k").alias("best_bid"), F.lit(1.0).alias("best_ask"), F.lit(1.0).alias("best_bid_size"), F.lit(1.0).alias("best_ask_size"), F.col("event_id").alias("local_recv_ts_ns"))
    for part in ("best_bid >= 50", "best_bid < 50"):
        append_staged(book.where(part), root, ORDERBOOK)
    consolidate_orderbook(t.spark, root)
    return t.spark.read.parquet(f"{root}/orderbook").select("crypto", "timeframe", "market_id", "ts_ms", F.col("best_bid").cast("double").alias("best_bid"), "local_recv_ts_ns")


@query("consolidated_heartbeats", f"{E} SELECT ms // 60000 AS ts_ms, event_type AS source, 'u' || (user_id % 3) AS shard_key, max(k >= 50)::INT AS again FROM e GROUP BY 1, 2, 3")
def consolidated_heartbeats(t: Tables):
    """Two appends; of one key the later writer's row stays."""
    root = scratch(t.spark, "beats")
    beats = t.e.select(F.expr("ms div 60000").alias("ts_ms"), F.col("event_type").alias("source"), F.concat(F.lit("u"), (F.col("user_id") % 3).cast("string")).alias("shard_key"), "k")
    for i, part in enumerate(("k < 50", "k >= 50")):
        append_staged(beats.where(part).drop("k").withColumns({"event_type": F.lit("x"), "last_event_age_ms": F.lit(i)}), root, HEARTBEATS)
        consolidate_heartbeats(t.spark, root)
    return heartbeats(t.spark, f"{root}/heartbeats").select("ts_ms", "source", "shard_key", F.col("last_event_age_ms").cast("int").alias("again"))


def _culture(t: Tables):
    return _rows(t).select("market_id", (F.col("hour_ms") / 1000).cast("bigint").alias("timestamp"), F.concat(F.lit("t"), (F.col("k") % 3).cast("string")).alias("token_id"), F.concat((F.col("k") % 3).cast("string"), F.lit("0+")).alias("outcome"), (F.col("k") / 128).alias("price"), "crypto", "timeframe", "k")


_CULTURE = f"{_ROWS} SELECT crypto, timeframe, market_id, hour_ms // 1000 AS timestamp, (k % 3) || '0+' AS outcome, max(k) / 128 AS price FROM t GROUP BY ALL"


@query("consolidated_culture", _CULTURE)
def consolidated_culture(t: Tables):
    """Staged multi-outcome prices, of which the later append's stay."""
    root = scratch(t.spark, "culture")
    most = _culture(t).groupBy("crypto", "timeframe", "market_id", "timestamp", "token_id", "outcome").agg(F.min("price").alias("low"), F.max("price").alias("price"))
    append_staged(most.drop("price").withColumnRenamed("low", "price"), root, CULTURE_PRICES)
    append_staged(most.drop("low"), root, CULTURE_PRICES)
    consolidate_prices(t.spark, root, culture=True)
    return t.spark.read.parquet(f"{root}/prices").select("crypto", "timeframe", "market_id", "timestamp", "outcome", F.col("price").cast("double").alias("price"))


@query("persisted_culture", _CULTURE)
def persisted_culture(t: Tables):
    """Collected multi-outcome rows, split and merged into the two tables."""
    root = scratch(t.spark, "culture-merge")
    flat = _culture(t).groupBy("crypto", "timeframe", "market_id", "timestamp", "token_id", "outcome").agg(F.max("price").alias("price")).withColumn("question", F.lit("q"))
    markets, prices = split_culture(flat)
    persist(markets, prices, root, culture=True)
    return t.spark.read.parquet(f"{root}/prices").select("crypto", "timeframe", "market_id", "timestamp", "outcome", F.col("price").cast("double").alias("price"))


@query("split_market_table", f"{_ROWS} SELECT market_id, arg_max(crypto, (ms, event_id)) AS crypto, arg_max(CASE WHEN k % 3 > 0 THEN 's' || k END, (ms, event_id)) FILTER (k % 3 > 0) AS slug FROM t GROUP BY 1")
def split_market_table(t: Tables):
    """Collected rows as a market table with the last known value of every column."""
    order = F.struct("ms", "event_id")
    flat = _rows(t).select("market_id", "crypto", "timeframe", F.when(F.col("k") % 3 > 0, F.concat(F.lit("s"), F.col("k").cast("string"))).alias("slug"), order.alias("at"), F.lit(0.5).alias("up_price"))
    markets, _ = split_markets_prices(flat, "at")
    return markets.select("market_id", "crypto", "slug")


@query("pruned_prices", f"{_ROWS} SELECT crypto, market_id, hour_ms AS timestamp FROM t WHERE timeframe = '4-hour' AND crypto IN ('click', 'view') GROUP BY ALL")
def pruned_prices(t: Tables):
    """A filter on the partition columns of a partitioned table: other partitions are not listed for the scan."""
    root = scratch(t.spark, "pruned")
    rows = _rows(t).select("crypto", "timeframe", "market_id", F.col("hour_ms").alias("timestamp"), F.lit(0.5).cast("float").alias("up_price"), F.lit(0.5).cast("float").alias("down_price")).distinct()
    replace_partitions(rows, f"{root}/prices", PRICES, ["market_id", "timestamp"])
    return load_prices(t.spark, f"{root}/prices", [("timeframe", "=", "4-hour"), ("crypto", "in", ["click", "view"])]).select("crypto", "market_id", "timestamp")


def _stored_markets(t: Tables) -> str:
    path = f"{scratch(t.spark, 'markets')}/markets.parquet"
    k = F.col("o_orderkey")
    raw = t.orders.select(k.cast("string").alias("market_id"), F.when(k % 2 == 0, "BTC").otherwise("ETH").alias("crypto"), F.when(k % 3 == 0, "1-hour").otherwise("4-hour").alias("timeframe"), F.when(k % 5 > 0, k % 2).alias("resolution"), F.when(k % 7 > 0, k * 10).alias("end_ts"), F.when(k % 4 > 0, F.concat(F.lit("s"), k.cast("string"))).alias("slug"))
    copy_to(raw, path)
    return path


@query("typed_markets", "SELECT CAST(o_orderkey AS VARCHAR) AS market_id, CASE WHEN o_orderkey % 5 > 0 THEN o_orderkey % 2 ELSE -1 END::INT AS resolution, CASE WHEN o_orderkey % 7 > 0 THEN o_orderkey * 10 ELSE 0 END AS end_ts, CASE WHEN o_orderkey % 4 > 0 THEN 's' || o_orderkey ELSE '' END AS slug, -1 AS fee_rate_bps FROM orders")
def typed_markets(t: Tables):
    """Stored markets in the table's types, with defaults for nulls and columns that the file lacks."""
    df = load_markets(t.spark, _stored_markets(t))
    return df.select("market_id", F.col("resolution").cast("int").alias("resolution"), "end_ts", "slug", F.col("fee_rate_bps").cast("int").alias("fee_rate_bps"))


@query("typed_culture_markets", "SELECT CAST(o_orderkey AS VARCHAR) AS market_id, '{}' AS tokens, -1 AS bucket_index, '' AS event_slug FROM orders")
def typed_culture_markets(t: Tables):
    return load_culture_markets(t.spark, _stored_markets(t)).select("market_id", "tokens", "bucket_index", "event_slug")


@query("wanted_markets", "SELECT CAST(o_orderkey AS VARCHAR) AS market_id, '' AS question FROM orders WHERE o_orderkey % 2 = 0 AND o_orderkey % 3 = 0")
def wanted_markets(t: Tables):
    """Market records as collectors take them."""
    return market_records(t.spark, _stored_markets(t), crypto=["BTC"], timeframe=["1-hour"]).select("market_id", "question")


@query("spot_table", f"{E} SELECT upper(event_type) AS crypto, ms AS ts_ms, value AS price FROM e WHERE k % 2 = 0 AND k % 3 > 0")
def spot_table(t: Tables):
    """Prices of the dollar-pegged pairs of one exchange."""
    root = scratch(t.spark, "spot-table")
    spots = t.e.select(F.col("ms").alias("ts_ms"), F.concat("event_type", F.when(F.col("k") % 3 > 0, "usdt").otherwise("eur")).alias("symbol"), F.col("value").alias("price"), F.when(F.col("k") % 2 == 0, "binance").otherwise("chainlink").alias("source"))
    canonical(spots, SPOT_PRICES).write.parquet(f"{root}/spot_prices")
    return spot_lookup(t.spark, f"{root}/spot_prices")


@query("reconnect_lines", f"{E} SELECT ms / 1000 AS ts, event_type AS shard_key FROM e WHERE k % 5 > 0 AND k % 7 > 0")
def reconnect_lines(t: Tables):
    """A line-wise log with its rotated part; broken, timeless and keyless lines are left out."""
    root = scratch(t.spark, "logs")
    line = F.to_json(F.struct((F.col("ms") / 1000).alias("ts"), F.when(F.col("k") % 7 > 0, F.col("event_type")).otherwise("").alias("shard_key")))
    text = t.e.select(F.when(F.col("k") % 5 > 0, line).otherwise(F.lit("{broken")).alias("value"), "k")
    text.where("k < 50").select("value").write.text(f"{root}/ws_reconnects.jsonl")
    text.where("k >= 50").select("value").write.text(f"{root}/ws_reconnects.jsonl.1")
    return reconnects(t.spark, root).select("ts", "shard_key")


@query("failed_window_scan", f"{E}, w AS (SELECT DISTINCT k // 10 * 100 AS window_start, k // 10 * 100 + 50 AS window_end FROM e WHERE k % 3 = 0) SELECT *, window_start % 200 = 0 AS matched FROM w")
def failed_window_scan(t: Tables):
    """Windows that a text log calls failed, with those that a market has."""
    root = scratch(t.spark, "log-text")
    start = (F.floor(F.col("k") / 10) * 100).cast("string")
    end = (F.floor(F.col("k") / 10) * 100 + 50).cast("string")
    state = F.when(F.col("k") % 3 == 0, "failed: x").otherwise("done")
    t.e.select(F.concat(F.lit("INFO Window ["), start, F.lit(", "), end, F.lit("] "), state).alias("value")).write.text(f"{root}/log")
    windows = t.spark.range(0, 20).select((F.col("id") * 200).alias("window_start"), (F.col("id") * 200 + 50).alias("window_end"))
    return match_failed(windows, failed_windows(t.spark, f"{root}/log"))


@query("audit_window", f"{E} SELECT min(ms) FILTER (ms > 0) AS first_ms, max(ms) AS last_ms, count(*) AS n_rows FROM e")
def audit_window(t: Tables):
    beats = t.e.select(F.col("ms").alias("ts_ms"), F.col("event_type").alias("source"), F.lit("s").alias("shard_key"), F.lit("x").alias("event_type"))
    lines = t.e.select((F.col("ms") / 1000).alias("ts"), F.lit("s").alias("shard_key"))
    return audit(beats, lines)["window"]


@query("category_routing", f"{E} SELECT CASE WHEN k % 3 = 1 THEN 'culture' ELSE 'crypto' END AS routed, count(*) AS n FROM e GROUP BY 1")
def category_routing(t: Tables):
    """Rows by category; without one they are crypto."""
    crypto, culture = split_categories(t.e.withColumn("category", F.when(F.col("k") % 3 == 1, "culture").when(F.col("k") % 3 == 2, "crypto")))
    both = crypto.select(F.lit("crypto").alias("routed")).unionAll(culture.select(F.lit("culture").alias("routed")))
    return both.groupBy("routed").agg(F.count("*").alias("n"))


@query("event_slugs", "SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'tweets-' || o_orderkey WHEN 1 THEN 'tweets-' || o_orderkey || '-other' ELSE 'tweets-' || o_orderkey || '-240-plus' END AS event_slug FROM orders")
def event_slugs(t: Tables):
    """Slugs without the bucket that stands at their end."""
    k = F.col("o_orderkey")
    label = F.when(k % 3 < 2, "240+")
    slug = F.concat(F.lit("tweets-"), k.cast("string"), F.when(k % 3 == 1, "-other").otherwise("-240-plus"))
    return t.orders.select(k.alias("id"), label.alias("bucket_label"), slug.alias("slug")).select("id", event_slug().alias("event_slug"))


@query("limited_sql", "SELECT count(*) AS n FROM (SELECT * FROM events LIMIT 37)")
def limited_sql(t: Tables):
    """Ad-hoc SQL of which a number of rows is asked for."""
    t.events.createOrReplaceTempView("some_events")
    return adhoc(t.spark, "SELECT * FROM some_events", limit=37).agg(F.count("*").alias("n"))


def _listing(request: dict) -> list[dict]:
    data = [{"id": f"{i:04d}", "closedTime": None, "body": request["tag"]} for i in range(request["from"], request["to"])]
    return data[request["offset"] : request["offset"] + request["limit"]]


@query("first_listing_wins", "SELECT printf('%04d', i) AS id, CASE WHEN i < 700 THEN 'a' ELSE 'b' END AS body FROM range(0, 1200) r(i)")
def first_listing_wins(t: Tables):
    """Two paged listings with markets in common."""
    return feeds.read_markets(t.spark, _listing, [{"tag": "a", "from": 0, "to": 700}, {"tag": "b", "from": 300, "to": 1200}]).select("id", "body")


def _history(request: dict) -> list[dict]:
    return [{"token_id": request["token_id"], "t": at, "p": at % 130 / 100} for at in range(request["start"] - request["start"] % 60 + 60, request["end"] + 1, 60)]


@query("price_history", "SELECT 't' || k AS token_id, i * 60 AS t, (i * 60 % 130) / 100 AS p FROM range(0, 3) a(k), range(1, 10001) b(i) WHERE i * 60 % 130 <= 100")
def price_history(t: Tables):
    """Points of three tokens in chunks of a week, without prices beyond 1."""
    return feeds.read_price_history(t.spark, _history, [{"token_id": f"t{k}", "start": 0, "end": 600_000} for k in range(3)])


def _page(request: dict) -> list[dict]:
    return [{"id": f"{i:05d}", "n": i} for i in range(2500) if f"{i:05d}" > request["id_gt"]][: request["first"]]


@query("cursor_feed", "SELECT printf('%05d', i) AS id, i AS n FROM range(0, 2500) r(i)")
def cursor_feed(t: Tables):
    return feeds.read_feed(t.spark, "cursor_query", "id string, n bigint", _page, [{}], "cursor")


def _fee(request: dict) -> dict | None:
    n = int(request["token_id"])
    return None if n % 3 == 0 else {"base_fee": n * 10} if n % 3 == 1 else {"base_fee": "none"}


def _trade(request: dict) -> dict:
    n = int(request["token_id"])
    return {"price": str(n / 40), "side": "buy" if n % 2 else "sell"}


@query("fee_rates", "SELECT CAST(i AS VARCHAR) AS token_id, i * 10 AS fee_rate_bps FROM range(0, 50) r(i) WHERE i % 3 = 1")
def fee_rates(t: Tables):
    """A lookup a token; missing and broken answers are left out."""
    return feeds.read_fee_rates(t.spark, _fee, [str(i) for i in range(50)])


@query("last_trades", "SELECT CAST(i AS VARCHAR) AS token_id, i / 40 AS price, CASE WHEN i % 2 = 1 THEN 'BUY' ELSE 'SELL' END AS side FROM range(0, 41) r(i)")
def last_trades(t: Tables):
    return feeds.read_last_trades(t.spark, _trade, [str(i) for i in range(50)])


@query("subscription_shards", "SELECT (row_number() OVER (ORDER BY CAST(c_custkey AS VARCHAR)) - 1) // 500 AS shard, CAST(c_custkey AS VARCHAR) AS token_id FROM customer")
def subscription_shards(t: Tables):
    """Tokens in the lists that one connection each subscribes to."""
    return subscriptions(t.customer.select(F.col("c_custkey").cast("string").alias("token_id"))).select(F.col("shard").cast("bigint").alias("shard"), F.explode("tokens").alias("token_id"))


@query("routed_messages", f"{E} SELECT CASE k % 3 WHEN 0 THEN 'books' WHEN 1 THEN 'changes' ELSE 'spot' END AS kind, CAST(event_id AS VARCHAR) AS name FROM e")
def routed_messages(t: Tables):
    """Messages of one socket by their kind."""
    name = F.col("event_id").cast("string")
    empty = F.array().cast("array<struct<price:string,size:string>>")
    book = F.to_json(F.array(F.struct(name.alias("asset_id"), empty.alias("bids"), empty.alias("asks"))))
    change = F.to_json(F.struct(F.lit("price_change").alias("event_type"), F.array(F.struct(name.alias("asset_id"), F.lit("0.5").alias("best_bid"))).alias("price_changes")))
    spot = F.to_json(F.struct(F.lit("update").alias("type"), F.lit("c").alias("topic"), F.struct(name.alias("symbol"), F.lit(1.5).alias("value"), F.col("ms").alias("timestamp")).alias("payload")))
    parts = route(t.e.select(F.when(F.col("k") % 3 == 0, book).when(F.col("k") % 3 == 1, change).otherwise(spot).alias("value")))
    named = [parts[kind].select(F.lit(kind).alias("kind"), F.col(column).alias("name")) for kind, column in (("books", "asset_id"), ("changes", "asset_id"), ("trades", "asset_id"), ("spot", "symbol"))]
    out = named[0]
    for part in named[1:]:
        out = out.unionByName(part)
    return out


def _poll(tokens: list, batch: int) -> list[str]:
    return [f'{{"event_type": "price_change", "price_changes": [{{"asset_id": "{t}", "best_bid": "{(batch + 1) / 8}"}}]}}' for t in tokens]


@query("live_feed", "SELECT b // 8 AS shard, 't' || b AS asset_id, (a + 1) / 8 AS best_bid FROM range(0, 4) x(a), range(0, 24) y(b)")
def live_feed(t: Tables):
    """A live feed with a connection each for lists of eight tokens, routed and written batch by batch."""
    root = scratch(t.spark, "live")
    tokens = t.spark.range(24).select(F.concat(F.lit("t"), F.lpad(F.col("id").cast("string"), 2, "0")).alias("token_id"))
    lists = [[x.replace("t0", "t") for x in r.tokens] for r in subscriptions(tokens, 8).orderBy("shard").collect()]
    changes = route(live_messages(t.spark, "live_query", _poll, lists, 4))["changes"]
    return run_to_table(changes, f"{root}/out", f"{root}/checkpoint").select(F.col("shard").cast("bigint").alias("shard"), "asset_id", "best_bid")


@query("staged_batches", f"{E} SELECT CAST(event_id AS VARCHAR) AS token_id, ms AS timestamp_ms FROM e")
def staged_batches(t: Tables):
    """A stream staged batch by batch, started a second time from the beginning: nothing is there twice."""
    root = scratch(t.spark, "staged")
    t.e.select(F.lit("m").alias("market_id"), F.lit("BTC").alias("crypto"), F.lit("1-hour").alias("timeframe"), F.col("ms").alias("timestamp_ms"), F.col("event_id").cast("string").alias("token_id"), F.col("value").alias("price"), F.lit("websocket").alias("source")).write.parquet(f"{root}/in")
    schema = t.spark.read.parquet(f"{root}/in").schema
    for again in (1, 2):
        stream = t.spark.readStream.schema(schema).parquet(f"{root}/in")
        stage_stream(stream, root, TICKS, f"{root}/checkpoint-{again}", once=True, name="trades").awaitTermination()
    return t.spark.read.parquet(f"{root}/_staging/ticks").select("token_id", "timestamp_ms")


@query("sliding_stream", f"{E}, w AS (SELECT ms // {6 * HOUR} - unnest([0, 1]) AS i, event_type FROM e) SELECT epoch_ms(i * {6 * HOUR}) AS window_start, event_type, count(*) AS n FROM w GROUP BY ALL")
def sliding_stream(t: Tables):
    """Windows of twelve hours, every six."""
    root = scratch(t.spark, "sliding")
    out = run_to_table(sliding(replay(t.spark, f"{t.folder}/events.parquet", _EVENTS, "ts"), "ts", "12 hours", "6 hours", ["event_type"]), f"{root}/out", f"{root}/checkpoint", "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n")


@query(
    "session_stream",
    f"{E}, g AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) < {HOUR} THEN 0 ELSE 1 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ms RANGE UNBOUNDED PRECEDING) AS i FROM g) SELECT user_id, min(ms) AS start_ms, max(ms) + {HOUR} AS end_ms, count(*) AS n FROM s GROUP BY user_id, i",
)
def session_stream(t: Tables):
    """Sessions that an hour without an event ends."""
    root = scratch(t.spark, "sessions")
    stream = replay(t.spark, f"{t.folder}/events.parquet", _EVENTS, "ts").withColumn("ts", F.timestamp_millis(F.unix_millis("ts")))
    out = run_to_table(session_counts(stream, "ts", "1 hour", ["user_id"]), f"{root}/out", f"{root}/checkpoint", "complete")
    return out.select("user_id", F.unix_millis("session_start").alias("start_ms"), F.unix_millis("session_end").alias("end_ms"), "n")


@query(
    "burst_stream",
    f"{E}, r AS (SELECT event_type AS shard_key, ms / 1000 AS ts FROM e), h AS (SELECT shard_key, ts, lag(ts, 2) OVER w AS burst_start, coalesce(ts - lag(ts, 2) OVER w <= 3600, false) AS is_on FROM r WINDOW w AS (PARTITION BY shard_key ORDER BY ts)), a AS (SELECT *, lag(is_on, 1, false) OVER (PARTITION BY shard_key ORDER BY ts) AS was_on FROM h) SELECT shard_key, burst_start, ts AS alert_ts, 3 AS n FROM a WHERE is_on AND NOT was_on",
)
def burst_stream(t: Tables):
    """One alert as a shard reaches three events within an hour, with keyed state over a recorded stream."""
    root = scratch(t.spark, "bursts")
    t.e.select(F.col("event_type").alias("shard_key"), (F.col("ms") / 1000).alias("ts")).write.parquet(f"{root}/in")
    stream = t.spark.readStream.schema("shard_key string, ts double").parquet(f"{root}/in")
    return run_to_table(burst_alerts(stream, 3, 3600.0), f"{root}/out", f"{root}/checkpoint")


@query("published_prices", f"{_ROWS} SELECT crypto, timeframe, market_id, hour_ms AS timestamp FROM t GROUP BY ALL")
def published_prices(t: Tables):
    """What a publication holds: staged shards folded, none copied."""
    root = scratch(t.spark, "publication")
    append_staged(_rows(t).select("crypto", "timeframe", "market_id", F.col("hour_ms").alias("timestamp"), F.lit(0.5).alias("up_price"), F.lit(0.5).alias("down_price")), root, PRICES)
    publish(t.spark, root, f"{root}-out")
    return load_prices(t.spark, f"{root}-out/prices").select("crypto", "timeframe", "market_id", "timestamp")


@query("resumed_scan", f"{E} SELECT max(ms) AS high_water, 5 AS version FROM e")
def resumed_scan(t: Tables):
    """A scan's mark through its file, and the schema's version through a table's footer."""
    root = scratch(t.spark, "mark")
    save_checkpoint(t.spark, f"{root}/mark.json", t.e.agg(F.max("ms")).first()[0])
    replace_partitions(canonical(_as_ticks(_rows(t)), TICKS).select(*TICKS.schema.fieldNames()), f"{root}/ticks", TICKS)
    return t.spark.createDataFrame([(load_checkpoint(t.spark, f"{root}/mark.json"), schema_version(t.spark.read.parquet(f"{root}/ticks")))], "high_water bigint, version int")


@query("optimised_culture", f"{_ROWS} SELECT market_id, '{{}}' AS tokens, -1 AS bucket_index, CAST(CASE WHEN k % 2 = 0 THEN k ELSE 0 END AS DOUBLE) AS volume FROM t")
def optimised_culture(t: Tables):
    """Rows in a table's types; what does not parse becomes the default."""
    rows = _rows(t).select("market_id", F.when(F.col("k") % 2 == 0, F.col("k").cast("string")).otherwise("n/a").alias("volume"))
    return canonical(rows, CULTURE_MARKETS).select("market_id", "tokens", "bucket_index", F.col("volume").cast("double").alias("volume"))
