"""Deduplication, as-of joins, sequences, latches, windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators.asof import align_sides, asof_join, forward_fill, spot_at
from ..operators.dedup import dedup_orderbook, dedup_ticks, drop_overridden, keep_last, last_by_group, merge_columns, upsert
from ..operators.latch import heartbeat_ages, latch_quotes, latch_trades, latest_prices, stale
from ..operators.sequence import bursts, chunks, gaps, low_water, merge_intervals, out_of_order, sessions
from .registry import E, Tables, query
from .relational import _MARKETS, markets

HOUR = 3_600_000

_TICKS = f"""{E}, t AS (SELECT CAST(user_id AS VARCHAR) AS market_id, ms // 86400000 * 86400000 AS timestamp_ms, event_type AS token_id, 'h' || (k % 3) AS tx_hash, 0 AS log_index,
  CASE WHEN k >= 60 THEN 'o' || (k % 2) END AS order_hash, CASE WHEN k % 10 = 0 THEN 'websocket' ELSE 'onchain' END AS source, NULL::BIGINT AS local_recv_ts_ns,
  CASE WHEN k % 2 = 0 THEN NULL ELSE value END AS price, CASE WHEN k % 3 = 0 THEN NULL ELSE value * 2 END AS size_usdc, event_id AS w FROM e),
kept AS (SELECT * FROM t WHERE NOT (tx_hash <> '' AND source <> 'websocket' AND order_hash IS NULL AND EXISTS (
  SELECT 1 FROM t n WHERE n.market_id = t.market_id AND n.timestamp_ms = t.timestamp_ms AND n.token_id = t.token_id AND n.tx_hash = t.tx_hash AND n.source <> 'websocket' AND n.order_hash IS NOT NULL)))"""


def ticks(t: Tables):
    """Events as ticks with many rows of one key."""
    k = F.col("k")
    return t.e.select(
        F.col("user_id").cast("string").alias("market_id"),
        F.expr("ms div 86400000 * 86400000").alias("timestamp_ms"),
        F.col("event_type").alias("token_id"),
        F.concat(F.lit("h"), (k % 3).cast("string")).alias("tx_hash"),
        F.lit(0).alias("log_index"),
        F.when(k >= 60, F.concat(F.lit("o"), (k % 2).cast("string"))).alias("order_hash"),
        F.when(k % 10 == 0, "websocket").otherwise("onchain").alias("source"),
        F.lit(None).cast("bigint").alias("local_recv_ts_ns"),
        F.when(k % 2 != 0, F.col("value")).alias("price"),
        F.when(k % 3 != 0, F.col("value") * 2).alias("size_usdc"),
        F.col("event_id").alias("w"),
    )


@query("legacy_override_anti", f"{_TICKS} SELECT w FROM kept")
def legacy_override_anti(t: Tables):
    return drop_overridden(ticks(t)).select("w")


_KEY = "market_id, timestamp_ms, token_id, tx_hash, log_index, coalesce(order_hash, ''), coalesce(local_recv_ts_ns, 0)"


@query("tick_dedup_argmax", f"{_TICKS} SELECT market_id, timestamp_ms, token_id, tx_hash, arg_max(order_hash, w) AS order_hash, arg_max(source, w) AS source, arg_max(price, w) AS price, arg_max(size_usdc, w) AS size_usdc FROM kept GROUP BY {_KEY}, market_id, timestamp_ms, token_id, tx_hash")
def tick_dedup_argmax(t: Tables):
    return dedup_ticks(ticks(t), F.col("w")).select(*"market_id timestamp_ms token_id tx_hash order_hash source price size_usdc".split())


@query("price_dedup_argmax", f"{E} SELECT user_id, ms // {HOUR} AS hour, arg_max(CASE WHEN k % 2 = 0 THEN NULL ELSE value END, event_id) AS price, arg_max(event_type, event_id) AS event_type FROM e GROUP BY 1, 2")
def price_dedup_argmax(t: Tables):
    df = t.e.select("user_id", F.expr(f"ms div {HOUR}").alias("hour"), F.when(F.col("k") % 2 != 0, F.col("value")).alias("price"), "event_type", F.col("event_id").alias("_w"))
    return merge_columns(df, ["user_id", "hour"], F.col("_w"))


@query("keep_last_row", f"{E} SELECT user_id, hour, event_id, nullable FROM (SELECT user_id, ms // {HOUR} AS hour, event_id, CASE WHEN k % 2 = 0 THEN NULL ELSE k END AS nullable, row_number() OVER (PARTITION BY user_id, ms // {HOUR} ORDER BY ts DESC, event_id DESC) AS n FROM e) WHERE n = 1")
def keep_last_row(t: Tables):
    df = t.e.select("user_id", F.expr(f"ms div {HOUR}").alias("hour"), "event_id", F.when(F.col("k") % 2 != 0, F.col("k")).alias("nullable"), "ts")
    return keep_last(df, ["user_id", "hour"], ["ts", "event_id"]).drop("ts")


@query(
    "bbo_recency_dedup",
    f"{E}, b AS (SELECT ms // {HOUR} AS ts_ms, CAST(user_id % 20 AS VARCHAR) AS market_id, event_type AS token_id, 'Up' AS outcome, value / 100 AS best_bid, value / 100 + 0.01 AS best_ask, k * 1.0::DOUBLE AS best_bid_size, 1.0::DOUBLE AS best_ask_size, CASE WHEN k % 4 > 0 THEN event_id * 1000000 END AS recv FROM e) "
    "SELECT ts_ms, market_id, token_id, arg_max(best_bid, (coalesce(recv, ts_ms * 1000000), best_bid, best_ask, best_bid_size, best_ask_size)) AS best_bid, max(recv) AS local_recv_ts_ns FROM b GROUP BY 1, 2, 3, outcome",
)
def bbo_recency_dedup(t: Tables):
    df = t.e.select(F.expr(f"ms div {HOUR}").alias("ts_ms"), (F.col("user_id") % 20).cast("string").alias("market_id"), F.col("event_type").alias("token_id"), F.lit("Up").alias("outcome"), (F.col("value") / 100).alias("best_bid"), (F.col("value") / 100 + 0.01).alias("best_ask"), F.col("k").cast("double").alias("best_bid_size"), F.lit(1.0).alias("best_ask_size"), F.when(F.col("k") % 4 > 0, F.col("event_id") * 1000000).alias("local_recv_ts_ns"))
    return dedup_orderbook(df).select("ts_ms", "market_id", "token_id", "best_bid", "local_recv_ts_ns")


@query("last_by_group", f"{E} SELECT user_id, arg_max(event_type, event_id) AS event_type, arg_max(CASE WHEN k < 70 THEN value END, event_id) AS value FROM e GROUP BY 1")
def group_last(t: Tables):
    return last_by_group(t.e.select("user_id", "event_type", F.when(F.col("k") < 70, F.col("value")).alias("value"), F.col("event_id").alias("_o")), ["user_id"], "_o")


@query(
    "merge_upsert",
    "WITH u AS (SELECT o_orderkey, o_totalprice, o_orderstatus, 0 AS p FROM orders UNION ALL SELECT o_orderkey + 7, o_totalprice + 1, 'U', 1 FROM orders WHERE o_orderkey % 5 = 0) SELECT o_orderkey, o_totalprice, o_orderstatus FROM u QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY p DESC) = 1",
)
def merge_upsert(t: Tables):
    base = t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus")
    delta = base.where("o_orderkey % 5 = 0").select((F.col("o_orderkey") + 7).alias("o_orderkey"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("U").alias("o_orderstatus"))
    return upsert(base, delta, ["o_orderkey"])


_CLICKS = f"{E}, c AS (SELECT user_id, ms, event_id FROM e WHERE event_type = 'click'), v AS (SELECT user_id, ms AS v_ms, value FROM e WHERE event_type = 'view')"


def _sides(t: Tables):
    return t.e.where("event_type = 'click'").select("user_id", "ms", "event_id"), t.e.where("event_type = 'view'").select("user_id", F.col("ms").alias("v_ms"), "value")


@query("asof_backward", f"{_CLICKS} SELECT c.user_id, c.event_id, v_ms, value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ms >= v.v_ms")
def asof_backward(t: Tables):
    return asof_join(*_sides(t), ["user_id"], "ms", "v_ms", ["value"]).select("user_id", "event_id", F.col("v_ms_match").alias("v_ms"), "value")


@query("asof_tolerance", f"{_CLICKS} SELECT c.user_id, c.event_id, CASE WHEN ms - v_ms <= {12 * HOUR} THEN value END AS value FROM c ASOF LEFT JOIN v ON c.user_id = v.user_id AND c.ms >= v.v_ms")
def asof_tolerance(t: Tables):
    return asof_join(*_sides(t), ["user_id"], "ms", "v_ms", ["value"], tolerance=12 * HOUR).select("user_id", "event_id", "value")


@query(
    "spot_point_in_time",
    f"{E}, q AS (SELECT event_type AS crypto, ms AS ts_ms, max(value) AS price FROM e WHERE k < 30 GROUP BY 1, 2), x AS (SELECT event_type AS crypto, ms AS timestamp_ms, event_id FROM e WHERE k >= 90) SELECT event_id, CASE WHEN timestamp_ms - ts_ms <= {2 * HOUR} THEN price END AS spot_price_usdt, CASE WHEN timestamp_ms - ts_ms <= {2 * HOUR} THEN ts_ms END AS spot_price_ts_ms FROM x ASOF LEFT JOIN q ON x.crypto = q.crypto AND x.timestamp_ms >= q.ts_ms",
)
def spot_point_in_time(t: Tables):
    trades = t.e.where("k >= 90").select(F.col("event_type").alias("crypto"), F.col("ms").alias("timestamp_ms"), "event_id", F.lit(None).cast("bigint").alias("local_recv_ts_ns"))
    quotes = t.e.where("k < 30").select(F.col("event_type").alias("crypto"), F.col("ms").alias("ts_ms"), F.col("value").alias("price"))
    return spot_at(trades, quotes, stale_ms=2 * HOUR).select("event_id", "spot_price_usdt", "spot_price_ts_ms")


@query(
    "ffill_two_sided",
    f"{E}, p AS (SELECT user_id, ms // {HOUR} AS h, max(value) FILTER (event_type = 'click') AS u, max(value) FILTER (event_type = 'view') AS d FROM e WHERE event_type IN ('click', 'view') GROUP BY 1, 2) SELECT user_id, h, coalesce(last_value(u IGNORE NULLS) OVER w, 0.5) AS up_price, coalesce(last_value(d IGNORE NULLS) OVER w, 0.5) AS down_price FROM p WINDOW w AS (PARTITION BY user_id ORDER BY h ROWS UNBOUNDED PRECEDING)",
)
def ffill_two_sided(t: Tables):
    points = t.e.where("event_type IN ('click', 'view')").select("user_id", F.expr(f"ms div {HOUR}").alias("h"), F.when(F.col("event_type") == "click", "up").otherwise("down").alias("side"), "value")
    return align_sides(points, ["user_id"], "h", "side", "value")


@query("forward_fill", f"{E} SELECT event_id, last_value(CASE WHEN k % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS UNBOUNDED PRECEDING) AS filled FROM e")
def fill(t: Tables):
    df = t.e.select("event_id", "user_id", "ms", F.when(F.col("k") % 3 == 0, F.col("value")).alias("filled"))
    return forward_fill(df, ["user_id"], ["ms", "event_id"], ["filled"]).select("event_id", "filled")


@query("heartbeat_gaps", f"{E}, g AS (SELECT user_id, event_type, lag(ms) OVER (PARTITION BY user_id, event_type ORDER BY ms) AS start_ms, ms AS end_ms FROM e) SELECT *, end_ms - start_ms AS gap_ms FROM g WHERE end_ms - start_ms > {48 * HOUR}")
def heartbeat_gaps(t: Tables):
    return gaps(t.e.select("user_id", "event_type", "ms"), ["user_id", "event_type"], "ms", 48 * HOUR)


@query(
    "burst_islands",
    f"{E}, r AS (SELECT user_id, ms, row_number() OVER (PARTITION BY user_id ORDER BY ms) AS rn FROM e), w AS (SELECT *, min(rn) OVER x AS hr, min(ms) OVER x AS head FROM r WINDOW x AS (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {6 * HOUR} PRECEDING AND CURRENT ROW)), "
    "n AS (SELECT *, rn - hr + 1 AS n FROM w), i AS (SELECT *, n >= 5 AS inn, lag(n >= 5, 1, false) OVER (PARTITION BY user_id ORDER BY rn) AS was, lead(ms) OVER (PARTITION BY user_id ORDER BY rn) AS nx FROM n), "
    "s AS (SELECT *, sum(CASE WHEN inn AND NOT was THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY rn) AS island FROM i) SELECT user_id, max(n)::BIGINT AS n, arg_min(head, rn) AS burst_start, arg_max(coalesce(nx, ms), rn) AS burst_end FROM s WHERE inn GROUP BY user_id, island",
)
def burst_islands(t: Tables):
    found = bursts(t.e.select("user_id", (F.col("ms") / 1000).alias("s")), ["user_id"], "s", 5, 6 * 3600)
    return found.select("user_id", "n", *[F.round(F.col(c) * 1000).cast("bigint").alias(c) for c in ("burst_start", "burst_end")])


@query(
    "interval_merge",
    f"{E}, i AS (SELECT user_id, ms AS a, ms + {6 * HOUR} AS b FROM e), m AS (SELECT *, CASE WHEN a <= max(b) OVER (PARTITION BY user_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 60000 THEN 0 ELSE 1 END AS f FROM i), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM m) SELECT user_id, min(a) AS a, max(b) AS b FROM s GROUP BY user_id, g",
)
def interval_merge(t: Tables):
    return merge_intervals(t.e.select("user_id", F.col("ms").alias("a"), (F.col("ms") + 6 * HOUR).alias("b")), ["user_id"], "a", "b")


@query(
    "session_windows",
    f"{E}, n AS (SELECT user_id, ms, CASE WHEN ms - lag(ms) OVER (PARTITION BY user_id ORDER BY ms) <= {8 * HOUR} THEN 0 ELSE 1 END AS f FROM e), s AS (SELECT *, sum(f) OVER (PARTITION BY user_id ORDER BY ms ROWS UNBOUNDED PRECEDING) AS g FROM n) SELECT user_id, count(*) AS n, min(ms) AS session_start, max(ms) AS session_end FROM s GROUP BY user_id, g",
)
def session_windows(t: Tables):
    return sessions(t.e.select("user_id", "ms"), ["user_id"], "ms", 8 * HOUR)


@query("out_of_order", f"{E} SELECT DISTINCT user_id FROM (SELECT user_id, k, lag(k) OVER (PARTITION BY user_id ORDER BY event_id) AS b FROM e WHERE event_type = 'click') WHERE k < b")
def unordered(t: Tables):
    return out_of_order(t.e.where("event_type = 'click'"), ["user_id"], "k", ["event_id"])


_BBO = f"{E}, u AS (SELECT event_type || user_id % 7 AS token_id, event_id AS r, k % 10 = 0 AS snap, CASE WHEN k % 3 = 0 THEN value / 200 END AS bb, CASE WHEN k % 4 <> 1 THEN 0.5 + value / 250 END AS ba, CASE WHEN k % 5 <> 2 THEN k * 1.0::DOUBLE END AS bs, 1.0::DOUBLE AS asz FROM e)"


def book_updates(t: Tables):
    k = F.col("k")
    return t.e.select(
        F.concat("event_type", (F.col("user_id") % 7).cast("string")).alias("token_id"),
        F.col("event_id").alias("local_recv_ts_ns"),
        (k % 10 == 0).alias("is_snapshot"),
        F.when(k % 3 == 0, F.col("value") / 200).alias("best_bid"),
        F.when(k % 4 != 1, 0.5 + F.col("value") / 250).alias("best_ask"),
        F.when(k % 5 != 2, k.cast("double")).alias("best_bid_size"),
        F.lit(1.0).alias("best_ask_size"),
    )


BBO_SQL = (
    f"{_BBO}, l AS (SELECT token_id, r, "
    + ", ".join(f"coalesce(last_value(CASE WHEN snap THEN coalesce({c}, 0.0) ELSE {c} END IGNORE NULLS) OVER w, 0.0) AS {n}" for c, n in (("bb", "best_bid"), ("ba", "best_ask"), ("bs", "best_bid_size"), ("asz", "best_ask_size")))
    + " FROM u WINDOW w AS (PARTITION BY token_id ORDER BY r ROWS UNBOUNDED PRECEDING)) SELECT token_id, r AS local_recv_ts_ns, best_bid, best_ask, best_bid_size, best_ask_size FROM l WHERE best_bid > 0 AND best_ask > 0 AND best_bid_size > 0 AND best_ask_size > 0 AND best_bid < best_ask AND best_bid <= 1 AND best_ask <= 1"
)


@query("bbo_latch", BBO_SQL)
def bbo_latch(t: Tables):
    return latch_quotes(book_updates(t)).select("token_id", "local_recv_ts_ns", "best_bid", "best_ask", "best_bid_size", "best_ask_size")


@query(
    "last_trade_latch",
    f"{E} SELECT event_id, coalesce(last_value(CASE WHEN event_type = 'click' THEN value END IGNORE NULLS) OVER w, 0.5) AS up_price, coalesce(last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER w, 0.5) AS down_price FROM e WHERE event_type IN ('click', 'view') WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
)
def last_trade_latch(t: Tables):
    df = t.e.where("event_type IN ('click', 'view')").withColumn("outcome", F.when(F.col("event_type") == "click", "Up").otherwise("Down"))
    return latch_trades(df, "user_id", ("event_id",), price="value").select("event_id", "up_price", "down_price")


@query("latest_prices", f"{E} SELECT user_id, event_type, max(ms) AS ms, arg_max(value, ms) AS value FROM e GROUP BY 1, 2")
def latest(t: Tables):
    return latest_prices(t.e.select("user_id", "event_type", "ms", "value"), ["user_id", "event_type"], "ms")


@query("stale_series", f"{E}, a AS (SELECT user_id, event_type, 1706659200000 - max(ms) AS last_event_age_ms FROM e GROUP BY 1, 2) SELECT user_id, event_type, last_event_age_ms FROM a WHERE (event_type = 'click' AND last_event_age_ms > {60 * HOUR}) OR (event_type = 'view' AND last_event_age_ms > {40 * HOUR})")
def stale_series(t: Tables):
    ages = heartbeat_ages(t.e.select("user_id", "event_type", "ms"), ["user_id", "event_type"], "ms", 1706659200000)
    return stale(ages, {"click": 60 * HOUR, "view": 40 * HOUR}, "event_type", 0, 1706659200000)


@query("incremental_low_water", f"WITH m AS ({_MARKETS}), p AS (SELECT CAST(l_orderkey AS VARCHAR) AS market_id, max(epoch(l_shipdate)::BIGINT) + 1 AS nx FROM lineitem GROUP BY 1), j AS (SELECT market_id, end_ts, greatest(start_ts, coalesce(nx, start_ts)) AS fetch_from FROM m LEFT JOIN p USING (market_id)) SELECT market_id, fetch_from FROM j WHERE fetch_from < end_ts AND end_ts - fetch_from >= 60")
def incremental_low_water(t: Tables):
    prices = t.lineitem.select(F.col("l_orderkey").cast("string").alias("market_id"), F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("timestamp"))
    return low_water(markets(t), prices).select("market_id", "fetch_from")


@query("window_chunking", f"WITH m AS ({_MARKETS}), x AS (SELECT market_id, end_ts, unnest(generate_series(start_ts, end_ts - 1, 21601)) AS window_start FROM m) SELECT market_id, window_start, least(window_start + 21600, end_ts) AS window_end FROM x")
def window_chunking(t: Tables):
    return chunks(markets(t), "start_ts", "end_ts", 21600).select("market_id", "window_start", "window_end")


@query("window_ranking", "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS rk, dense_rank() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus) AS dr, ntile(4) OVER w AS q, lead(o_orderkey) OVER w AS nx FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice, o_orderkey)")
def window_ranking(t: Tables):
    w, s = Window.partitionBy("o_custkey").orderBy("o_totalprice", "o_orderkey"), Window.partitionBy("o_custkey").orderBy("o_orderstatus")
    long = lambda c: c.cast("bigint")
    return t.orders.select("o_orderkey", long(F.row_number().over(w)).alias("rn"), long(F.rank().over(s)).alias("rk"), long(F.dense_rank().over(s)).alias("dr"), long(F.ntile(4).over(w)).alias("q"), F.lead("o_orderkey").over(w).alias("nx"))


@query("window_frames", f"{E} SELECT event_id, CAST(sum(CAST(value AS DECIMAL(18,2))) OVER (PARTITION BY user_id ORDER BY ms, event_id ROWS 2 PRECEDING) AS DOUBLE) AS last3, count(*) OVER (PARTITION BY user_id ORDER BY ms RANGE BETWEEN {24 * HOUR} PRECEDING AND CURRENT ROW) AS day_n FROM e")
def window_frames(t: Tables):
    rows = Window.partitionBy("user_id").orderBy("ms", "event_id").rowsBetween(-2, 0)
    day = Window.partitionBy("user_id").orderBy("ms").rangeBetween(-24 * HOUR, 0)
    return t.e.select("event_id", F.sum(F.col("value").cast("decimal(18,2)")).over(rows).cast("double").alias("last3"), F.count("*").over(day).alias("day_n"))
