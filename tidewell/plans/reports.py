"""Profiles, quality reports and rollups."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import profile
from ..operators.quality import summary, validate_prices, worst
from ..operators.sequence import gaps
from .registry import E, Tables, money, query
from .series import HOUR

_T = f"{E}, t AS (SELECT CAST(user_id AS VARCHAR) AS market_id, ms AS timestamp_ms, event_type AS token_id, CASE WHEN k % 2 = 0 THEN 'BUY' ELSE 'SELL' END AS side, event_type AS outcome, value AS price, value AS size_usdc, 'h' || k AS tx_hash, CASE WHEN k % 4 > 0 THEN value END AS spot_price_usdt FROM e)"


def ticks(t: Tables):
    return t.e.select(F.col("user_id").cast("string").alias("market_id"), F.col("ms").alias("timestamp_ms"), F.col("event_type").alias("token_id"), F.when(F.col("k") % 2 == 0, "BUY").otherwise("SELL").alias("side"), F.col("event_type").alias("outcome"), F.col("value").alias("price"), F.col("value").alias("size_usdc"), F.concat(F.lit("h"), F.col("k").cast("string")).alias("tx_hash"), F.lit(0).alias("log_index"), F.lit(None).cast("string").alias("order_hash"), F.when(F.col("k") % 4 > 0, F.col("value")).alias("spot_price_usdt"))


@query("scale_counts", f"{_T} SELECT count(*) AS ticks, count(DISTINCT market_id) AS markets, count(DISTINCT token_id) AS tokens FROM t")
def scale_counts(t: Tables):
    return profile.scale(ticks(t)).drop("distinct_trades")


@query("approx_distinct")
def approx_distinct(t: Tables):
    """HyperLogLog over a composite key; no two engines give the same estimate."""
    return profile.scale(ticks(t)).select("distinct_trades")


@query("time_range", f"{_T} SELECT epoch_ms(min(make_timestamp(timestamp_ms * 1000))) AS first_ms, max(timestamp_ms) AS last_ms, round((max(timestamp_ms) - min(timestamp_ms)) / 86400000, 2) AS days FROM t")
def time_range(t: Tables):
    return profile.time_range(ticks(t)).select(F.unix_millis("first").alias("first_ms"), F.unix_millis("last").alias("last_ms"), "days")


@query("summary_stats", "SELECT min(value) AS low, max(value) AS high, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS deviation, round(sum(value), 2) AS total FROM events")
def summary_stats(t: Tables):
    return profile.moments(t.events, "value").select("low", "high", F.round("mean", 6).alias("mean"), F.round("deviation", 6).alias("deviation"), F.round("total", 2).alias("total"))


@query("exact_quantiles", "SELECT " + ", ".join(f"round(quantile_cont(l_extendedprice, {q}), 6) AS q{round(q * 100)}" for q in profile.QUANTILES) + " FROM lineitem")
def exact_quantiles(t: Tables):
    out = profile.quantiles(t.lineitem, "l_extendedprice", exact=True)
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


@query("approx_quantiles")
def approx_quantiles(t: Tables):
    """Quantiles from a bounded sketch; engines differ in theirs."""
    return profile.quantiles(t.lineitem, "l_extendedprice")


@query("histogram", f"{_T} SELECT side, count(*) AS n FROM t GROUP BY 1")
def histogram(t: Tables):
    return profile.histogram(ticks(t), "side")


@query("daily_rollup", f"{E} SELECT CAST(ts AS DATE) AS day, count(*) AS ticks, count(DISTINCT user_id) AS markets, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS notional FROM e GROUP BY 1")
def daily_rollup(t: Tables):
    return profile.daily(ticks(t)).withColumn("notional", F.round("notional", 2))


@query("two_level_distribution", f"{_T}, n AS (SELECT market_id, count(*) AS n FROM t GROUP BY 1) SELECT min(n) AS low, max(n) AS high, round(avg(n), 6) AS mean, quantile_disc(n, 0.25) AS q25, quantile_disc(n, 0.5) AS q50, quantile_disc(n, 0.75) AS q75, quantile_disc(n, 0.95) AS q95 FROM n")
def two_level_distribution(t: Tables):
    """With fewer markets than the sketch has room for, its quantiles are exact."""
    return profile.ticks_per_market(ticks(t)).withColumn("mean", F.round("mean", 6))


@query("density_rates", f"{_T} SELECT round(count(*) / ((max(timestamp_ms) - min(timestamp_ms)) / 1000), 9) AS per_second, round(count(*) / count(DISTINCT market_id), 6) AS per_market FROM t")
def density_rates(t: Tables):
    return profile.density(ticks(t)).select(F.round("per_second", 9).alias("per_second"), F.round("per_market", 6).alias("per_market"))


@query("coverage_pct", f"{_T} SELECT round(100.0 * count(spot_price_usdt) / count(*), 6) AS percent FROM t")
def coverage_pct(t: Tables):
    return profile.filled(ticks(t), "spot_price_usdt").select(F.round("percent", 6).alias("percent"))


@query("by_feed", f"{E} SELECT event_type AS symbol, CASE WHEN k % 2 = 0 THEN 'a' ELSE 'b' END AS source, count(*) AS n, min(ms) AS first_ms, max(ms) AS last_ms FROM e GROUP BY 1, 2")
def by_feed(t: Tables):
    return profile.by_feed(t.e.select(F.col("event_type").alias("symbol"), F.when(F.col("k") % 2 == 0, "a").otherwise("b").alias("source"), F.col("ms").alias("ts_ms")))


_P = f"{E}, p AS (SELECT event_type AS timeframe, user_id AS market_id, ms // {HOUR} * 3600 AS timestamp, event_id AS w, CASE WHEN k = 3 THEN 'nan'::DOUBLE WHEN k = 7 THEN NULL ELSE value / 100 END AS u, CASE WHEN k = 5 THEN NULL ELSE 1 - value / 100 + k / 400 END AS d FROM e)"


@query(
    "quality_report",
    f"""{_P}, f AS (SELECT *, u IS NULL OR isnan(u) AS bu, d IS NULL OR isnan(d) AS bd, timestamp < lag(timestamp) OVER (PARTITION BY timeframe, market_id ORDER BY w) AS back,
  row_number() OVER (PARTITION BY timeframe, market_id, timestamp ORDER BY w) > 1 AS again FROM p)
SELECT timeframe, count(*) AS n_rows, count(DISTINCT market_id) AS n_markets, count(*) FILTER (bu) AS missing_up, count(*) FILTER (bd) AS missing_down,
  count(*) FILTER ((NOT bu AND (u < 0 OR u > 1)) OR (NOT bd AND (d < 0 OR d > 1))) AS out_of_range, count(*) FILTER (NOT bu AND NOT bd AND abs(u + d - 1) > 0.15) AS off_sum,
  round(avg(u + d) FILTER (NOT bu AND NOT bd), 6) AS mean_sum, count(DISTINCT market_id) FILTER (back) AS unordered_markets, count(*) FILTER (again) AS repeated_keys, false AS ok FROM f GROUP BY 1""",
)
def quality_report(t: Tables):
    k = F.col("k")
    u = F.when(k == 3, F.lit(float("nan"))).when(k != 7, F.col("value") / 100)
    d = F.when(k != 5, 1 - F.col("value") / 100 + k / 400)
    prices = t.e.select(F.col("event_type").alias("timeframe"), F.col("user_id").alias("market_id"), F.expr(f"ms div {HOUR} * 3600").alias("timestamp"), "event_id", u.alias("up_price"), d.alias("down_price"))
    return validate_prices(prices, ["event_id"]).withColumn("mean_sum", F.round("mean_sum", 6))


@query("timeframe_summary", "SELECT event_type AS timeframe, count(*) AS n_rows FROM events GROUP BY 1")
def timeframe_summary(t: Tables):
    return summary(t.events.withColumnRenamed("event_type", "timeframe"))


@query("worst_gaps", f"{E}, g AS (SELECT user_id, lag(ms) OVER (PARTITION BY user_id ORDER BY ms) AS start_ms, ms AS end_ms FROM e) SELECT *, end_ms - start_ms AS gap_ms FROM g WHERE end_ms - start_ms > {HOUR} ORDER BY gap_ms DESC, user_id, start_ms LIMIT 5")
def worst_gaps(t: Tables):
    return worst(gaps(t.e.select("user_id", "ms"), ["user_id"], "ms", HOUR), "gap_ms")


@query("pricing_summary", "SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS qty, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS price, round(avg(l_discount), 6) AS discount, count(*) AS n FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2")
def pricing_summary(t: Tables):
    return t.lineitem.where("l_shipdate <= TIMESTAMP_NTZ '1998-09-02'").groupBy("l_returnflag", "l_linestatus").agg(money("l_quantity").alias("qty"), money("l_extendedprice").alias("price"), F.round(F.avg("l_discount"), 6).alias("discount"), F.count("*").alias("n"))
