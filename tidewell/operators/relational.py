"""Filters, routing and lookups between the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a dimension up to which it is broadcast; a larger one is left to the planner.
DIMENSION_ROWS = 2_000_000


def relevant_markets(markets: DataFrame, cutoff_ts: int | None = None, **wanted: list[str]) -> DataFrame:
    """Markets that a run asks for, by lists of values of columns; an empty list asks for all. The cutoff is on the closing time, or the end where none is known."""
    for name, values in wanted.items():
        if values:
            markets = markets.where(F.col(name).isin(values))
    if cutoff_ts is not None:
        markets = markets.where(F.coalesce(F.nullif("closed_ts", F.lit(0)), F.col("end_ts")) >= cutoff_ts)
    return markets


def date_bounds(column: Column | str, first: str | None = None, last: str | None = None) -> Column:
    """first <= day of an epoch second <= last, by UTC days; the last day counts whole."""
    at = F.timestamp_seconds(F.col(column) if isinstance(column, str) else column)
    ok = F.lit(True)
    if first:
        ok = ok & (at >= F.to_timestamp(F.lit(first)))
    if last:
        ok = ok & (at < F.to_timestamp(F.lit(last)) + F.expr("INTERVAL 1 DAY"))
    return ok


def still_open(markets: DataFrame, now_ts: int) -> DataFrame:
    """Markets whose end has not passed."""
    return markets.where(F.col("end_ts") >= now_ts)


def overlapping(df: DataFrame, start: str, end: str, first: int, last: int) -> DataFrame:
    """Rows whose interval touches [first, last)."""
    return df.where((F.col(end) >= first) & (F.col(start) < last))


def in_unit(price: str = "price") -> Column:
    return F.col(price).between(0, 1)


#: Bytes that the planner may put a dimension at for a broadcast without counting it.
DIMENSION_BYTES = 32 << 20


def dimension(df: DataFrame) -> DataFrame:
    """A dimension with a broadcast hint if it is small enough: by the planner's upper bound where that says so already, else counted."""
    if int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= DIMENSION_BYTES:
        return F.broadcast(df)
    return F.broadcast(df) if df.count() <= DIMENSION_ROWS else df


def token_lookup(rows: DataFrame, tokens: DataFrame, token: str = "token_id") -> DataFrame:
    """Rows with their token's market, outcome and partition; unknown tokens drop out."""
    dim = tokens.withColumnRenamed("token_id", "_token") if token != "token_id" else tokens.withColumn("_token", F.col("token_id")).drop("token_id")
    return rows.join(dimension(dim), F.col(token) == F.col("_token")).drop("_token")


def attach_partition(rows: DataFrame, markets: DataFrame) -> DataFrame:
    """Rows with crypto and timeframe of their market, null for unknown markets."""
    return rows.join(dimension(markets.select("market_id", "crypto", "timeframe").dropDuplicates(["market_id"])), "market_id", "left")


def uncovered(markets: DataFrame, covered: DataFrame) -> DataFrame:
    """Markets whose interval does not lie within what is covered (low_ts, high_ts by crypto)."""
    inside = (markets["crypto"] == covered["crypto"]) & (markets["start_ts"] >= covered["low_ts"]) & (markets["end_ts"] <= covered["high_ts"])
    return markets.join(covered, inside, "left_anti")


def coverage(prices: DataFrame, group: str = "crypto", ts: str = "timestamp") -> DataFrame:
    """The first and last time of each group."""
    return prices.groupBy(group).agg(F.min(ts).alias("low_ts"), F.max(ts).alias("high_ts"))


def new_findings(now: DataFrame, before: DataFrame, identity: list[str]) -> DataFrame:
    """Findings that an earlier report has not, by their identity; nulls agree with nulls."""
    condition = None
    for c in identity:
        same = now[c].eqNullSafe(before[c])
        condition = same if condition is None else condition & same
    return now.join(before, condition, "left_anti")


def high_water(markets: DataFrame, now_ts: int) -> DataFrame:
    """The latest closing time (or past end) seen, from which a later scan resumes."""
    return markets.agg(F.max(F.coalesce(F.nullif("closed_ts", F.lit(0)), F.least(F.col("end_ts"), F.lit(now_ts)))).alias("high_water"))


def resume_from(checkpoint: int | None, now_ts: int, overlap_s: int = 2 * 86400) -> int | None:
    """Where a scan resumes: two days before the checkpoint, which cannot lie in the future."""
    return None if checkpoint is None else min(checkpoint, now_ts) - overlap_s


def first_by_priority(frames: list[DataFrame], key: str) -> DataFrame:
    """The union of frames in which the first frame that has a key gives its row."""
    union = None
    for i, df in enumerate(frames):
        df = df.withColumn("_p", F.lit(i))
        union = df if union is None else union.unionByName(df, allowMissingColumns=True)
    best = union.groupBy(key).agg(F.min_by(F.struct(*[c for c in union.columns if c not in (key, "_p")]), "_p").alias("_row"))
    return best.select(key, "_row.*")
