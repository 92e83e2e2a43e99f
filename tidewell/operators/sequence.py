"""Ordered-sequence operators: gaps, bursts, islands, chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def gaps(df: DataFrame, key: list[str], ts: str, longest: int) -> DataFrame:
    """Pauses above longest between neighbours of a series: start_ms, end_ms, gap_ms, the widest first."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(ts))
    df = df.where(F.col(ts) > 0).withColumn("start_ms", before).withColumn("gap_ms", F.col(ts) - F.col("start_ms"))
    return df.where(F.col("gap_ms") > longest).select(*key, "start_ms", F.col(ts).alias("end_ms"), "gap_ms").orderBy(F.desc("gap_ms"), *key, "start_ms")


def bursts(df: DataFrame, key: list[str], ts: str, threshold: int, window_s: float) -> DataFrame:
    """Times in which at least threshold events lie within window_s: n, start, end (the first event below the threshold, or the last).

    ts is in seconds and may be fractional; it is compared in microseconds. Equal times are told
    apart by their place, as a queue would meet them.
    """
    us = F.round(F.col(ts) * 1_000_000).cast("bigint")
    df = df.select(*key, F.col(ts).alias("_ts"), us.alias("_us"))
    df = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*key).orderBy("_us")))
    back = Window.partitionBy(*key).orderBy("_us").rangeBetween(-int(round(window_s * 1_000_000)), 0)
    df = df.withColumn("_head_rn", F.min("_rn").over(back)).withColumn("_head", F.min("_ts").over(back))
    df = df.withColumn("_n", F.col("_rn") - F.col("_head_rn") + 1)
    order = Window.partitionBy(*key).orderBy("_rn")
    df = df.withColumn("_in", (F.col("_n") >= threshold).cast("int"))
    df = df.withColumn("_start", ((F.col("_in") == 1) & (F.coalesce(F.lag("_in").over(order), F.lit(0)) == 0)).cast("int"))
    df = df.withColumn("_next", F.lead("_ts").over(order)).withColumn("_island", F.sum("_start").over(order))
    inside = df.where("_in = 1").groupBy(*key, "_island")
    out = inside.agg(F.max("_n").cast("bigint").alias("n"), F.min_by("_head", "_rn").alias("burst_start"), F.max_by(F.coalesce("_next", "_ts"), "_rn").alias("burst_end"))
    return out.drop("_island").orderBy(F.desc("n"), *key, "burst_start")


def merge_intervals(df: DataFrame, key: list[str], start: str, end: str, slack: int = 60_000) -> DataFrame:
    """Intervals that touch, or lie no further apart than slack, made one."""
    order = Window.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    df = df.withColumn("_new", F.when(F.col(start) <= reach + slack, 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "_island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("_island")


def sessions(df: DataFrame, key: list[str], ts: str, pause: Column | int) -> DataFrame:
    """Events in sessions that a pause above the given one divides: n, first and last time."""
    order = Window.partitionBy(*key).orderBy(ts)
    new = F.when(F.col(ts) - F.lag(ts).over(order) <= pause, 0).otherwise(1)
    df = df.withColumn("_new", new).withColumn("_s", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*key, "_s").agg(F.count("*").alias("n"), F.min(ts).alias("session_start"), F.max(ts).alias("session_end")).drop("_s")


def chunks(df: DataFrame, start: str, end: str, step: int, inclusive: bool = True) -> DataFrame:
    """Each interval in windows of step: [s, min(s + step, end)]; the next begins one behind the end (inclusive) or at it."""
    stride = step + 1 if inclusive else step
    at = F.explode(F.when(F.col(start) < F.col(end), F.sequence(F.col(start), F.col(end) - 1, F.lit(stride).cast("bigint"))))
    return df.withColumn("window_start", at).withColumn("window_end", F.least(F.col("window_start") + step, F.col(end)))


def low_water(markets: DataFrame, prices: DataFrame, least_s: int = 60) -> DataFrame:
    """Where each market's history goes on: behind its last price, or at its start. Markets with less than least_s to go are left out."""
    seen = prices.groupBy("market_id").agg((F.max("timestamp") + 1).alias("_next"))
    df = markets.join(seen, "market_id", "left").withColumn("fetch_from", F.greatest(F.col("start_ts"), F.coalesce("_next", F.col("start_ts"))))
    return df.where((F.col("fetch_from") < F.col("end_ts")) & (F.col("end_ts") - F.col("fetch_from") >= least_s)).drop("_next")


def out_of_order(df: DataFrame, key: list[str], ts: str, order: list[str]) -> DataFrame:
    """Series in which a time is below the one stored before it."""
    before = F.lag(ts).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_before", before).where(F.col(ts) < F.col("_before")).select(*key).distinct()
