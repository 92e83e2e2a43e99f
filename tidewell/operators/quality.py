"""Validation of price tables and the audit of feed gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .relational import new_findings
from .sequence import bursts, gaps

SUM_TOLERANCE = 0.15


def validate_prices(prices: DataFrame, order: list[str] | None = None) -> DataFrame:
    """One row a timeframe: size, missing and impossible prices, sums away from 1, series out of order, repeated keys, and ok.

    order: how rows are stored within a market (by default as the files have them, by their provenance columns, else by time).
    """
    order = order or [c for c in ("_src_mtime", "_src_file", "_src_row") if c in prices.columns] or ["timestamp"]
    bad = lambda c: F.col(c).isNull() | F.isnan(c)
    total = F.col("up_price") + F.col("down_price")
    series = Window.partitionBy("timeframe", "market_id")
    df = prices.withColumn("_back", F.col("timestamp") < F.lag("timestamp").over(series.orderBy(*order)))
    df = df.withColumn("_again", F.row_number().over(Window.partitionBy("timeframe", "market_id", "timestamp").orderBy(*order)) > 1)
    off = F.when(~bad("up_price") & ~bad("down_price"), F.abs(total - 1) > SUM_TOLERANCE)
    outside = lambda c: ~bad(c) & ((F.col(c) < 0) | (F.col(c) > 1))
    out = df.groupBy("timeframe").agg(
        F.count("*").alias("n_rows"),
        F.countDistinct("market_id").alias("n_markets"),
        F.count_if(bad("up_price")).alias("missing_up"),
        F.count_if(bad("down_price")).alias("missing_down"),
        F.count_if(outside("up_price") | outside("down_price")).alias("out_of_range"),
        F.count_if(off).alias("off_sum"),
        F.avg(F.when(~bad("up_price") & ~bad("down_price"), total.cast("double"))).alias("mean_sum"),
        F.countDistinct(F.when(F.col("_back"), F.col("market_id"))).alias("unordered_markets"),
        F.count_if("_again").alias("repeated_keys"),
    )
    return out.withColumn("ok", F.expr("missing_up = 0 AND missing_down = 0 AND out_of_range = 0 AND unordered_markets = 0 AND repeated_keys = 0"))


def summary(prices: DataFrame) -> DataFrame:
    """Rows by timeframe."""
    return prices.groupBy("timeframe").agg(F.count("*").alias("n_rows")).orderBy("timeframe")


def tail(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The last n rows of an order, in that order."""
    return df.orderBy(*[F.desc(c) for c in order]).limit(n).orderBy(*order)


def audit(beats: DataFrame, reconnects: DataFrame, max_gap_ms: int = 30_000, threshold: int = 5, window_s: float = 60.0) -> dict[str, DataFrame]:
    """Gaps, bursts and the audited window of the feeds' logs."""
    window = beats.where("ts_ms > 0").agg(F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms"), F.count("*").alias("n_rows"))
    return {"gaps": gaps(beats, ["source", "shard_key", "event_type"], "ts_ms", max_gap_ms), "bursts": bursts(reconnects, ["shard_key"], "ts", threshold, window_s), "window": window}


def new_gaps(now: DataFrame, before: DataFrame) -> DataFrame:
    """Gaps that an earlier audit did not have."""
    return new_findings(now, before, ["source", "shard_key", "event_type", "start_ms", "end_ms"])


def worst(findings: DataFrame, by: str, n: int = 5) -> DataFrame:
    return findings.orderBy(F.desc(by), *[c for c in findings.columns if c != by]).limit(n)


def manifest(findings: dict[str, DataFrame], path: str, **settings: object) -> None:
    """The audit as one JSON document: the settings, and findings as arrays."""
    window, spark = findings["window"], findings["window"].sparkSession
    arrays = [findings[k].agg(F.collect_list(F.struct(*findings[k].columns)).alias(k)) for k in ("gaps", "bursts")]
    out = window.crossJoin(arrays[0]).crossJoin(arrays[1])
    out.select(F.lit(spark.sparkContext.startTime).alias("scan_ts"), *[F.lit(v).alias(k) for k, v in settings.items()], "*").coalesce(1).write.mode("overwrite").json(path)
