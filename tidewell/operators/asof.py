"""Point-in-time joins without pair enumeration.

Both sides are laid into one sequence by key and time, and a window carries the latest right row
forward: one exchange on the key and one sort, however many rows a key has on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_on: str, right_on: str, values: list[str], tolerance: Column | int | None = None, tie: list[str] | None = None, bucket: int | None = None) -> DataFrame:
    """Left rows with the values of the latest right row of the same key whose time is not later.

    The match is whole: where the right row has nulls, they come along. Of right rows of one time the
    greatest by tie (default: by the values in order) counts. With a tolerance, older matches are null. Every left row stays once.
    Null keys match nothing.

    bucket: for keys with very many rows, the length of time that one task takes of a key. What a stretch of time
    hands to the next (its last right row) is found from one row a stretch, so no task has to see a whole key.
    """
    payload = F.struct(F.col(right_on).alias("_at"), *[F.col(v).alias(v) for v in values])
    keys = [F.col(k) for k in by]
    stretch = lambda c: (F.floor(F.col(c) / bucket) if bucket else F.lit(0)).cast("bigint").alias("_b")
    l = left.select(F.struct(*left.columns).alias("_l"), *keys, F.col(left_on).alias("_t"), F.lit(None).alias("_r"), F.lit(1).alias("_side"), F.lit(None).alias("_tie"), stretch(left_on))
    r = right.select(F.lit(None).alias("_l"), *keys, F.col(right_on).alias("_t"), payload.alias("_r"), F.lit(0).alias("_side"), F.struct(*(tie or values)).alias("_tie"), stretch(right_on))
    for k in by:
        r = r.where(F.col(k).isNotNull())
    both = l.unionByName(r)
    before = Window.partitionBy(*by, "_b").orderBy("_t", "_side", "_tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = both.withColumn("_m", F.last("_r", ignorenulls=True).over(before)).where("_side = 1")
    if bucket:
        last = r.groupBy(*by, "_b").agg(F.max_by("_r", F.struct("_t", "_tie")).alias("_last"))
        stretches = l.select(*by, "_b").distinct().join(last, [*by, "_b"], "full")
        earlier = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        handed = stretches.select(*by, "_b", F.last("_last", ignorenulls=True).over(earlier).alias("_handed"))
        out = out.join(handed, [*by, "_b"], "left").withColumn("_m", F.coalesce("_m", "_handed"))
    known = F.lit(True)
    for k in by:
        known = known & F.col(k).isNotNull()
    if tolerance is not None:
        known = known & (F.col("_t") - F.col("_m._at") <= tolerance)
    hit = F.when(known, F.col("_m"))
    return out.select("_l.*", hit["_at"].alias(f"{right_on}_match"), *[hit[v].alias(v if v not in left.columns else f"{v}_match") for v in values])


#: Spot prices have a handful of keys, so a task takes so many milliseconds of one.
SPOT_BUCKET_MS = 3_600_000


def spot_at(ticks: DataFrame, spots: DataFrame, stale_ms: int | None = None, now: Column | None = None) -> DataFrame:
    """Ticks with the latest spot price of their asset at or before them.

    spots: (crypto, ts_ms, price); of prices of one time the greatest counts. With stale_ms the price must be no older than that at
    the time the tick was received (now, by default local_recv_ts_ns), so that a replay gives what the live stream gave.
    """
    ticks = ticks.drop("spot_price_usdt", "spot_price_ts_ms")
    right = spots.select("crypto", "ts_ms", F.col("price").alias("spot_price_usdt"))
    out = asof_join(ticks, right, ["crypto"], "timestamp_ms", "ts_ms", ["spot_price_usdt"], bucket=SPOT_BUCKET_MS).withColumnRenamed("ts_ms_match", "spot_price_ts_ms")
    if stale_ms is None:
        return out
    received = now if now is not None else F.coalesce(F.floor(F.col("local_recv_ts_ns") / 1_000_000), F.col("timestamp_ms"))
    fresh = received - F.col("spot_price_ts_ms") <= stale_ms
    return out.withColumn("spot_price_usdt", F.when(fresh, F.col("spot_price_usdt"))).withColumn("spot_price_ts_ms", F.when(fresh, F.col("spot_price_ts_ms")))


def align_sides(points: DataFrame, key: list[str], ts: str, side: str, price: str, sides: tuple[str, str] = ("up", "down"), default: float = 0.5) -> DataFrame:
    """One row per key and time at which either side has a price, with both sides' latest prices; a side without one yet has the default.

    Of several prices of a side at one time the greatest counts.
    """
    wide = points.groupBy(*key, ts).agg(*[F.max(F.when(F.col(side) == s, F.col(price))).alias(s) for s in sides])
    wide = wide.where(" OR ".join(f"{s} IS NOT NULL" for s in sides))
    so_far = Window.partitionBy(*key).orderBy(ts).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return wide.select(*key, ts, *[F.coalesce(F.last(s, ignorenulls=True).over(so_far), F.lit(default)).alias(f"{s}_price") for s in sides])


def forward_fill(df: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Nulls of the columns replaced by the latest value before them."""
    so_far = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(so_far) for c in columns})
