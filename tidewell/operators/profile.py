"""The profile of a tick dataset."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

QUANTILES = (0.05, 0.25, 0.5, 0.75, 0.95, 0.99)


def scale(ticks: DataFrame) -> DataFrame:
    """Rows, exact and approximate distinct keys, markets and tokens."""
    key = F.concat_ws("|", "tx_hash", F.col("log_index").cast("string"), F.coalesce("order_hash", F.lit("")))
    return ticks.agg(F.count("*").alias("ticks"), F.approx_count_distinct(key).alias("distinct_trades"), F.countDistinct("market_id").alias("markets"), F.countDistinct("token_id").alias("tokens"))


def time_range(df: DataFrame, ts_ms: str = "timestamp_ms") -> DataFrame:
    return df.agg(F.timestamp_millis(F.min(ts_ms)).alias("first"), F.timestamp_millis(F.max(ts_ms)).alias("last"), F.round((F.max(ts_ms) - F.min(ts_ms)) / 86_400_000, 2).alias("days"))


def moments(df: DataFrame, column: str) -> DataFrame:
    v = F.col(column).cast("double")
    return df.agg(F.min(v).alias("low"), F.max(v).alias("high"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("deviation"), F.sum(v).alias("total"))


#: Steps that an interval is divided into at once, and rows of a step that are read.
STEPS, FEW = 1024, 10_000


def quantiles(df: DataFrame, column: str, at: tuple[float, ...] = QUANTILES, exact: bool = False, accuracy: int = 10_000) -> DataFrame:
    """Quantiles as columns q5, q25, ...; by a bounded sketch, or exactly by interpolation. Nulls do not count."""
    names = [f"q{round(q * 100)}" for q in at]
    v = F.col(column).cast("double")
    if not exact:
        return df.agg(F.percentile_approx(v, list(at), accuracy).alias("_q")).select(*[F.col("_q")[i].alias(n) for i, n in enumerate(names)])
    found = _ranked(df.select(v.alias("v")).where("v IS NOT NULL"), at)
    return df.sparkSession.createDataFrame([tuple(found)], ", ".join(f"{n} double" for n in names))


def _ranked(values: DataFrame, at: tuple[float, ...]) -> list[float | None]:
    """Exact quantiles of a column v by selection: each pass counts the values in steps of the intervals that hold the wanted ranks
    and narrows these, until a step holds one value or few rows. No task sorts or holds the values."""
    n, low, high, odd = values.agg(F.count("*"), F.min("v"), F.max("v"), F.sum(F.isnan("v").cast("long"))).first()
    if not n:
        return [None] * len(at)
    known: dict[int, float] = {}
    if odd:  # not-a-number is above all numbers
        known = {r: float("nan") for q in at for r in _ends(q, n) if r >= n - odd}
        low, high = values.where(~F.isnan("v")).agg(F.min("v"), F.max("v")).first()
    ranks = sorted({r for q in at for r in _ends(q, n)} - set(known))
    # open intervals: lowest and highest value, rows, and rows below
    open_ = {(low, high, n - odd, 0): ranks}
    while open_:
        steps, few = {}, []
        for (lo, hi, rows, below), wanted in open_.items():
            if lo == hi:
                known |= dict.fromkeys(wanted, lo)
            elif rows <= FEW:
                few.append((lo, hi, below, wanted))
            else:
                steps[lo, hi, below] = wanted
        if few:
            inside = F.lit(False)
            for lo, hi, _, _ in few:
                inside = inside | F.col("v").between(lo, hi)
            held = sorted(r.v for r in values.where(inside).collect())
            for lo, hi, below, wanted in few:
                mine = [x for x in held if lo <= x <= hi]
                known |= {r: mine[r - below] for r in wanted}
        open_ = {}
        if not steps:
            break
        which, step = F.lit(None).cast("int"), F.lit(None).cast("int")
        for i, (lo, hi, _) in enumerate(steps):
            mine = F.col("v").between(lo, hi)
            which = F.when(mine, F.lit(i)).otherwise(which)
            step = F.when(mine, F.least(F.floor((F.col("v") - lo) / F.lit(hi - lo) * STEPS), F.lit(STEPS - 1)).cast("int")).otherwise(step)
        counts = values.select("v", which.alias("i"), step.alias("s")).where("i IS NOT NULL").groupBy("i", "s").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("i", "s").collect()
        for i, ((_, _, below), wanted) in enumerate(steps.items()):
            for r in (c for c in counts if c.i == i):
                inner = [x for x in wanted if below <= x < below + r.n]
                if inner:
                    open_[r.lo, r.hi, r.n, below] = inner
                below += r.n
    out = []
    for q in at:
        a, b = _ends(q, n)
        out.append(known[a] + (known[b] - known[a]) * ((n - 1) * q - a))
    return out


def _ends(q: float, n: int) -> tuple[int, int]:
    """The ranks (from 0) between which a quantile of n rows lies."""
    at = (n - 1) * q
    return math.floor(at), min(math.ceil(at), n - 1)


def histogram(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column)


def daily(ticks: DataFrame) -> DataFrame:
    day = F.to_date(F.timestamp_millis("timestamp_ms"))
    return ticks.groupBy(day.alias("day")).agg(F.count("*").alias("ticks"), F.countDistinct("market_id").alias("markets"), F.sum(F.col("size_usdc").cast("double")).alias("notional")).orderBy("day")


def ticks_per_market(ticks: DataFrame) -> DataFrame:
    """How many ticks markets have; quartiles and the 95th percentile are of those that occur (the lower of two)."""
    n = ticks.groupBy("market_id").agg(F.count("*").alias("n"))
    return n.agg(F.min("n").alias("low"), F.max("n").alias("high"), F.avg("n").alias("mean"), F.percentile_approx("n", [0.25, 0.5, 0.75, 0.95], 1_000_000).alias("_q")).select("low", "high", "mean", *[F.col("_q")[i].alias(f"q{q}") for i, q in enumerate((25, 50, 75, 95))])


def density(ticks: DataFrame) -> DataFrame:
    seconds = (F.max("timestamp_ms") - F.min("timestamp_ms")) / 1000
    return ticks.agg(F.try_divide(F.count("*"), seconds).alias("per_second"), F.try_divide(F.count("*").cast("double"), F.countDistinct("market_id")).alias("per_market"))


def filled(df: DataFrame, column: str) -> DataFrame:
    """The share of rows in which a column has a value, in per cent."""
    return df.agg(F.try_divide(100.0 * F.count(column), F.count("*")).alias("percent"))


def by_feed(spots: DataFrame) -> DataFrame:
    return spots.groupBy("symbol", "source").agg(F.count("*").alias("n"), F.min("ts_ms").alias("first_ms"), F.max("ts_ms").alias("last_ms")).orderBy("symbol", "source")


def profile(ticks: DataFrame, spots: DataFrame | None = None) -> dict[str, DataFrame]:
    """All parts of the profile by name; each is one aggregate that runs when it is read."""
    parts = {
        "scale": scale(ticks),
        "time": time_range(ticks),
        "price": moments(ticks, "price"),
        "size": moments(ticks, "size_usdc"),
        "price quantiles": quantiles(ticks, "price"),
        "size quantiles": quantiles(ticks, "size_usdc"),
        "sides": histogram(ticks, "side"),
        "outcomes": histogram(ticks, "outcome"),
        "days": daily(ticks),
        "ticks per market": ticks_per_market(ticks),
        "density": density(ticks),
        "spot coverage": filled(ticks, "spot_price_usdt"),
    }
    return parts | ({"spot feeds": by_feed(spots)} if spots is not None else {})
