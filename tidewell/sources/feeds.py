"""Paged web feeds as batch data sources.

The transport is a parameter (a picklable function from a request to a decoded response), so a feed runs
against a service, a recording or a test alike. Requests are divided into partitions, and each pages on its executor.
"""

from __future__ import annotations

import random
import sys
import time
from collections.abc import Callable, Iterator
from typing import Any

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Fetch = Callable[[dict], Any]

# workers of data sources start without the session's path, so what they run travels whole
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Busy(Exception):
    """A response that asks to wait: seconds, if the service said how long."""

    def __init__(self, seconds: float | None = None) -> None:
        super().__init__(seconds)
        self.seconds = seconds


def patient(fetch: Fetch, attempts: int = 5, ceiling_s: float = 30.0, sleep: Callable[[float], None] = time.sleep) -> Fetch:
    """Tries again after Busy and connection faults, with growing and scattered pauses."""

    def run(request: dict) -> Any:
        for n in range(attempts):
            try:
                return fetch(request)
            except (Busy, OSError) as error:
                if n + 1 == attempts:
                    raise
                told = getattr(error, "seconds", None)
                sleep(told if told is not None else random.uniform(0.5, 1.5) * min(2.0**n, ceiling_s))

    return run


def offset_pages(fetch: Fetch, request: dict, size: int = 500, stop: Callable[[list[dict]], bool] | None = None) -> Iterator[dict]:
    """Records page by page until a short page, or until stop says that a page reaches back far enough."""
    offset = 0
    while True:
        page = fetch({**request, "limit": size, "offset": offset}) or []
        yield from page
        if len(page) < size or stop and stop(page):
            return
        offset += size


def cursor_pages(fetch: Fetch, request: dict, size: int = 1000, most: int = 1000) -> Iterator[dict]:
    """Records in the order of their id, each page behind the last id; a page that does not advance ends it with an error."""
    last = ""
    for _ in range(most):
        page = fetch({**request, "first": size, "id_gt": last}) or []
        yield from page
        if len(page) < size:
            return
        if page[-1]["id"] <= last:
            raise RuntimeError(f"the feed does not advance behind {last!r}")
        last = page[-1]["id"]
    raise RuntimeError("the feed has more pages than it may have")


def chunked(fetch: Fetch, request: dict, step: int) -> Iterator[dict]:
    """Points of [start, end] in chunks of step."""
    at = request["start"]
    while at < request["end"]:
        to = min(at + step, request["end"])
        yield from fetch({**request, "start": at, "end": to}) or []
        at = to + 1


def single(fetch: Fetch, request: dict) -> Iterator[dict]:
    """The one record that answers a request, with the request's own fields; no answer, no record."""
    found = fetch(request)
    if isinstance(found, dict):
        yield {**request, **found}


PAGING: dict[str, Callable[..., Iterator[dict]]] = {"offset": offset_pages, "cursor": cursor_pages, "chunked": chunked, "single": single}
#: Columns that a feed's schema may ask for besides the records' fields: the request's number, and the record's within it.
REQUEST, RECORD = "_request", "_record"


def feed_source(name: str, schema: str, fetch: Fetch, requests: list[dict], paging: str = "offset", **options: Any) -> type[DataSource]:
    """A data source class that reads every request in a partition of its own."""
    fields = [p.strip().split()[0].strip("`") for p in schema.split(",")] if "<" not in schema else None

    class Reader(DataSourceReader):
        def partitions(self) -> list[InputPartition]:
            return [InputPartition((i, r)) for i, r in enumerate(requests)]

        def read(self, partition: InputPartition) -> Iterator[tuple]:
            number, request = partition.value
            for i, record in enumerate(PAGING[paging](patient(fetch), request, **options)):
                known = {REQUEST: number, RECORD: i}
                yield tuple(known[f] if f in known else record.get(f) for f in fields)

    class Feed(DataSource):
        @classmethod
        def name(cls) -> str:
            return name

        def schema(self) -> str:
            return schema

        def reader(self, schema: Any) -> DataSourceReader:
            return Reader()

    return Feed


def read_feed(spark: SparkSession, name: str, schema: str, fetch: Fetch, requests: list[dict], paging: str = "offset", **options: Any) -> DataFrame:
    if not requests:
        return spark.createDataFrame([], schema)
    spark.dataSource.register(feed_source(name, schema, fetch, requests, paging, **options))
    return spark.read.format(name).load()


def read_markets(spark: SparkSession, fetch: Fetch, requests: list[dict], since: str | None = None) -> DataFrame:
    """Raw market records (id, body as JSON) of several listings; the first listing that has an id gives it."""
    stop = (lambda page: any((r.get("closedTime") or "9") < since for r in page)) if since else None
    df = read_feed(spark, "market_pages", f"id string, closedTime string, body string, {REQUEST} int, {RECORD} int", fetch, requests, "offset", stop=stop)
    first = F.min_by(F.struct("closedTime", "body"), F.struct(REQUEST, RECORD))
    return df.groupBy("id").agg(first.alias("_r")).select("id", "_r.closedTime", "_r.body")


def read_fee_rates(spark: SparkSession, fetch: Fetch, tokens: list[str]) -> DataFrame:
    """(token_id, fee_rate_bps): the taker fee of each token whose answer has a whole base_fee."""
    df = read_feed(spark, "fee_rates", "token_id string, base_fee string", fetch, [{"token_id": t} for t in tokens], "single")
    return df.select("token_id", F.col("base_fee").try_cast("int").alias("fee_rate_bps")).where("fee_rate_bps IS NOT NULL")


def read_last_trades(spark: SparkSession, fetch: Fetch, tokens: list[str]) -> DataFrame:
    """(token_id, price, side): the last trade of each token that has a price in [0, 1]."""
    df = read_feed(spark, "last_trades", "token_id string, price string, side string", fetch, [{"token_id": t} for t in tokens], "single")
    return df.select("token_id", F.col("price").try_cast("double").alias("price"), F.upper("side").alias("side")).where("price BETWEEN 0 AND 1")


def read_price_history(spark: SparkSession, fetch: Fetch, tokens: list[dict], step: int = 7 * 86400) -> DataFrame:
    """(token_id, t, p): price points in [0, 1]."""
    return read_feed(spark, "price_history", "token_id string, t bigint, p double", fetch, tokens, "chunked", step=step).where("p BETWEEN 0 AND 1")


def klines(raw: DataFrame, symbol: str, body: str = "kline") -> DataFrame:
    """Positional candles as spot prices: the close, at the closing time."""
    at = lambda i: F.element_at(F.col(body), i)
    return raw.select(at(7).try_cast("bigint").alias("ts_ms"), F.lit(symbol.lower()).alias("symbol"), at(5).try_cast("double").alias("price"), F.lit("binance").alias("source")).where("ts_ms IS NOT NULL AND price > 0")


def second_grid(markets: DataFrame, span: dict[str, int]) -> DataFrame:
    """(market_id, crypto, ts): each second of the last span (by timeframe) before a market's end."""
    length = F.coalesce(*[F.when(F.col("timeframe") == k, F.lit(v)) for k, v in span.items()], F.lit(None).cast("int"))
    return markets.select("market_id", "crypto", F.explode(F.sequence(F.col("end_ts") - length, F.col("end_ts"))).alias("ts"))


def scaled_price(price: str = "price", exponent: str = "expo"):
    """Whole-number oracle prices as doubles."""
    return F.col(price).cast("double") * F.pow(F.lit(10.0), F.col(exponent))
