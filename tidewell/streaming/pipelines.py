"""Streams: messages into staged tables, windows, deduplication."""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.wire import parse_books, parse_price_changes, parse_spot, parse_trades
from ..schemas import HEARTBEATS, ORDERBOOK, PRICES, SPOT_PRICES, TICKS, Table
from ..storage.writers import append_batch

TRIGGER = "5 seconds"


def message_files(spark: SparkSession, path: str, schema: str = "value string, recv_ns bigint", per_batch: int = 100) -> DataFrame:
    """A stream of message files; how many a batch takes at most is the back pressure."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(path)


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def replay(spark: SparkSession, path: str, schema: str, event_time: str | None = None) -> DataFrame:
    """Parquet as a stream, with the event time as a timestamp that watermarks accept."""
    folder, name = path.rstrip("/").rsplit("/", 1)
    df = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else spark.readStream.schema(schema).parquet(path)
    return df.withColumn(event_time, F.col(event_time).cast("timestamp")) if event_time else df


def route(messages: DataFrame, body: str = "value") -> dict[str, DataFrame]:
    """Messages by their kind: a list or a book is a snapshot, others go by event_type, spot updates by type."""
    kind = F.get_json_object(body, "$.event_type")
    listed = F.ltrim(F.col(body)).startswith("[")
    books = messages.where(listed).withColumn(body, F.explode(F.from_json(body, "array<string>"))).unionByName(messages.where(kind == "book"))
    return {"books": parse_books(books, body), "changes": parse_price_changes(messages.where(kind == "price_change"), body), "trades": parse_trades(messages.where(kind == "last_trade_price"), body), "spot": parse_spot(messages.where(F.get_json_object(body, "$.type") == "update"), body)}


def allowed(spot: DataFrame, topics: dict[str, list[str]]) -> DataFrame:
    """Spot updates of the topics and symbols that are asked for."""
    ok = F.lit(False)
    for topic, symbols in topics.items():
        ok = ok | (F.col("topic") == topic) & F.col("symbol").isin(symbols)
    return spot.where(ok)


def stage_stream(stream: DataFrame, root: str, table: Table, checkpoint: str, rows: Callable[[DataFrame], DataFrame] = lambda df: df, once: bool = False, name: str | None = None) -> StreamingQuery:
    """Append every micro-batch to a table's staging root, once however often it is tried: its files are named by the stream and the batch.

    name tells streams into one table apart; without one it is drawn from the checkpoint's place.
    """
    name = name or f"{zlib.crc32(checkpoint.encode()):08x}"
    writer = stream.writeStream.foreachBatch(lambda df, batch: append_batch(rows(df), root, table, name, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=TRIGGER)).start()


def subscriptions(tokens: DataFrame, size: int = 500) -> DataFrame:
    """(shard, tokens): the distinct tokens in the lists of at most so many that one connection subscribes to, by their order."""
    rank = F.row_number().over(Window.partitionBy().orderBy("token_id")) - 1
    named = tokens.select("token_id").where("token_id <> ''").distinct().select("token_id", F.floor(rank / size).cast("int").alias("shard"))
    return named.groupBy("shard").agg(F.sort_array(F.collect_list("token_id")).alias("tokens"))


class Refreshed:
    """A table that is loaded again once it is older than every_s, as for a stream's lookups: each batch takes what get() gives.

    A load that fails keeps the table that was loaded before, and is tried again with the next batch.
    """

    def __init__(self, load: Callable[[], DataFrame], every_s: float = 3600.0, clock: Callable[[], float] = time.monotonic) -> None:
        self.load, self.every_s, self.clock = load, every_s, clock
        self._held: DataFrame | None = None
        self._at = 0.0

    def get(self) -> DataFrame:
        if self._held is None or self.clock() - self._at >= self.every_s:
            try:
                self._held, self._at = self.load(), self.clock()
            except Exception:
                if self._held is None:
                    raise
        return self._held


def staged_tables() -> dict[str, Table]:
    """The tables that live streams append to."""
    return {t.name: t for t in (TICKS, PRICES, ORDERBOOK, SPOT_PRICES, HEARTBEATS)}


def tumbling(events: DataFrame, ts: str, width: str, keys: list[str], late: str | None = None) -> DataFrame:
    """Counts and sums of value by window of fixed width."""
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,2)")).alias("total"))
    return out.select(F.col("window.start").alias("window_start"), *keys, "n", F.col("total").cast("double").alias("total"))


def sliding(events: DataFrame, ts: str, width: str, step: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    return df.groupBy(F.window(ts, width, step), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), *keys, "n")


def session_counts(events: DataFrame, ts: str, pause: str, keys: list[str], late: str | None = None) -> DataFrame:
    df = events.withWatermark(ts, late) if late else events
    out = df.groupBy(F.session_window(ts, pause), *keys).agg(F.count("*").alias("n"))
    return out.select(F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), *keys, "n")


def dedup(events: DataFrame, ts: str, keys: list[str], late: str = "1 hour") -> DataFrame:
    """First rows by key; state lives as long as the watermark allows."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(keys)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there and give the result as a table. Complete and update results replace, appended ones add."""
    spark = stream.sparkSession

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("append" if mode == "append" else "overwrite").parquet(path if mode == "append" else f"{path}/latest")

    stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(path if mode == "append" else f"{path}/latest")
