"""Log readers: heartbeats, reconnect lines and failed windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import HEARTBEATS, RECONNECTS
from .hive import path_exists, read_drifting


def heartbeats(spark: SparkSession, root: str) -> DataFrame:
    """All heartbeat shards; unreadable ones are left out."""
    return read_drifting(spark, root, HEARTBEATS)


def reconnects(spark: SparkSession, folder: str, name: str = "ws_reconnects.jsonl") -> DataFrame:
    """Lines of the reconnect log and of its rotated parts, without blank, broken, timeless or keyless ones."""
    pattern = f"{folder.rstrip('/')}/{name}*"
    if not path_exists(spark, pattern):
        return spark.createDataFrame([], RECONNECTS)
    df = spark.read.schema(RECONNECTS).option("mode", "DROPMALFORMED").json(pattern)
    return df.where("ts > 0 AND shard_key <> ''")


def failed_windows(spark: SparkSession, path: str) -> DataFrame:
    """(window_start, window_end): the distinct windows that a text log calls failed, in order."""
    text = spark.read.text(path)
    found = text.select(F.regexp_extract_all("value", F.lit(r"Window (\[\d+, \d+\]) failed"), F.lit(1)).alias("w")).select(F.explode("w").alias("w"))
    start, end = (F.regexp_extract("w", rf"\[(\d+), (\d+)\]", i).cast("bigint") for i in (1, 2))
    return found.select(start.alias("window_start"), end.alias("window_end")).distinct().orderBy("window_start", "window_end")


def match_failed(windows: DataFrame, failed: DataFrame) -> DataFrame:
    """Failed windows with the markets of the same window; matched is false for those no market has."""
    keys = ["window_start", "window_end"]
    joined = failed.join(windows.withColumn("_m", F.lit(True)), keys, "left")
    return joined.withColumn("matched", F.coalesce("_m", F.lit(False))).drop("_m")
