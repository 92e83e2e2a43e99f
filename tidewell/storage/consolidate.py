"""Consolidation: staged shards into table parts, parts into fewer parts, tables into a publication.

A pass reads what is staged when it begins, writes the result, and only then removes the inputs: a crash in
between leaves duplicates that the next pass folds, never a loss.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import STAGING, VIEWS
from ..operators.dedup import WRITERS, dedup_orderbook, dedup_ticks, keep_last, merge_columns
from ..schemas import CULTURE_PRICES, HEARTBEATS, ORDERBOOK, PRICES, SPOT_PRICES, TICKS, Table
from ..sources.hive import canonical, data_files, path_exists, read_drifting
from .lake import read_text, remove, require_room, single_writer, write_text
from .writers import _writer, balanced, replace_partitions, touched

#: A partition with so many parts is folded into one.
PARTS = 32


def _staged(root: str, table: Table) -> str:
    return f"{root.rstrip('/')}/{STAGING}/{table.name}"


def _fold(spark: SparkSession, root: str, table: Table, rows: Callable[[DataFrame], DataFrame], with_table: bool, sort: list[str] | None = None) -> int:
    """Fold the staged files; how many there were. with_table: merge them with the partitions they belong to, else append a part.

    One driver at a time folds a lakehouse.
    """
    with single_writer(spark, root):
        return _folded(spark, root, table, rows, with_table, sort)


def _folded(spark: SparkSession, root: str, table: Table, rows: Callable[[DataFrame], DataFrame], with_table: bool, sort: list[str] | None) -> int:
    staged, path = _staged(root, table), f"{root.rstrip('/')}/{_place(table)}"
    files = data_files(spark, staged)
    if not files:
        return 0
    new = read_drifting(spark, staged, table, track=True)
    if with_table and data_files(spark, path):
        old = read_drifting(spark, path, table, track=True)
        if table.partitions:
            old = touched(old, new, table)
        new = old.unionByName(new)
    out = canonical(rows(new), table).select(*table.schema.fieldNames())
    if with_table:
        replace_partitions(out, path, table, sort)
    else:
        require_room(spark, root)
        _writer(balanced(out, table), table, "append").parquet(path)
    for f in files:
        remove(spark, f)
    return len(files)


def _place(table: Table) -> str:
    return {"culture_prices": "prices"}.get(table.name, table.name)


def consolidate_ticks(spark: SparkSession, root: str, compact_at: int = PARTS) -> int:
    """Staged ticks as a new part of each partition: overridden legacy rows dropped, the rest merged by key.

    Earlier parts are left alone until a partition has compact_at of them.
    """
    n = _fold(spark, root, TICKS, _ticks, with_table=False)
    compact(spark, root, TICKS, _ticks, compact_at)
    return n


def _ticks(df: DataFrame) -> DataFrame:
    return dedup_ticks(df, F.struct(*WRITERS), TICKS.partitions)


def _book(df: DataFrame) -> DataFrame:
    return dedup_orderbook(df, ORDERBOOK.partitions)


def consolidate_orderbook(spark: SparkSession, root: str, compact_at: int = PARTS) -> int:
    n = _fold(spark, root, ORDERBOOK, _book, with_table=False)
    compact(spark, root, ORDERBOOK, _book, compact_at)
    return n


def consolidate_prices(spark: SparkSession, root: str, culture: bool = False) -> int:
    """Partitions that have staged prices, merged by key into sorted parts."""
    table = CULTURE_PRICES if culture else PRICES
    key = [*table.partitions, *table.key]
    return _fold(spark, root, table, lambda df: merge_columns(df, key, F.struct(*WRITERS)), True, list(table.key))


def consolidate_spot_prices(spark: SparkSession, root: str) -> int:
    return _fold(spark, root, SPOT_PRICES, lambda df: keep_last(df, list(SPOT_PRICES.key), list(WRITERS)), True, ["ts_ms"])


def consolidate_heartbeats(spark: SparkSession, root: str, strict_key: bool = False) -> int:
    """Heartbeats by (ts_ms, source, shard_key), latest writer last; strict_key also tells event types apart."""
    key = [*HEARTBEATS.key, *(["event_type"] if strict_key else [])]
    return _fold(spark, root, HEARTBEATS, lambda df: keep_last(df, key, list(WRITERS)), True, ["ts_ms"])


def compact(spark: SparkSession, root: str, table: Table, rows: Callable[[DataFrame], DataFrame], at: int = PARTS) -> list[str]:
    """Fold the partitions that have at parts or more into as few parts as their size asks for: their paths."""
    with single_writer(spark, root):
        return _compacted(spark, root, table, rows, at)


def _compacted(spark: SparkSession, root: str, table: Table, rows: Callable[[DataFrame], DataFrame], at: int) -> list[str]:
    path = f"{root.rstrip('/')}/{_place(table)}"
    by: dict[str, list[str]] = {}
    for f in data_files(spark, path):
        by.setdefault(f.rsplit("/", 1)[0], []).append(f)
    full = sorted(p for p, files in by.items() if len(files) >= at)
    if full:
        frames = read_drifting(spark, path, table, track=True)
        names = [dict(x.split("=", 1) for x in p.split("/") if "=" in x) for p in full]
        condition = F.lit(False)
        for n in names:
            one = F.lit(True)
            for k, v in n.items():
                one = one & (F.col(k) == v)
            condition = condition | one
        replace_partitions(canonical(rows(frames.where(condition)), table).select(*table.schema.fieldNames()), path, table)
    return full


def consolidate_all(spark: SparkSession, root: str) -> dict[str, int]:
    return {"ticks": consolidate_ticks(spark, root), "orderbook": consolidate_orderbook(spark, root), "prices": consolidate_prices(spark, root), "culture_prices": consolidate_prices(spark, root, culture=True), "spot_prices": consolidate_spot_prices(spark, root), "heartbeats": consolidate_heartbeats(spark, root)}


def publish(spark: SparkSession, root: str, target: str) -> list[str]:
    """Consolidate and copy the tables (no staged shards) to another folder; tables that are gone here are removed there."""
    with single_writer(spark, root):
        consolidate_all(spark, root)
        return _published(spark, root, target)


def _published(spark: SparkSession, root: str, target: str) -> list[str]:
    done = []
    for name, (place, table) in VIEWS.items():
        source, to = f"{root.rstrip('/')}/{place}", f"{target.rstrip('/')}/{place}"
        if path_exists(spark, source):
            _writer(spark.read.parquet(source), table, "overwrite").parquet(to)
            done.append(name)
        elif path_exists(spark, to):
            remove(spark, to)
    return done


def save_checkpoint(spark: SparkSession, path: str, value: int) -> None:
    """A scan's high-water mark, replaced in one step."""
    write_text(spark, path, json.dumps({"high_water": value}))


def load_checkpoint(spark: SparkSession, path: str) -> int | None:
    """The mark, or null where there is none that can be read."""
    try:
        return int(json.loads(read_text(spark, path) or "")["high_water"])
    except (ValueError, KeyError, TypeError):
        return None
