"""Writers: appends to staging, partition-wise replacement, merges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..catalog import STAGING
from ..functions.markets import split_categories
from ..operators.dedup import last_by_group, upsert
from ..schemas import CULTURE_MARKETS, CULTURE_PRICES, MARKETS, PRICES, SCHEMA_VERSION, TICKS, Table
from ..sources.hive import canonical, data_files, read_table
from .lake import move, remove, require_room, single_writer, swap


def stamped(df: DataFrame, table: Table) -> DataFrame:
    """Column metadata that carries the schema's version through the Parquet footer."""
    meta = {"schema_version": SCHEMA_VERSION, "table": table.name}
    return df.select(*[F.col(c).alias(c, metadata=meta) for c in df.columns])


def schema_version(df: DataFrame) -> int | None:
    """The version that the files of a table were written with, if they say."""
    return next((f.metadata["schema_version"] for f in df.schema.fields if "schema_version" in f.metadata), None)


def optimise(df: DataFrame, table: Table) -> DataFrame:
    """A frame in the table's columns and types, nulls and what does not parse replaced by the defaults."""
    return canonical(df, table)


def _writer(df: DataFrame, table: Table, mode: str):
    w = stamped(df, table).write.mode(mode).option("compression", "zstd")
    return w.partitionBy(*table.partitions) if table.partitions else w


def _in_order(df: DataFrame, table: Table, order: list[str]) -> DataFrame:
    """Rows in the table's columns, those of one key in one task and in the order of columns that need not be the table's.

    The partition columns lead the sort: a writer that has to sort by them itself drops the sort below. Rows are sent by the
    first two columns of the key, which no fold takes for equal where they differ.
    """
    rows = optimise(df.withColumn("_src_order", F.struct(*order)), table)
    return rows.repartition(*table.partitions, *table.key[:2]).sortWithinPartitions(*table.partitions, "_src_order").drop("_src_order")


def append_staged(df: DataFrame, root: str, table: Table, order: list[str] | None = None) -> None:
    """Append shards to the staging root without reading anything; consolidation folds them into the table.

    order: columns by which the rows of one key follow each other, the latest last; without it their order is open.
    """
    require_room(df.sparkSession, root)
    _writer(_in_order(df, table, order) if order else optimise(df, table), table, "append").parquet(f"{root.rstrip('/')}/{STAGING}/{table.name}")


def append_batch(df: DataFrame, root: str, table: Table, stream: str, batch: int) -> None:
    """Stage a batch of a stream, once however often it is repeated.

    The files are written aside and then moved to names that the stream and the batch give; files that an earlier try
    has left under these names go first.
    """
    spark, staged = df.sparkSession, f"{root.rstrip('/')}/{STAGING}/{table.name}"
    require_room(spark, root)
    name, aside = f"{stream}-{batch:09d}-", f"{root.rstrip('/')}/{STAGING}/_{table.name}-{stream}-{batch:09d}"
    _writer(optimise(df, table), table, "overwrite").parquet(aside)
    for f in data_files(spark, staged):
        if f.rsplit("/", 1)[1].startswith(name):
            remove(spark, f)
    for i, f in enumerate(sorted(data_files(spark, aside))):
        inner = f[f.index(f"_{table.name}-{stream}-{batch:09d}") :].split("/")[1:-1]
        move(spark, f, "/".join([staged, *inner, f"{name}{i:05d}.parquet"]))
    remove(spark, aside)


def append_ticks_only(ticks: DataFrame, root: str, order: list[str] | None = None) -> None:
    append_staged(ticks, root, TICKS, order)


def copy_to(df: DataFrame, path: str) -> None:
    """The rows of any query as zstd Parquet."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)


def replace_partitions(df: DataFrame, path: str, table: Table, sort: list[str] | None = None) -> None:
    """Write a frame over the partitions that it has, and no others.

    The frame may be read from the very partitions that it replaces, so it is written beside them, once, and each
    partition's folder then takes the old one's place. Rows are balanced over tasks by size: a large partition is spread
    over several files and small ones share a task.
    """
    spark, path = df.sparkSession, path.rstrip("/")
    require_room(spark, path.rsplit("/", 1)[0])
    head, _, tail = path.rpartition("/")
    aside = f"{head}/_{tail}.{uuid.uuid4().hex}"
    _writer(balanced(df, table, sort), table, "overwrite").parquet(aside)
    if not table.partitions:
        swap(spark, aside, path)
        return
    for folder in sorted({f.rsplit("/", 1)[0] for f in data_files(spark, aside)}):
        swap(spark, folder, f"{path}/{'/'.join(folder.split('/')[-len(table.partitions) :])}")
    remove(spark, aside)


def balanced(df: DataFrame, table: Table, sort: list[str] | None = None) -> DataFrame:
    """A frame laid out for partitioned writing, in tasks of like size at run time, each sorted."""
    if table.partitions:
        df = df.hint("rebalance", *table.partitions).sortWithinPartitions(*table.partitions, *(sort or []))
    elif sort:
        df = df.hint("rebalance").sortWithinPartitions(*sort)
    return df


def touched(existing: DataFrame, new: DataFrame, table: Table) -> DataFrame:
    """The rows of existing in the partitions of new: a semi-join on the partition columns, which prunes the scan at run time.

    What is broadcast is a row a partition directory, which the driver has listed for the scan already.
    """
    return existing.join(F.broadcast(new.select(*table.partitions).distinct()), list(table.partitions), "left_semi") if table.partitions else existing


def _merge(new: DataFrame, path: str, table: Table) -> None:
    spark = new.sparkSession
    new = optimise(new, table)
    existing = read_table(spark, path, table)
    merged = upsert(touched(existing, new, table), new, [*table.partitions, *table.key])
    replace_partitions(merged.select(*table.schema.fieldNames()), path, table, list(table.key))


def split_markets_prices(flat: DataFrame, order: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    """Collected rows as a market table (the last known value of every column) and a price table."""
    markets = [c for c in MARKETS.columns if c in flat.columns]
    prices = [c for c in (*PRICES.columns, *PRICES.partitions) if c in flat.columns]
    return optimise(last_by_group(flat.select(*markets, *([] if order in markets else [F.col(order).alias("_order")])), ["market_id"], "_order"), MARKETS), flat.select(*prices)


def split_culture(flat: DataFrame, order: str = "timestamp") -> tuple[DataFrame, DataFrame]:
    markets = [c for c in CULTURE_MARKETS.columns if c in flat.columns]
    prices = [c for c in (*CULTURE_PRICES.columns, *CULTURE_PRICES.partitions) if c in flat.columns]
    return optimise(last_by_group(flat.select(*markets, F.col(order).alias("_order")), ["market_id"], "_order"), CULTURE_MARKETS), flat.select(*prices)


def persist(markets: DataFrame, prices: DataFrame, root: str, culture: bool = False) -> None:
    """Merge markets by id and prices by key into the tables; of prices only the partitions that get new rows are rewritten."""
    dim, fact = (CULTURE_MARKETS, CULTURE_PRICES) if culture else (MARKETS, PRICES)
    root = root.rstrip("/")
    with single_writer(prices.sparkSession, root):
        _merge(markets, f"{root}/markets.parquet", dim)
        _merge(prices, f"{root}/prices", fact)


def persist_routed(flat: DataFrame, root: str, culture_root: str) -> None:
    """Route collected rows by category into the two lakehouses."""
    crypto, culture = split_categories(flat)
    persist(*split_markets_prices(crypto), root)
    persist(*split_culture(culture), culture_root, culture=True)


def persist_ticks(ticks: DataFrame, root: str) -> None:
    """Append and consolidate."""
    from .consolidate import consolidate_ticks

    append_ticks_only(ticks, root)
    consolidate_ticks(ticks.sparkSession, root)
