"""Working tables in the folder that all executors share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; only where it is unset and all runs on one machine (tests), a folder of our own."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='tidewell-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def table_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it back, which cuts the lineage and outlives any executor."""
    path = table_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._working_path = path
    return out


def discard(written: DataFrame) -> None:
    """Delete a table of materialise() that nothing reads any more."""
    _delete(written.sparkSession, written._working_path)


def clear(spark: SparkSession) -> None:
    """Delete all working tables of this application: when its results have been written, none of them is read again."""
    _delete(spark, f"{shared_dir(spark)}/tidewell/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def is_scan(df: DataFrame) -> bool:
    """Whether a table is read from files as it is, without anything done to it."""
    return df._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation"


#: Input bytes on disk that a block of a packed exchange is meant for, whatever the session is set to.
BLOCK_BYTES = 64 << 20


def blocks(docs: DataFrame) -> int:
    """How many blocks a packed exchange of a table has: by its bytes, and no fewer than the shuffle partitions that the session is set to."""
    count = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if is_scan(docs):
        # the sum of the files' lengths, as the planner has it
        count = max(count, -(-int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // BLOCK_BYTES))
    return count


def gathered(df: DataFrame, count: int, key: str, merge: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """merge() of all rows of each block (key, 0 to count - 1).

    A block is a partition of its own, so no task gets two by the chance of a hash, and blocks of like size make tasks of like size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            table = merge(pa.Table.from_batches(held))
            del held
            yield from table.to_batches()
            del table
        trim()

    return df.repartitionById(count, F.col(key)).mapInArrow(run, schema)


def trimmed(run: Callable) -> Callable:
    """A function of batches that gives its memory back when it has ended, as a worker goes on to other tasks."""

    def ended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        trim()

    return ended


def trim() -> None:
    """Give memory that a worker has freed back to the machine, where the C library can."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass


def least_hashed(df: DataFrame, key: str, limit: int, count: int) -> DataFrame:
    """The rows of the limit least hashes of a key, out of about count rows.

    Rows that cannot be among them (with a margin of half) are dropped where they are, so that the tasks
    together hand on little more than limit rows however many there are.
    """
    h = F.xxhash64(key)
    if count > 2 * limit:
        df = df.where(h < int(-(2**63) + 2**64 * 1.5 * limit / count))
    return df.orderBy(h, key).limit(limit)


#: A written table of at most so many rows (of a few integers each) is broadcast; a larger one is joined by shuffle.
BROADCAST_ROWS = 1_000_000


def fresh(name: str, taken: list[str]) -> str:
    """A column name that none of the taken ones clashes with, whatever their case."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def small_side(written: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """A materialised table with a broadcast hint if it has been counted to be small enough for it."""
    return F.broadcast(written) if written.count() <= limit else written
