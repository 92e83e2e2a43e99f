"""Values for the rows of a table, looked up by the row's address.

A row's address is its file and its place there, which every scan of the same files gives alike. What a job finds out
about rows travels as packed numbers by address and is written in chunks of CHUNK rows; a scan
reads the chunks of its own rows. So the rows themselves, with their texts, are not joined with it, shuffled or broadcast,
however many they are, and rows that agree in every column are told apart.
"""

from __future__ import annotations

import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import fresh, gathered, is_scan, materialise, table_path

#: Rows of a file that are written, and read, together.
CHUNK = 1 << 15
#: Bytes of chunks that a Python worker keeps loaded.
CACHE_BYTES = 32 << 20
PACKED = "bucket int, file long, chunk long, rows binary, values binary"
U64 = np.uint64


def scanned(docs: DataFrame) -> DataFrame:
    """The table as a scan whose rows have addresses: only Parquet files tell a row's place, and any other table is written to the shared folder first."""
    if is_scan(docs):
        try:
            docs.select(docs.metadataColumn("_metadata")["row_index"])
            return docs
        except AnalysisException:
            pass  # files that do not count their rows
    return materialise(docs, "rows")


def addressed(docs: DataFrame, columns: list[Column | str]) -> tuple[DataFrame, str, str]:
    """The columns of every row, with its file (as a hash) and its place, and the names of these two.

    Whoever calls this twice for one table passes what scanned() gives, as a table that is no scan has other addresses each time.
    """
    taken = docs.select(*columns).columns
    file, row = fresh("_file", taken), fresh("_row", taken)
    if is_scan(docs) and (table := scanned(docs)) is docs:
        chosen = columns
    else:
        table, chosen = materialise(docs.select(*columns), "rows"), ["*"]
    meta = table.metadataColumn("_metadata")
    return table.select(*chosen, F.xxhash64(meta["file_path"]).alias(file), meta["row_index"].alias(row)), file, row


def _bucket(file: np.ndarray, chunk: np.ndarray, count: int) -> np.ndarray:
    return (tb.mix(file.view(U64) + chunk.astype(np.int64).view(U64) * U64(0x9E3779B97F4A7C15)) % U64(count)).astype(np.int32)


def pack(file: np.ndarray, row: np.ndarray, value: np.ndarray, count: int) -> pa.RecordBatch:
    """Whole numbers of rows as one row a chunk."""
    order = np.lexsort((row, file))
    file, row, value = file[order], row[order], value[order]
    chunk = row // CHUNK
    new = np.append(True, (file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])) if len(row) else np.zeros(0, bool)
    first = np.flatnonzero(new)
    cuts = np.append(first, len(row))
    return pa.RecordBatch.from_arrays(
        [pa.array(_bucket(file[first], chunk[first], count)), pa.array(file[first]), pa.array(chunk[first]), tb.binaries((row % CHUNK).astype(np.int32), cuts), tb.binaries(value.astype(np.int64), cuts)],
        names=["bucket", "file", "chunk", "rows", "values"],
    )


def _merged(count: int):
    def merge(table: pa.Table) -> pa.Table:
        n = np.array([len(x.as_buffer()) // 4 for x in table["rows"]], np.int64)
        file, chunk = (np.repeat(table[c].to_numpy(), n) for c in ("file", "chunk"))
        return pa.Table.from_batches([pack(file, chunk * CHUNK + tb.joined(table["rows"], np.int32), tb.joined(table["values"], np.int64), count)])

    return merge


def store(packs: DataFrame, count: int, name: str) -> str:
    """Write packs (rows of PACKED, as pack() makes them for so many buckets) to the shared folder: the path for found() and lookup()."""
    path = table_path(packs.sparkSession, name)
    gathered(packs, count, "bucket", _merged(count), PACKED).write.partitionBy("bucket").parquet(path)
    return path


def stored(values: DataFrame, count: int, name: str) -> str:
    """store() of a table (file, row, value) with one row an address or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pack(*(batch.column(i).to_numpy() for i in range(3)), count)

    return store(values.mapInArrow(run, PACKED), count, name)


_LOADED: OrderedDict[tuple, tuple[np.ndarray, np.ndarray]] = OrderedDict()


def _load(path: str, count: int, file: int, chunk: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (in order, by their place in the chunk) and values of a chunk."""
    key = (path, file, chunk)
    if key in _LOADED:
        _LOADED.move_to_end(key)
        return _LOADED[key]
    bucket = int(_bucket(np.array([file]), np.array([chunk]), count)[0])
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", f"{path}/bucket={bucket}"))
    rows, values = np.zeros(0, np.int32), np.zeros(0, np.int64)
    for x in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)):
        if x.path.endswith(".parquet"):
            table = pq.read_table(x.path, columns=["rows", "values"], filesystem=fs, partitioning=None, filters=[("file", "=", file), ("chunk", "=", chunk)])
            if table.num_rows:
                rows, values = tb.joined(table["rows"], np.int32), tb.joined(table["values"], np.int64)
    _LOADED[key] = rows, values
    while len(_LOADED) > 1 and sum(a.nbytes + b.nbytes for a, b in _LOADED.values()) > CACHE_BYTES:
        _LOADED.popitem(last=False)
    return rows, values


def found(path: str, count: int, file: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of a batch have values, and these: positions in the batch (in order; repeated for several values of a row) and values."""
    chunk = row // CHUNK
    order = np.lexsort((row, file))
    at, values = [], []
    cuts = np.flatnonzero(np.append(True, (file[order][1:] != file[order][:-1]) | (chunk[order][1:] != chunk[order][:-1]))) if len(row) else np.zeros(0, np.int64)
    for a, b in zip(cuts, np.append(cuts[1:], len(row))):
        mine = order[a:b]
        here = (row[mine] % CHUNK).astype(np.int32)
        rows, held = _load(path, count, int(file[mine[0]]), int(chunk[mine[0]]))
        lo, hi = np.searchsorted(rows, here[0], "left"), np.searchsorted(rows, here[-1], "right")
        i = np.minimum(np.searchsorted(here, rows[lo:hi]), len(here) - 1)
        hit = here[i] == rows[lo:hi]
        at.append(mine[i[hit]])
        values.append(held[lo:hi][hit])
    if not at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at, values = np.concatenate(at), np.concatenate(values)
    order = np.argsort(at, kind="stable")
    return at[order], values[order]


def lookup(path: str, count: int, default: int):
    """A function of the columns file and row that gives the row's value, or the default where it has none."""

    def run(file: pd.Series, row: pd.Series) -> pd.Series:
        out = np.full(len(row), default, np.int64)
        at, values = found(path, count, file.to_numpy(np.int64), row.to_numpy(np.int64))
        out[at] = values
        return pd.Series(out)

    return F.pandas_udf(run, "long")
