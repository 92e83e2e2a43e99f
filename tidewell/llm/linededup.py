"""Line deduplication by a sharded minimal perfect hash.

The distinct lines of the corpus are divided over shards by their hash. Each shard is
a level-by-level minimal perfect hash (Limasset et al. 2017) which maps a line to its place in
compact arrays: a 32-bit fingerprint, the number of rows that hold the line, and the least doc_id
among them. Documents send packed line hashes to the shards; a task probes the arrays of one shard and sends
back which lines go, by the address of their row (see rows.py). A shard of very many probes has several tasks, so each is
read once per PROBES lines that are looked up in it: reads grow in proportion to the text. No line is ever joined.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows
from . import textbatch as tb
from .workspace import blocks, gathered, table_path

#: Shorter lines (UTF-8 bytes without the outer white space) are left as they are.
MIN_BYTES = 24
#: Lines that a map task holds before it sends them on, and how many for each shard at least.
FLUSH_LINES, FLUSH_SHARD = 1_000_000, 8
#: Lines that a task looks up in a shard.
PROBES = 8_000_000
U64, U32 = np.uint64, np.uint32


def lines(text: pa.Array, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, line number and hash of each line of least bytes or more, of which a row gives each once, at its first place; then (row, line) repeats."""
    data, offsets = tb.utf8(text)
    newline = np.flatnonzero(data == 10)
    starts, ends, row = tb.spans(data != 10, offsets)
    first, last = _trimmed(data, starts, ends)
    long = last - first >= max(least, 1)
    first, last, row, starts = first[long], last[long], row[long], starts[long]
    number = np.searchsorted(newline, starts) - np.searchsorted(newline, offsets)[row]
    return row, number, tb.span_hash(tb.prefix_hash(data), first, last)


def _trimmed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spans without the white space at their ends; one of white space only becomes empty."""
    first, last = starts.copy(), ends.copy()
    left = np.flatnonzero(tb.SPACE[data[starts]]) if len(starts) else starts
    right = np.flatnonzero(tb.SPACE[data[ends - 1]]) if len(starts) else starts
    if len(left) or len(right):
        solid = np.append(np.flatnonzero(~tb.SPACE[data]), len(data))
        first[left] = np.minimum(solid[np.searchsorted(solid, starts[left])], ends[left])
        at = np.searchsorted(solid, ends[right]) - 1
        last[right] = np.maximum(np.where(at >= 0, solid[np.maximum(at, 0)] + 1, 0), first[right])
    return first, last


def repeats(row: np.ndarray, number: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which lines stand in their row before."""
    order = np.lexsort((number, h, row))
    again = np.zeros(len(row), bool)
    again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (row[order[1:]] == row[order[:-1]])
    return again


def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
    return (tb.mix(keys + U64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(size)).astype(np.int64)


class PerfectHash:
    """A minimal perfect hash of distinct 64-bit keys; place() of a key that is not of them is -1 or any place."""

    def __init__(self, sizes: np.ndarray, bits: np.ndarray) -> None:
        self.sizes, self.bits = sizes, bits
        ones = np.bitwise_count(bits.view(U64)).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum(ones)])

    @classmethod
    def of(cls, keys: np.ndarray) -> PerfectHash:
        sizes, levels = [], []
        while len(keys):
            size = -(-len(keys) * 2 // 64) * 64
            at = _place(keys, len(sizes), size)
            alone = np.bincount(at, minlength=size) == 1
            levels.append(np.packbits(alone, bitorder="little"))
            sizes.append(size)
            keys = keys[~alone[at]]
        return cls(np.array(sizes, np.int64), np.concatenate(levels) if levels else np.zeros(0, np.uint8))

    def place(self, keys: np.ndarray) -> np.ndarray:
        out = np.full(len(keys), -1, np.int64)
        rest, base = np.arange(len(keys)), 0
        for level, size in enumerate(self.sizes):
            if not len(rest):
                break
            at = _place(keys[rest], level, int(size)) + base
            hit = (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            here = at[hit]
            word = self.bits.view(U64)[here >> 6] & ((U64(1) << (here & 63).astype(U64)) - U64(1))
            out[rest[hit]] = self.before[here >> 6] + np.bitwise_count(word)
            rest, base = rest[~hit], base + int(size)
        return out


def _shard(h: np.ndarray, count: int) -> np.ndarray:
    return ((h >> U64(40)) * U64(count) >> U64(24)).astype(np.int32)


def _counted(h: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes in order, with the sum of their counts and the least of their ids."""
    order = np.lexsort((ids, h))
    h = h[order]
    start = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    return h[start], np.add.reduceat(counts[order], start), ids[order][start]


def _lots(batches: Iterator[pa.RecordBatch], least: int, count: int, solve) -> Iterator[pa.RecordBatch]:
    """solve() of the lines of about FLUSH_LINES lines of a task at a time: number, hash and whether it is a repeat, with the other columns of their rows."""
    held: list[tuple[np.ndarray, ...]] = []
    for batch in batches:
        others = [c.to_numpy(zero_copy_only=False) for c in batch.columns[1:]]
        for lo, hi in tb.slices(batch.column(0)):
            row, number, h = lines(batch.column(0).slice(lo, hi - lo), least)
            held.append((number.astype(np.int32), h, repeats(row, number, h), *(x[lo + row] for x in others)))
        if sum(len(x[0]) for x in held) >= max(FLUSH_LINES, FLUSH_SHARD * count):
            yield solve(*(np.concatenate(x) for x in zip(*held)))
            held = []
    if held and sum(len(x[0]) for x in held):
        yield solve(*(np.concatenate(x) for x in zip(*held)))


def _sent(count: int, least: int):
    """Distinct lines of a lot with their documents counted, so that a line of a million documents is a row a lot."""

    def solve(number: np.ndarray, h: np.ndarray, again: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        h, counts, first = _counted(h[~again], np.ones(int((~again).sum()), np.int64), ids[~again].astype(np.int64))
        present, cuts = np.unique(_shard(h, count), return_index=True)
        cuts = np.append(cuts, len(h))
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), tb.binaries(h, cuts), tb.binaries(counts, cuts), tb.binaries(first, cuts)], names=["shard", "lines", "counts", "first"])

    return lambda batches: _lots(batches, least, count, solve)


def _built(table: pa.Table) -> pa.Table:
    keys, counts, first = _counted(tb.joined(table["lines"], U64), tb.joined(table["counts"], np.int64), tb.joined(table["first"], np.int64))
    perfect = PerfectHash.of(keys)
    at = perfect.place(keys)
    prints, held, owner = np.empty(len(keys), U32), np.empty(len(keys), U32), np.empty(len(keys), np.int64)
    prints[at], held[at], owner[at] = (keys & U64(0xFFFFFFFF)).astype(U32), np.minimum(counts, 0xFFFFFFFF), first
    whole = lambda x: pa.array([x.tobytes()], pa.binary())
    return pa.Table.from_arrays([table["shard"].slice(0, 1), pa.array([int(counts.sum())]), whole(perfect.sizes), whole(perfect.bits), whole(prints), whole(held), whole(owner)], names=["shard", "total", "sizes", "bits", "prints", "counts", "first"])


_INDEX = "shard int, total long, sizes binary, bits binary, prints binary, counts binary, first binary"


def _load(path: str) -> tuple[PerfectHash, np.ndarray, np.ndarray, np.ndarray]:
    """A shard from the shared folder."""
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(inner)) if x.path.endswith(".parquet")]
    row = pq.read_table(files[0], filesystem=fs, partitioning=None).to_pylist()[0]
    a = {k: np.frombuffer(row[k], t) for k, t in zip(("sizes", "bits", "prints", "counts", "first"), (np.int64, np.uint8, U32, U32, np.int64))}
    return PerfectHash(a["sizes"], a["bits"]), a["prints"], a["counts"], a["first"]


#: What a line is to its row: of a row without a doc_id, of one with, or a repeat in its row, which goes anyway.
_LOST, _OWNED, _REPEAT = range(3)
_ASKED = "task int, shard int, hashes binary, ids binary, states binary, numbers binary, files binary, rows binary"


def _asked(count: int, least: int, tasks: np.ndarray):
    """Map side of the probe: the lines of a lot by the task that looks them up. tasks: where the tasks of each shard begin."""

    def solve(number: np.ndarray, h: np.ndarray, again: np.ndarray, ids: np.ndarray, known: np.ndarray, file: np.ndarray, row: np.ndarray) -> pa.RecordBatch:
        shard = _shard(h, count)
        # rows of one shard are spread over its tasks by their place
        task = tasks[shard] + (tb.mix(row.astype(np.int64).view(U64)) % np.maximum(tasks[shard + 1] - tasks[shard], 1).astype(U64)).astype(np.int64)
        order = np.argsort(task, kind="stable")
        present, cuts = np.unique(task[order], return_index=True)
        shards = shard[order][cuts]
        cuts = np.append(cuts, len(order))
        state = np.where(again, _REPEAT, np.where(known, _OWNED, _LOST)).astype(np.uint8)
        columns = (h, ids.astype(np.int64), state, number, file.astype(np.int64), row.astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), pa.array(shards, pa.int32()), *(tb.binaries(x[order], cuts) for x in columns)], names=["task", "shard", "hashes", "ids", "states", "numbers", "files", "rows"])

    return lambda batches: _lots(batches, least, count, solve)


def probing_tasks(sizes: np.ndarray) -> np.ndarray:
    """Where the tasks of each shard begin, by the lines that will be looked up in it; each task reads its shard once."""
    return np.concatenate([[0], np.cumsum(np.maximum(-(-sizes // PROBES), 1))])


def _probed(path: str, count: int):
    """Reduce side: which lines go, as packs for rows.store()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, loaded = None, None
        for batch in batches:
            for i in range(batch.num_rows):
                shard = batch.column(1)[i].as_py()
                if shard != now:
                    now, loaded = shard, _load(f"{path}/shard={shard}") if _has(path, shard) else None
                h, ids, state, number, file, row = (np.frombuffer(batch.column(2 + k)[i].as_buffer(), t) for k, t in enumerate((U64, np.int64, np.uint8, np.int32, np.int64, np.int64)))
                drop = state == _REPEAT
                if loaded is not None:
                    perfect, prints, counts, first = loaded
                    at = perfect.place(h)
                    hit = (at >= 0) & (prints[at] == (h & U64(0xFFFFFFFF)).astype(U32))
                    drop |= hit & ((state == _LOST) | (counts[at] > 1) & (first[at] != ids))
                if drop.any():
                    yield rows.pack(file[drop], row[drop], number[drop], count)

    return run


def _has(path: str, shard: int) -> bool:
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", f"{path}/shard={shard}"))
    return fs.get_file_info(inner).type == pafs.FileType.Directory


def without(data: np.ndarray, offsets: np.ndarray, row: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts without the lines of these numbers (sorted by row, then number): bytes, bounds, and the newlines of each text before."""
    newline = np.flatnonzero(data == 10)
    base = np.searchsorted(newline, offsets)
    breaks = np.diff(base)
    if not len(row):
        return data, offsets, breaks
    begin = np.where(number > 0, newline[np.minimum(base[row] + number - 1, len(newline) - 1)] + 1 if len(newline) else 0, offsets[row])
    final = number == breaks[row]
    end = np.where(final, offsets[row + 1], newline[np.minimum(base[row] + number, len(newline) - 1)] + 1 if len(newline) else 0)
    # where the last lines go, so does the break before them
    left = np.searchsorted(row, row, "right") - 1 - np.arange(len(row))
    tail = number == breaks[row] - left
    last = np.bincount(row[tail], minlength=len(offsets) - 1)
    ends = np.flatnonzero((last > 0) & (breaks - last >= 0))
    gone = np.zeros(len(data) + 1, np.int32)
    np.add.at(gone, begin, 1)
    np.add.at(gone, end, -1)
    kept = np.cumsum(gone[:-1]) == 0
    kept[newline[base[ends] + breaks[ends] - last[ends]]] = False
    sums = np.concatenate([[0], np.cumsum(kept)])
    return data[kept], sums[offsets], breaks


def _rewritten(path: str, count: int):
    """(doc_id, n_lines, n_dropped, text) of batches of (text, doc_id, file, row)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, number = rows.found(path, count, batch.column(2).to_numpy(), batch.column(3).to_numpy())
            order = np.lexsort((number, at))
            at, number = at[order], number[order]
            for lo, hi in tb.slices(batch.column(0)):
                text = batch.column(0).slice(lo, hi - lo)
                a, b = np.searchsorted(at, (lo, hi))
                data, bounds, breaks = without(*tb.utf8(text), at[a:b] - lo, number[a:b])
                valid = text.is_valid().to_numpy(zero_copy_only=False)
                new = pa.Array.from_buffers(pa.string(), hi - lo, [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
                new = pc.if_else(pa.array(valid), new, pa.scalar(None, pa.string()))
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(lo, hi - lo), pa.array(np.where(valid, breaks + 1, 0).astype(np.int32)), pa.array(np.bincount(at[a:b] - lo, minlength=hi - lo).astype(np.int32)), new], names=["doc_id", "n_lines", "n_dropped", "text"])

    return run


def line_index(source: DataFrame, count: int, min_bytes: int = MIN_BYTES) -> str:
    """Write the index of all distinct lines of (text, doc_id) to the shared folder, in so many shards: its path."""
    path = table_path(source.sparkSession, "lines")
    known = source.where("doc_id IS NOT NULL AND text IS NOT NULL")
    packs = known.mapInArrow(_sent(count, min_bytes), "shard int, lines binary, counts binary, first binary")
    gathered(packs, count, "shard", _built, _INDEX).write.partitionBy("shard").parquet(path)
    return path


def dedup_lines(docs: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every document without the lines that stand elsewhere first.

    Lines are what newlines divide; two are equal when they agree without the white space around them. Of equal
    lines of min_bytes or more, the one in the document with the least doc_id stays, and
    in this document only the first; order and every other line stay as they are. A document
    may lose all its lines and then has an empty text. Rows of one doc_id are one document. Texts of any length are taken whole.

    A null text stays null with 0 lines. A row with a null doc_id comes after all others: it loses
    every line that a document with a doc_id has, but is not held against other such rows. A line that no document has is
    mistaken for one with probability 2**-32. No documents: no rows. Other columns are not read.
    """
    spark, count = docs.sparkSession, blocks(docs)
    columns = [F.col("text").cast("string").alias("text"), F.col("doc_id").cast("long").alias("doc_id")]
    source, file, row = rows.addressed(docs, columns)
    path = line_index(source.select("text", "doc_id"), count, min_bytes)
    # how many tasks look up in each shard
    sizes = np.zeros(count, np.int64)
    for r in spark.read.schema(_INDEX).parquet(path).select("shard", "total").collect():
        sizes[r.shard] = r.total
    tasks = probing_tasks(sizes)
    asked = source.where("text IS NOT NULL").select("text", F.coalesce("doc_id", F.lit(0)).alias("doc_id"), F.col("doc_id").isNotNull().alias("known"), file, row)
    packs = asked.mapInArrow(_asked(count, min_bytes, tasks), _ASKED).repartitionById(int(tasks[-1]), F.col("task")).mapInArrow(_probed(path, count), rows.PACKED)
    gone = rows.store(packs, count, "dropped-lines")
    return source.select("text", "doc_id", file, row).mapInArrow(_rewritten(gone, count), "doc_id long, n_lines int, n_dropped int, text string")
