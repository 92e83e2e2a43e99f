"""Document fingerprints: the quartile bucket digest of hashed byte triplets.

The six triplets of every 5-byte window are hashed into 128 buckets. Each bucket is coded by the
quartile of the document's bucket counts that it falls in (2 bits), behind a header of a checksum, the
logarithm of the length and two quartile ratios. Digests of similar texts differ in few codes.
"""

from __future__ import annotations

import heapq
import re
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import blocks, materialise, table_path

BUCKETS = 128
#: The difference score never goes beyond this.
LIMIT = 400
#: Documents count as each other's neighbours up to this difference. Near copies lie on both sides of it and so do
#: unrelated texts (README has the recall at each bound); the difference is returned, so a reader can ask for less.
NEAR = 40
#: Digests of one length step that are searched as one lot.
LOT = 16384
#: Pairs of digests that a numpy pass compares at once, and pairs of rows of lots that make a task.
TILE, TASK_PAIRS = 1 << 16, 1 << 31
#: Lots that a Python worker keeps loaded.
CACHE_LOTS = 32
_TRIPLETS = ((0, 1, 2), (0, 1, 3), (0, 2, 3), (0, 2, 4), (0, 1, 4), (0, 3, 4))


def bucket_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Counts of the hashed triplets, one row of 128 a document."""
    n = len(offsets) - 1
    if len(data) < 5:
        return np.zeros((n, BUCKETS), np.int64)
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(offsets))
    inside = np.arange(4, len(data))
    inside = inside[doc[4:] == doc[:-4]]
    base = doc[inside] * BUCKETS
    lag = [data[inside - i].astype(np.uint32) for i in range(5)]
    total = np.zeros(n * BUCKETS, np.int64)
    for salt, (a, b, c) in enumerate(_TRIPLETS):
        h = (lag[a] * np.uint32(0x9E3779B1) ^ lag[b] * np.uint32(0x85EBCA77) ^ lag[c] * np.uint32(0xC2B2AE3D)) + np.uint32(0x27D4EB2F * (salt + 1) & 0xFFFFFFFF)
        h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        total += np.bincount(base + (h >> np.uint32(25)), minlength=n * BUCKETS)
    return total.reshape(n, BUCKETS)


def digests(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Digests of 35 bytes, and which documents have one: those that fill more than half of the buckets."""
    counts = bucket_counts(data, offsets)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, [i]] for i in (31, 63, 95))
    code = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    body = np.packbits(np.stack([code >> 1, code & 1], 2).reshape(len(counts), -1).astype(np.uint8), axis=1)
    size = np.maximum(np.diff(offsets), 1)
    length = (np.round(8 * np.log2(size)).astype(np.int64) % 256).astype(np.uint8)
    top = np.maximum(q3[:, 0], 1)
    ratios = ((q1[:, 0] * 100 // top % 16) << 4 | q2[:, 0] * 100 // top % 16).astype(np.uint8)
    check = (counts * np.arange(1, BUCKETS + 1) % 251).sum(1).astype(np.uint8)
    return np.concatenate([check[:, None], length[:, None], ratios[:, None], body], 1), (counts > 0).sum(1) > BUCKETS // 2


_STEP = np.array([0, 1, 2, 6])


def difference(a: np.ndarray, b: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bounded difference of digests (rows of 35 bytes): 0 for equal ones, at most limit."""
    gap = np.abs(a[:, 1].astype(np.int64) - b[:, 1])
    gap = np.minimum(gap, 256 - gap)
    total = np.where(gap <= 1, gap, gap * 12) + (a[:, 0] != b[:, 0])
    for shift in (4, 0):
        d = np.abs((a[:, 2] >> shift & 15).astype(np.int64) - (b[:, 2] >> shift & 15))
        d = np.minimum(d, 16 - d)
        total += np.where(d <= 1, d, (d - 1) * 12)
    x, y = (np.unpackbits(np.ascontiguousarray(m[:, 3:]), axis=1).reshape(len(m), -1, 2).astype(np.int64) @ [2, 1] for m in (a, b))
    return np.minimum(total + _STEP[np.abs(x - y)].sum(1), limit)


def digest_difference(left: str, right: str) -> Column:
    """difference() of two columns of hexadecimal digests; null if either is null."""

    def run(left: pd.Series, right: pd.Series) -> pd.Series:
        known = (left.notna() & right.notna()).to_numpy()
        out = np.full(len(left), np.nan)
        if known.any():
            a, b = (np.frombuffer(bytes.fromhex("".join(s[known])), np.uint8).reshape(-1, 3 + BUCKETS // 4) for s in (left, right))
            out[known] = difference(a, b)
        return pd.Series(out).astype("Int32")

    return F.pandas_udf(run, "int")(left, right)


def digest_table(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, digest): the digest of every document, in hexadecimal.

    A digest is null for a null text and for one that fills no more than half of the buckets (texts
    of some 50 bytes or less, or the same few words throughout), as its quartiles say nothing. Repeated
    rows have a row each; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, out, sizes = batch.column(1), [], []
            for lo, hi in tb.slices(text):
                data, offsets = tb.utf8(text.slice(lo, hi - lo))
                rows, good = digests(data, offsets)
                whole = rows.tobytes().hex()
                width = 2 * rows.shape[1]
                out += [whole[i * width : (i + 1) * width] if g else None for i, g in enumerate(good)]
                sizes.append(np.diff(offsets))
            if out:
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.concatenate(sizes)), pa.array(out, pa.string())], names=["doc_id", "n_bytes", "digest"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, digest string")


def _length_cost(gap: int) -> int:
    return gap if gap <= 1 else gap * 12


def _ratio_costs() -> np.ndarray:
    """What two bytes of quartile ratios add to a difference, 256 by 256."""
    gap = np.abs(np.arange(16)[:, None] - np.arange(16))
    gap = np.minimum(gap, 16 - gap)
    step = np.where(gap <= 1, gap, (gap - 1) * 12)
    at = np.arange(256)
    return step[at[:, None] >> 4, at >> 4] + step[at[:, None] & 15, at & 15]


_RATIOS = _ratio_costs()


class Lot:
    """Distinct digests of one length step, in the order of their ratios, with the least doc_id of each."""

    def __init__(self, raw: np.ndarray, least: np.ndarray) -> None:
        order = np.argsort(raw[:, 2], kind="stable")
        self.raw, self.least = raw[order], least[order]
        self.cell, self.check = self.raw[:, 2].astype(np.int64), self.raw[:, 0]
        bits = np.unpackbits(np.ascontiguousarray(self.raw[:, 3:]), axis=1).reshape(len(raw), -1, 2).astype(bool)
        high, low = bits[:, :, 0], bits[:, :, 1]
        # codes in unary: the bits that differ are the steps between two codes; two 64-bit words a plane
        self.planes = [[np.packbits(x[:, w : w + 64], axis=1).view(np.uint64)[:, 0] for x in (high | low, high, high & low)] for w in (0, 64)]


def close(x: Lot, y: Lot, near: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of x and y whose digests differ by near at most, and the difference; if both are the same lot, each pair once."""
    gap = abs(int(x.raw[0, 1]) - int(y.raw[0, 1]))
    base = _length_cost(min(gap, 256 - gap))
    found = []
    cells, starts = np.unique(x.cell, return_index=True)
    for cell, a, b in zip(cells, starts, np.append(starts[1:], len(x.cell))):
        header = base + _RATIOS[cell, y.cell]
        there = np.flatnonzero(header <= near)
        if same:
            there = there[there >= a]
        if not len(there):
            continue
        header = header[there]
        room = np.minimum(near - header, 255).astype(np.uint8)
        (y1, y2, y3), rest = [p[there] for p in y.planes[0]], [p[there] for p in y.planes[1]]
        height = max(1, TILE // len(there))
        for lo in range(a, b, height):
            hi = min(b, lo + height)
            x1, x2, x3 = (p[lo:hi, None] for p in x.planes[0])
            # half of the steps rule out nearly all pairs
            steps = np.bitwise_count(x1 ^ y1)
            steps += np.bitwise_count(x2 ^ y2)
            steps += np.bitwise_count(x3 ^ y3)
            i, j = np.nonzero(steps <= room)
            total = header[j] + steps[i, j]
            i += lo
            d1, d2, d3 = (p[i] ^ q[j] for p, q in zip(x.planes[1], rest))
            for d in (d1, d2, d3):
                total += np.bitwise_count(d)
            some = total <= near
            if same:
                some &= there[j] > i
            i, j, total, d1, d3 = i[some], j[some], total[some], d1[some], d3[some]
            # three steps apart counts six
            total += 3 * (np.bitwise_count(d1 & d3) + np.bitwise_count((x.planes[0][0][i] ^ y1[j]) & (x.planes[0][2][i] ^ y3[j]))).astype(np.int64)
            j = there[j]
            total += x.check[i] != y.check[j]
            some = total <= near
            found.append((i[some], j[some], total[some]))
    if not found:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(z) for z in zip(*found))


def _nearest(row: np.ndarray, total: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The least difference of each row, of equal ones with the least other."""
    order = np.lexsort((other, total, row))
    row, total, other = row[order], total[order], other[order]
    first = np.append(True, row[1:] != row[:-1]) if len(row) else np.zeros(0, bool)
    return row[first], total[first], other[first]


def _packed(table: pa.Table) -> pa.Table:
    raw, least = "".join(table["digest"].to_pylist()), table["least"].to_numpy()
    return pa.Table.from_arrays([table["lot"].slice(0, 1), pa.array([bytes.fromhex(raw)], pa.binary()), pa.array([least.astype(np.int64).tobytes()], pa.binary())], names=["lot", "digests", "least"])


_LOTS: OrderedDict[str, Lot] = OrderedDict()


def _load(path: str) -> Lot | None:
    """A lot from the shared folder, through a bounded cache of this worker; None if no digest fell into it."""
    if path in _LOTS:
        _LOTS.move_to_end(path)
        return _LOTS[path]
    fs, inner = pafs.FileSystem.from_uri(re.sub(r"^s3[an]://", "s3://", path))
    files = [x.path for x in fs.get_file_info(pafs.FileSelector(inner, allow_not_found=True)) if x.path.endswith(".parquet")]
    if not files:
        return None
    row = pq.read_table(files[0], filesystem=fs, partitioning=None).to_pylist()[0]
    _LOTS[path] = Lot(np.frombuffer(row["digests"], np.uint8).reshape(-1, 3 + BUCKETS // 4), np.frombuffer(row["least"], np.int64))
    while len(_LOTS) > CACHE_LOTS:
        _LOTS.popitem(last=False)
    return _LOTS[path]


def _searched(path: str, tasks: list[list[tuple[int, int]]], near: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for task in batch.column(0).to_pylist():
                for p, q in tasks[task]:
                    x, y = _load(f"{path}/lot={p}"), _load(f"{path}/lot={q}")
                    if x is None or y is None:
                        continue
                    i, j, total = close(x, y, near, p == q)
                    for lot, row, other in ((x, i, y.least[j]), (y, j, x.least[i])):
                        row, least, other = _nearest(row, total, other)
                        whole, width = lot.raw[row].tobytes().hex(), 2 * lot.raw.shape[1]
                        digest = pa.array([whole[k * width : (k + 1) * width] for k in range(len(row))], pa.string())
                        if len(row):
                            yield pa.RecordBatch.from_arrays([digest, pa.array(least, pa.int32()), pa.array(other, pa.int64())], names=["digest", "difference", "other"])

    return run


def nearest_different(groups: DataFrame, near: int = NEAR) -> DataFrame:
    """(digest, difference, other): of each distinct digest in groups (digest, least), the closest other one within near by its least doc_id.

    Exact: all pairs are compared whose length and quartile ratios alone don't differ by more than near. Digests
    are laid in lots by length in the shared folder; a task reads the lots of its pairs there.
    """
    spark = groups.sparkSession
    sized = groups.withColumn("size", F.conv(F.substring("digest", 3, 2), 16, 10).cast("int"))
    counts = dict(sized.groupBy("size").count().collect())
    lots, first = [], {}
    for size, n in sorted(counts.items()):
        first[size] = len(lots)
        lots += [(size, n / -(-n // LOT))] * -(-n // LOT)
    # all pairs of lots, the largest first, over tasks of like work
    pairs = []
    for size in first:
        for gap in range(129):
            more = (size + gap) % 256
            # at a gap of 128 both ways lead to the same pairs
            if _length_cost(gap) > near or more not in first or gap == 128 and more < size:
                continue
            for p in range(first[size], first[size] + -(-counts[size] // LOT)):
                for q in range(p if gap == 0 else first[more], first[more] + -(-counts[more] // LOT)):
                    pairs.append((lots[p][1] * lots[q][1], p, q))
    pairs.sort(reverse=True)
    n = max(1, min(len(pairs), max(blocks(groups), int(sum(x for x, _, _ in pairs) / TASK_PAIRS))))
    tasks: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    load = [(0.0, i) for i in range(n)]
    for work, p, q in pairs:
        least, i = heapq.heappop(load)
        tasks[i].append((p, q))
        heapq.heappush(load, (least + work, i))
    path = table_path(spark, "digest-lots")
    firsts = F.broadcast(spark.createDataFrame([(s, at, -(-counts[s] // LOT)) for s, at in first.items()], "size int, first int, lots int"))
    placed = sized.join(firsts, "size").select((F.col("first") + F.pmod(F.xxhash64("digest"), F.col("lots"))).cast("int").alias("lot"), "digest", "least")
    placed.groupBy("lot").applyInArrow(_packed, "lot int, digests binary, least binary").write.partitionBy("lot").parquet(path)
    found = spark.range(0, n if pairs else 0, 1, n).mapInArrow(_searched(path, tasks, near), "digest string, difference int, other long")
    best = found.groupBy("digest").agg(F.min(F.struct("difference", "other")).alias("best"))
    return best.select("digest", "best.difference", "best.other")


def nearest_digests(docs: DataFrame, near: int = NEAR) -> DataFrame:
    """(doc_id, n_bytes, digest, nearest_id, difference): every document with the closest other one.

    The neighbour has a difference of at most near (of equal ones, the least doc_id), else it is null. The search is exact
    for every near below the limit of the difference; its work grows with near and with the square of the distinct digests of
    about one length. Equal digests are folded into one before the search, so copies cost
    nothing; a document with a null doc_id or digest has no neighbour and is none. Rows of one doc_id that have the same digest are one document.
    """
    if near >= LIMIT:
        raise ValueError("near must be below the limit of the difference")
    table = materialise(digest_table(docs), "digests")
    alone = table.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    groups = materialise(alone.groupBy("digest").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")), "digest-groups")
    best = nearest_different(groups, near).select("digest", F.struct("difference", "other").alias("best"))
    # the second least member of a group is the neighbour of its first
    second = alone.join(groups.where("least <> most"), "digest").where("doc_id > least").groupBy("digest").agg(F.min("doc_id").alias("second"))
    known = groups.join(second, "digest", "left").join(best, "digest", "left")
    found = known.select(F.col("digest").alias("_digest"), "least", "second", "best").where("second IS NOT NULL OR best IS NOT NULL")
    joined = table.join(found, table["digest"] == found["_digest"], "left")
    copy = F.when(F.col("second").isNotNull(), F.when(F.col("doc_id") == F.col("least"), F.col("second")).otherwise(F.col("least")))
    usable = F.col("doc_id").isNotNull()
    return joined.select("doc_id", "n_bytes", "digest", F.when(usable, F.coalesce(copy, F.col("best.other"))).alias("nearest_id"), F.when(usable, F.when(copy.isNotNull(), F.lit(0)).otherwise(F.col("best.difference"))).cast("int").alias("difference"))
