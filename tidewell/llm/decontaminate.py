"""Benchmark decontamination by winnowed fingerprints.

Both sides keep, of every window of W consecutive word k-grams, the least hash (the
rightmost of equals). A span of K + W - 1 words or more that a document shares with a
benchmark item holds a whole window, whose least hash both sides keep, so the fingerprints
always meet there. Each meeting is then extended to the longest shared span, by binary search over hashes of word runs.
Items with fewer grams than a window are looked up by their first gram among all grams of the documents instead, so they are always found whole.

The documents are scanned once per slice of the benchmark; a slice is at most
SLICE_WORDS words, which bounds what is broadcast whatever the benchmark's size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import materialise, trimmed

K, W = 5, 6
#: Shared words from which a document counts as contaminated; every such span is found as K + W - 1 = 10.
MIN_SPAN = 10
#: Benchmark words (8 bytes each) that are broadcast at once.
SLICE_WORDS = 2_000_000
U64 = np.uint64


def winnow(g: np.ndarray, bounds: np.ndarray, w: int) -> np.ndarray:
    """Positions of the selected grams; a text with fewer than w grams has one window of them all."""
    chosen = np.zeros(len(g), bool)
    n = np.diff(bounds)
    if len(g) >= w:
        least, at = g[: len(g) - w + 1].copy(), np.zeros(len(g) - w + 1, np.int64)
        for i in range(1, w):
            other = g[i : len(g) - w + 1 + i]
            better = other <= least
            np.copyto(least, other, where=better)
            at[better] = i
        windows = np.maximum(n - w + 1, 0)
        first = np.concatenate([[0], np.cumsum(windows)])
        doc = np.repeat(np.arange(len(n)), windows)
        start = np.arange(first[-1]) - first[:-1][doc] + bounds[:-1][doc]
        chosen[start + at[start]] = True
    for i in np.flatnonzero((n > 0) & (n < w)):
        part = g[bounds[i] : bounds[i + 1]]
        chosen[bounds[i] + len(part) - 1 - int(np.argmin(part[::-1]))] = True
    return np.flatnonzero(chosen)


#: Meetings that are extended at once.
LOT = 1 << 18


def _shared(x: np.ndarray, y: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray, way: int) -> np.ndarray:
    """How many words from i on (way 1), or up to i (way -1), agree with those at j, at most so many; x and y are prefix hashes."""
    low, high = np.zeros(len(i), np.int64), most.copy()
    while (open_ := low < high).any():
        n = np.where(open_, (low + high + 1) // 2, low)
        a, b, c, d = (i, i + n, j, j + n) if way > 0 else (i - n, i, j - n, j)
        same = tb.span_hash(x, a, b) == tb.span_hash(y, c, d)
        low, high = np.where(open_ & same, n, low), np.where(open_ & ~same, n - 1, high)
    return low


class Index:
    """The fingerprints of one slice of the benchmark, with hashes of its word runs for the extension."""

    def __init__(self, ids: list, words: np.ndarray, bounds: np.ndarray, k: int, w: int) -> None:
        self.ids, self.bounds, self.sums = np.array(ids, np.int64), bounds, tb.prefix_hash(words)
        g, cuts = tb.grams(words, bounds, k)
        n = np.diff(cuts)
        short = (n < w) & (np.diff(bounds) >= k)
        at = winnow(g, cuts, w)
        item = np.searchsorted(cuts, at, "right") - 1
        at, item = at[n[item] >= w], item[n[item] >= w]
        self.long = self._sorted(g[at], item, at - cuts[item])
        # items of k to k + w - 2 words, by their first gram
        self.short = self._sorted(g[cuts[:-1][short]], np.flatnonzero(short), np.zeros(int(short.sum()), np.int64))

    @staticmethod
    def _sorted(prints: np.ndarray, item: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, ...]:
        order = np.argsort(prints, kind="stable")
        mask = U64((1 << max(16, 4 + len(prints).bit_length())) - 1)
        known = np.zeros(int(mask) + 1, bool)
        known[(prints & mask).astype(np.int64)] = True
        return prints[order], item[order], place[order], mask, known

    def spans(self, words: np.ndarray, bounds: np.ndarray, k: int, w: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, item and words of shared spans, the longest of each pair among them, where they have least words or are a whole shorter item."""
        g, cuts = tb.grams(words, bounds, k)
        at, entry = [], []
        for kept, (prints, item, place, mask, known) in ((winnow(g, cuts, w), self.long), (np.arange(len(g)), self.short)):
            if not len(prints):
                continue
            kept = kept[known[(g[kept] & mask).astype(np.int64)]]
            lo, hi = np.searchsorted(prints, g[kept], "left"), np.searchsorted(prints, g[kept], "right")
            n = hi - lo
            e = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo, n)
            at.append(np.repeat(kept, n)), entry.append(np.stack([item[e], place[e]]))
        out = [np.zeros((3, 0), np.int64)]
        if at:
            at, (item, place) = np.concatenate(at), np.concatenate(entry, 1)
            sums = tb.prefix_hash(words)
            for lo in range(0, len(at), LOT):
                p, it = at[lo : lo + LOT], item[lo : lo + LOT]
                doc = np.searchsorted(cuts, p, "right") - 1
                i, j = bounds[doc] + p - cuts[doc], self.bounds[it] + place[lo : lo + LOT]
                back = _shared(sums, self.sums, i, j, np.minimum(i - bounds[doc], j - self.bounds[it]), -1)
                n = back + _shared(sums, self.sums, i, j, np.minimum(bounds[doc + 1] - i, self.bounds[it + 1] - j), 1)
                good = (n >= np.minimum(least, self.bounds[it + 1] - self.bounds[it])) & (n >= k)
                out.append(np.stack([doc[good], it[good], n[good]]))
        doc, item, n = np.concatenate(out, 1)
        order = np.lexsort((-n, item, doc))
        doc, item, n = doc[order], item[order], n[order]
        first = np.append(True, (doc[1:] != doc[:-1]) | (item[1:] != item[:-1])) if len(doc) else np.zeros(0, bool)
        return doc[first], item[first], n[first]


def _slices(benchmark: DataFrame, k: int, w: int) -> Iterator[Index]:
    """Indexes of the benchmark, each of at most SLICE_WORDS words (or one longer item)."""
    spark = benchmark.sparkSession

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, bounds = tb.words(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), tb.binaries(words, bounds)], names=["item_id", "n", "words"])

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id IS NOT NULL AND text IS NOT NULL")
    packed = materialise(source.mapInArrow(pack, "item_id long, n long, words binary").where("n > 0"), "benchmark")
    total = packed.agg(F.sum("n")).first()[0] or 0
    parts = -(-total // SLICE_WORDS)
    for part in range(parts):
        rows = packed.where(F.pmod(F.xxhash64("item_id", "words"), F.lit(parts)) == part).orderBy("item_id", "words").collect()
        if rows:
            words = np.concatenate([np.frombuffer(r.words, U64) for r in rows])
            yield Index([r.item_id for r in rows], words, np.concatenate([[0], np.cumsum([r.n for r in rows])]), k, w)


def _found(text: pa.Array, index: Index, k: int, w: int, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """spans() of a column of texts."""
    parts = [np.zeros((3, 0), np.int64)]
    for lo, hi in tb.slices(text):
        doc, item, n = index.spans(*tb.words(text.slice(lo, hi - lo)), k, w, least)
        parts.append(np.stack([doc + lo, item, n]))
    return tuple(np.concatenate(parts, 1))


def contaminated_spans(docs: DataFrame, benchmark: DataFrame, min_span: int = MIN_SPAN, k: int = K, w: int = W) -> DataFrame:
    """(doc_id, item_id, span_words): the longest word span that a document shares with an item.

    A pair is given where the span has min_span words or more (min_span >= k + w - 1 makes the
    result complete). An item of k to min_span - 1 words is given wherever it stands whole in the document, and an
    item of fewer than k words never, as ordinary texts hold such phrases. Texts of any length are read whole. Null or wordless texts and items with a null id share nothing;
    documents with a null doc_id are reported together under null. Repeated rows and repeated
    items of one id give one row with the longest span. An empty table on either side: no rows.
    """
    if min_span < k + w - 1:
        raise ValueError("min_span must be at least k + w - 1 for every shared span to be found")
    spark = docs.sparkSession
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def scan(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                row, item, n = _found(batch.column(1), held.value, k, w, min_span)
                if len(row):
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array(held.value.ids[item]), pa.array(n.astype(np.int32))], names=["doc_id", "item_id", "span_words"])

        return run

    schema = "doc_id long, item_id long, span_words int"
    out = None
    for index in _slices(benchmark, k, w):
        part = source.mapInArrow(trimmed(scan(spark.sparkContext.broadcast(index))), schema)
        out = part if out is None else out.union(part)
    if out is None:
        return spark.createDataFrame([], schema)
    return out.groupBy("doc_id", "item_id").agg(F.max("span_words").alias("span_words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, min_span: int = MIN_SPAN, k: int = K, w: int = W) -> DataFrame:
    """The documents that share no span of min_span words or more with any item, and hold no shorter item of k words or more whole; all columns stay.

    Rows are judged by their own text, so a null doc_id or a repeated row makes no difference. A null text stays.
    """
    spark = docs.sparkSession
    place = docs.columns.index("text")

    def keep(held) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                clean = np.ones(batch.num_rows, bool)
                clean[_found(batch.column(place), held.value, k, w, min_span)[0]] = False
                yield batch if clean.all() else batch.filter(pa.array(clean))

        return run

    # whatever the columns are called, they pass under plain names
    out = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    for index in _slices(benchmark, k, w):
        out = out.mapInArrow(trimmed(keep(spark.sparkContext.broadcast(index))), out.schema)
    return out.toDF(*docs.columns)
