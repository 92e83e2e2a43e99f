"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

Documents become sets of word 5-gram hashes. Three packed exchanges carry numpy
arrays (few large rows, not one row a gram):

1. by gram block: how many distinct sets hold each gram; a gram of one set can add
   to no overlap and leaves the matrix;
2. by set: a set of n grams needs at least t*n grams that others hold too
   (|A & B| >= t * |A | B| >= t * |A|), else no partner exists. Of the m that
   remain, ordered rarest first, any partner shares one of the first
   m - ceil(t*n) + 1 grams;
3. by gram block again, these prefix grams alone link sets whose sizes allow
   the threshold. Chains of links give components, and no pair at or above the
   threshold lies across two.

Inside the components the product of the incidence matrix with its transpose is
accumulated block by block, which gives the exact overlap of every pair; pairs below the
bound are dropped. The rows of a large component are laid in blocks of like numbers of grams by their least gram,
and only pairs of blocks that share a prefix gram meet. A gram that few rows of a tile hold adds to the
pairs of its holders one by one, and one that many hold is a column of a dense product. So loosely linked short sets cost what they
share, and a dense group costs few operations a pair. The result is exact: no sampling and no cap on partners.

jaccard_pairs() returns the pairs. jaccard_links() counts them where they are found and sends on sums and spanning edges, so that
neither its rows nor its exchanges grow with the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import rows as side
from . import textbatch as tb
from .components import connected_components, contracted
from .workspace import blocks, gathered, materialise, trimmed

N, THRESHOLD = 5, 0.4
#: Grams that a map task holds before it sends them on, and how many for each block at least.
FLUSH_GRAMS, FLUSH_BLOCK = 1_000_000, 8
#: Documents that are looked at for heavy grams: so many, or this share of all if that is more; a gram is heavy from so many sets among them on.
SAMPLE, SAMPLE_SHARE, SAMPLE_SETS = 4_000, 1.6e-5, 16
#: A gram in fewer documents than this is never heavy.
HEAVY = 10_000
#: Sizes of sets within this ratio count as alike when the prefix grams of a batch are linked.
ALIKE = 1.05
#: Rows of the incidence matrix in one block of the product, and their grams: a block ends at either.
ROW_BLOCK, BLOCK_GRAMS = 16_384, 1 << 20
#: Rows of a block whose pairs are accumulated together, and how many additions and how many pairs of theirs are held at once.
TILE, ADDITIONS, CELLS = 512, 1 << 21, 1 << 20
#: Bits of a gram's hash; seven bytes keep chance meetings rare among 10**14 grams.
BITS = 56
#: From this many rows a task is multiplied by tiles; smaller ones are taken together and their postings expanded.
DENSE_ROWS = 48
#: What an addition to one pair costs against a multiplication in a dense product, and against reading a pair's cell.
ADDITION, CELL = 640, 0.25
U64 = np.uint64


def _block(hashes: np.ndarray, count: int, bits: int = 64) -> np.ndarray:
    return ((hashes >> U64(bits - 24)) * U64(count) >> U64(24)).astype(np.int32)


def _sevens(data: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """A binary column of gram hashes, seven bytes each."""
    return tb.binaries(tb.pack7(data), np.asarray(cuts, np.int64) * 7)


def _grams_of(column: pa.ChunkedArray) -> np.ndarray:
    return tb.unpack7(tb.joined(column, np.uint8))


def _runs(*columns: np.ndarray) -> np.ndarray:
    """Where equal neighbours begin, with the length at the end."""
    n = len(columns[0])
    if not n:
        return np.zeros(1, np.int64)
    change = np.zeros(n, bool)
    change[0] = True
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), n)


def _need(n: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(threshold * n - 1e-9).astype(np.int64)


def _sets(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The sets of whole documents slice by slice: grams (sorted within a set), sizes, hashes of the sets, doc_ids."""
    for batch in batches:
        ids, text = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        for lo, hi in tb.slices(text):
            g, cuts = tb.grams(*tb.words(text.slice(lo, hi - lo)), n)
            if not len(g):
                continue
            g = g >> U64(64 - BITS)
            order = np.argsort(g)
            row = np.repeat(np.arange(hi - lo, dtype=np.uint16 if hi - lo < 1 << 16 else np.int64), np.diff(cuts))[order]
            again = np.argsort(row, kind="stable")
            g, row = g[order[again]], row[again]
            new = np.append(True, (g[1:] != g[:-1]) | (row[1:] != row[:-1]))
            every, row = g[new], row[new]
            first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
            sizes = np.diff(np.append(first, len(row)))
            keys = tb.mix(np.add.reduceat(tb.mix(every ^ U64(0x5851F42D4C957F2D)), first) + sizes.astype(U64))
            yield every, sizes, keys, ids[lo + row[first]].astype(np.int64)


def _flushes(batches: Iterator[pa.RecordBatch], n: int, count: int) -> Iterator[tuple[np.ndarray, ...]]:
    """The sets in lots of about FLUSH_GRAMS grams, or more where there are very many blocks."""
    parts, held = [], 0
    for part in _sets(batches, n):
        parts.append(part)
        held += len(part[0])
        if held >= max(FLUSH_GRAMS, FLUSH_BLOCK * count):
            yield tuple(np.concatenate(x) for x in zip(*parts))
            parts, held = [], 0
    if parts:
        yield tuple(np.concatenate(x) for x in zip(*parts))


def _sampled(n: int, count: int):
    """Grams of the sets of a sample, by block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for grams, *_ in _flushes(batches, n, count):
            grams = np.sort(grams)
            present, cuts = np.unique(_block(grams, count, BITS), return_index=True)
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), _sevens(grams, np.append(cuts, len(grams)))], names=["block", "grams"])

    return run


def _often(least: float):
    def run(table: pa.Table) -> pa.Table:
        g, held = np.unique(_grams_of(table["grams"]), return_counts=True)
        return pa.table({"gram": pa.array(g[held >= least].view(np.int64))})

    return run


def heavy_grams(source: DataFrame, n: int, documents: int, count: int) -> np.ndarray:
    """Grams of very many documents, sorted, as a sample of the documents shows them.

    Their postings would weigh on one task. All that the join needs of them is that they are shared and come last in the
    order of rarity, so they travel with their sets and not by gram. Whether a gram does changes no pair, so a sample may tell: up to
    2.5 * 10**8 documents a gram of one document in 250 (and of HEAVY at least) stands in SAMPLE_SETS sampled sets, beyond them one of a million
    documents, as the sample grows with the table. At most one in HEAVY of all occurrences is the number of heavy grams.
    """
    rate = min(1.0, max(SAMPLE / max(documents, 1), SAMPLE_SHARE))
    some = source.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    packs = some.mapInArrow(trimmed(_sampled(n, count)), "block int, grams binary")
    found = gathered(packs, count, "block", _often(max(SAMPLE_SETS, HEAVY * rate)), "gram long").collect()
    return np.array(sorted(r.gram for r in found), U64)


_GRAM_SCHEMA = "block int, grams binary, sets binary, lengths binary, owners binary, ids binary, sizes binary, heavy binary, heavy_sets binary, heavy_lengths binary"


def _by_block(block: np.ndarray, row: np.ndarray, edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Entries in the order of their block: that order, the rows' runs, and where blocks begin among entries and among runs."""
    order = np.argsort(block.astype(np.uint16) if len(edges) < 65536 and edges[-1] < 65536 else block, kind="stable")
    block, row = block[order], row[order]
    runs = _runs(block, row)
    cuts = np.searchsorted(block, edges)
    return order, runs, cuts, np.searchsorted(runs, cuts)


def _incidence(n: int, count: int, heavy):
    """Map side of exchange 1: gram blocks of the sets of whole documents, and the heavy grams by set."""

    def flush(grams: np.ndarray, sizes: np.ndarray, sets: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
        first = np.concatenate([[0], np.cumsum(sizes)])
        owner = _block(grams[first[:-1]], count, BITS)
        row = np.repeat(np.arange(len(sizes)), sizes)
        many = np.isin(grams, heavy.value) if len(heavy.value) else np.zeros(len(grams), bool)
        much, much_row = grams[many], row[many]
        grams, row = (grams[~many], row[~many]) if len(much) else (grams, row)
        block, much_block = _block(grams, count, BITS), _block(sets[much_row], count)
        present = np.unique(np.concatenate([np.unique(block), np.unique(owner), np.unique(much_block)]))
        edges = np.append(present, count + 1)
        order, runs, cuts, run_cuts = _by_block(block, row, edges)
        much_order, much_runs, much_cuts, much_run_cuts = _by_block(much_block, much_row, edges)
        own = np.argsort(owner, kind="stable")
        own_cuts = np.searchsorted(owner[own], edges)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(present, pa.int32()),
                _sevens(grams[order], cuts),
                tb.binaries(sets[row[order][runs[:-1]]], run_cuts),
                tb.binaries(np.diff(runs).astype(np.uint32), run_cuts),
                tb.binaries(sets[own], own_cuts),
                tb.binaries(ids[own], own_cuts),
                tb.binaries(sizes[own].astype(np.uint32), own_cuts),
                _sevens(much[much_order], much_cuts),
                tb.binaries(sets[much_row[much_order][much_runs[:-1]]], much_run_cuts),
                tb.binaries(np.diff(much_runs).astype(np.uint32), much_run_cuts),
            ],
            names=["block", "grams", "sets", "lengths", "owners", "ids", "sizes", "heavy", "heavy_sets", "heavy_lengths"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lot in _flushes(batches, n, count):
            yield flush(*lot)

    return run


_SET_SCHEMA = "block int, sets binary, lengths binary, grams binary, holders binary, owners binary, ids binary, sizes binary"


def _holders(count: int):
    """Reduce side of exchange 1: the grams that two sets or more hold, sent on by set."""

    def run(table: pa.Table) -> pa.Table:
        grams = _grams_of(table["grams"])
        lengths = tb.joined(table["lengths"], np.uint32)
        run_of = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        sets = tb.joined(table["sets"], U64)
        order = np.argsort(grams)
        g = grams[order]
        same = g[1:] == g[:-1]
        shared = np.zeros(len(g), bool)
        shared[1:] |= same
        shared[:-1] |= same
        order, g = order[shared], g[shared]
        entry = run_of[order]
        key = sets[entry]
        again = np.lexsort((key, g))
        g, key = g[again], key[again]
        if len(g):
            new = np.append(True, (g[1:] != g[:-1]) | (key[1:] != key[:-1]))
            g, key = g[new], key[new]
        runs = _runs(g)
        held = np.repeat(np.diff(runs), np.diff(runs))
        keep = held > 1
        # how rare a gram is decides its place only, for which eighths of a doubling do
        g, key, held = g[keep], key[keep], np.minimum(np.round(8 * np.log2(held[keep])), 254).astype(np.uint8)
        much = _grams_of(table["heavy"])
        if len(much):
            much_key = np.repeat(tb.joined(table["heavy_sets"], U64), tb.joined(table["heavy_lengths"], np.uint32))
            again = np.lexsort((much, much_key))
            much, much_key = much[again], much_key[again]
            new = np.append(True, (much[1:] != much[:-1]) | (much_key[1:] != much_key[:-1]))
            g, key, held = np.concatenate([g, much[new]]), np.concatenate([key, much_key[new]]), np.concatenate([held, np.full(int(new.sum()), 255, np.uint8)])
        order = np.argsort(key, kind="stable")
        g, key, held = g[order], key[order], held[order]
        runs = _runs(key)
        heads = key[runs[:-1]]
        head_block = _block(heads, count)
        owners, ids, sizes = tb.joined(table["owners"], U64), tb.joined(table["ids"], np.int64), tb.joined(table["sizes"], np.uint32)
        order = np.argsort(owners, kind="stable")
        owners, ids, sizes = owners[order], ids[order], sizes[order]
        own_block = _block(owners, count)
        present = np.union1d(head_block, own_block)
        edges = np.append(present, count + 1)
        cut, own = np.searchsorted(head_block, edges), np.searchsorted(own_block, edges)
        return pa.Table.from_arrays(
            [
                pa.array(present, pa.int32()),
                tb.binaries(heads, cut),
                tb.binaries(np.diff(runs).astype(np.uint32), cut),
                _sevens(g, runs[cut]),
                tb.binaries(held, runs[cut]),
                tb.binaries(owners, own),
                tb.binaries(ids, own),
                tb.binaries(sizes, own),
            ],
            names=["block", "sets", "lengths", "grams", "holders", "owners", "ids", "sizes"],
        )

    return run


_ROW_SCHEMA = "doc_id long, copy long, key long, members int, size int, prefix int, least long, grams binary"


def _rows(threshold: float):
    """Reduce side of exchange 2: sets that may have a partner, and the copies of each set."""

    def run(table: pa.Table) -> pa.Table:
        owners, ids = tb.joined(table["owners"], U64), tb.joined(table["ids"], np.int64)
        order = np.lexsort((ids, owners))
        owners, ids = owners[order], ids[order]
        first = _runs(owners)
        heads, least = owners[first[:-1]], ids[first[:-1]]
        total = tb.joined(table["sizes"], np.uint32)[order][first[:-1]].astype(np.int64)
        rep = np.repeat(least, np.diff(first))
        once = np.append(True, (ids[1:] != ids[:-1]) | (owners[1:] != owners[:-1]))[: len(ids)]
        members = np.add.reduceat(once, first[:-1], dtype=np.int32) if len(ids) else np.zeros(0, np.int32)
        every = np.repeat(members, np.diff(first))
        # of sets that several documents have: each of these, the representative too
        copies = once & (every > 1)
        lengths = tb.joined(table["lengths"], np.uint32)
        key = np.repeat(tb.joined(table["sets"], U64), lengths)
        g, held = _grams_of(table["grams"]), tb.joined(table["holders"], np.uint8)
        # the bound on shared grams against the size comes first, as it leaves few sets to be sorted
        if len(key):
            order = np.argsort(key, kind="stable")
            key, g, held = key[order], g[order], held[order]
            runs = _runs(key)
            m = np.diff(runs)
            alive = m >= _need(total[np.searchsorted(heads, key[runs[:-1]])], threshold)
            keep = np.repeat(alive, m)
            key, g, held = key[keep], g[keep], held[keep]
            order = np.lexsort((g, held, key))
            key, g = key[order], g[order]
        runs = _runs(key)
        at = np.searchsorted(heads, key[runs[:-1]]) if len(key) else np.zeros(0, np.int64)
        m, n, who = np.diff(runs), total[at], least[at]
        pairs = int(copies.sum())
        blank = pa.nulls(pairs, pa.int32())
        # the least of the scrambled grams: sets that overlap much mostly have the same
        low = np.minimum.reduceat(tb.mix(g), runs[:-1]) >> U64(1) if len(g) else np.zeros(0, U64)
        near = pa.Table.from_arrays(
            [pa.array(who), pa.nulls(len(who), pa.int64()), pa.array(heads[at].view(np.int64)), pa.array(members[at]), pa.array(n.astype(np.int32)), pa.array((m - _need(n, threshold) + 1).astype(np.int32)), pa.array(low.astype(np.int64)), _sevens(g, runs)],
            names=["doc_id", "copy", "key", "members", "size", "prefix", "least", "grams"],
        )
        same = pa.Table.from_arrays([pa.array(rep[copies]), pa.array(ids[copies]), pa.array(owners[copies].view(np.int64)), pa.array(every[copies]), blank, blank, pa.nulls(pairs, pa.int64()), pa.nulls(pairs, pa.binary())], names=near.schema.names)
        return pa.concat_tables([near, same])

    return run


def _prefix(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Prefix grams of a batch of rows (columns prefix and grams), and their rows."""
    prefix = batch.column("prefix").to_numpy(zero_copy_only=False).astype(np.int64)
    g = tb.unpack7(np.concatenate([np.frombuffer(x.as_buffer(), np.uint8)[: 7 * p] for x, p in zip(batch.column("grams"), prefix)]))
    return g, np.repeat(np.arange(batch.num_rows), prefix)


_POST_SCHEMA = "block int, grams binary, ids binary, sizes binary, near binary, far binary"


def _prefixes(count: int):
    """Map side of exchange 3: prefix grams by block.

    Rows of a batch that share a gram and are alike in size are linked here, and one of them goes on, so that a gram of very
    many sets sends few rows a batch.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            g, row = _prefix(batch)
            ids, sizes = batch.column("doc_id").to_numpy(), batch.column("size").to_numpy()
            kind = np.floor(np.log(sizes) / np.log(ALIKE)).astype(np.int64)[row]
            order = np.lexsort((row, kind, g))
            g, row, kind = g[order], row[order], kind[order]
            runs = _runs(g, kind)
            first = np.repeat(runs[:-1], np.diff(runs))
            other = np.flatnonzero(first != np.arange(len(g)))
            pairs = contracted(ids[row[first[other]]], ids[row[other]])
            g, row = g[runs[:-1]], row[runs[:-1]]
            block = _block(g, count, BITS)  # in order, as the grams are
            present, cuts = np.unique(block, return_index=True)
            cuts = np.append(cuts, len(g))
            own = np.append(np.zeros(len(present), np.int64), len(pairs[0]))
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), _sevens(g, cuts), tb.binaries(ids[row], cuts), tb.binaries(sizes[row].astype(np.int32), cuts), tb.binaries(pairs[0], own), tb.binaries(pairs[1], own)], names=["block", "grams", "ids", "sizes", "near", "far"])

    return run


def _links(threshold: float):
    """Reduce side of exchange 3: neighbours in the postings of each gram whose sizes allow the threshold."""

    def run(table: pa.Table) -> pa.Table:
        g, ids, sizes = _grams_of(table["grams"]), tb.joined(table["ids"], np.int64), tb.joined(table["sizes"], np.int32)
        order = np.lexsort((ids, sizes, g))
        g, ids, sizes = g[order], ids[order], sizes[order]
        # either side may stand for a set that differs from it in size by ALIKE
        link = (g[1:] == g[:-1]) & (sizes[:-1] >= threshold / ALIKE**2 * sizes[1:] - 1e-9)
        a, b = contracted(np.concatenate([ids[:-1][link], tb.joined(table["near"], np.int64)]), np.concatenate([ids[1:][link], tb.joined(table["far"], np.int64)]))
        return pa.Table.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return run


def _held(count: int, path: str):
    """Prefix grams of the row blocks of large components, by gram block: each row's block comes by its address from path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, owner = side.found(path, count, batch.column("file").to_numpy(), batch.column("row").to_numpy())
            if not len(at):
                continue
            part = batch.take(pa.array(at))
            g, row = _prefix(part)
            owner, size = owner[row], part.column("size").to_numpy()[row]
            order = np.lexsort((size, owner, g))
            g, owner, size = g[order], owner[order], size[order]
            runs = _runs(g, owner)
            low, high, g, owner = size[runs[:-1]], size[runs[1:] - 1], g[runs[:-1]], owner[runs[:-1]]
            block = _block(g, count, BITS)
            present, cuts = np.unique(block, return_index=True)
            cuts = np.append(cuts, len(g))
            yield pa.RecordBatch.from_arrays([pa.array(present, pa.int32()), _sevens(g, cuts), *(tb.binaries(x, cuts) for x in (owner, low.astype(np.int32), high.astype(np.int32)))], names=["block", "grams", "owners", "low", "high"])

    return run


def _meetings(threshold: float):
    """Pairs of row blocks that share a prefix gram and hold sets whose sizes allow the threshold, a <= b."""

    def run(table: pa.Table) -> pa.Table:
        g, owner, low, high = _grams_of(table["grams"]), tb.joined(table["owners"], np.int64), tb.joined(table["low"], np.int32), tb.joined(table["high"], np.int32)
        order = np.lexsort((owner, g))
        g, owner, low, high = g[order], owner[order], low[order], high[order]
        runs = _runs(g, owner)[:-1]
        if len(runs):
            g, owner, low, high = g[runs], owner[runs], np.minimum.reduceat(low, runs), np.maximum.reduceat(high, runs)
        length = np.diff(_runs(g))
        # each entry with itself and those behind it of the same gram, some at a time
        ahead = np.repeat(np.cumsum(length), length) - np.arange(len(g))
        seen = [np.zeros((0, 2), np.int64)]
        for lo in range(0, len(g), 1 << 14):
            n = ahead[lo : lo + (1 << 14)]
            i = np.repeat(np.arange(lo, lo + len(n)), n)
            j = i + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
            fits = (high[i] >= threshold * low[j] - 1e-9) & (high[j] >= threshold * low[i] - 1e-9)
            seen = [np.unique(np.concatenate([*seen, np.stack([owner[i[fits]], owner[j[fits]]], 1)]), axis=0)]
        pairs = seen[0]
        return pa.Table.from_arrays([pa.array(np.ascontiguousarray(pairs[:, k])) for k in (0, 1)], names=["a", "b"])

    return run


def _assigned(count: int, path: str):
    """The rows of each block of the product: a row comes as often as path has tasks for its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = side.found(path, count, batch.column("file").to_numpy(), batch.column("row").to_numpy())
            for lo in range(0, len(at), 4096):
                part, code = batch.take(pa.array(at[lo : lo + 4096])), value[lo : lo + 4096]
                yield pa.RecordBatch.from_arrays([pa.array(code >> 2), *(part.column(c) for c in ("doc_id", "key", "members", "size")), pa.array((code & 1).astype(np.int32)), pa.array(code & 2 != 0), part.column("grams")], names=["task", "doc_id", "key", "members", "size", "side", "cross", "grams"])

    return run


def _tasks(near: DataFrame, part: DataFrame, threshold: float, count: int) -> DataFrame:
    """(task, doc_id, key, members, size, side, cross, grams): the rows of each block of the product. A task is two row blocks of a component, or one with itself.

    All is worked out on ids and addresses; the grams move once, to their tasks. The two low bits of a
    task's code tell whether it is of two row blocks, and which one a row is of.
    """
    # grams of a row (they are its prefix and what it needs), and at least what ROW_BLOCK rows leave each
    room = F.greatest(F.col("prefix") + F.ceil(F.col("size") * threshold).cast("long"), F.lit(BLOCK_GRAMS // ROW_BLOCK))
    placed = materialise(near.join(part, F.col("doc_id") == F.col("node")).select("component", "doc_id", "least", room.alias("room"), "file", "row"), "component-rows")
    many = placed.groupBy("component").agg(F.sum("room").alias("_n")).where(F.col("_n") > BLOCK_GRAMS).select("component")
    code = lambda *x: F.shiftleft(F.xxhash64(*x), 2)
    small = placed.join(many, "component", "left_anti").select("file", "row", code("component").alias("value"))
    # large components: rows in the order of their least gram, a block's grams at a time, counted in two levels
    large = placed.join(many, "component", "left_semi").withColumn("bucket", F.shiftright("least", 51).cast("int"))
    totals = large.groupBy("component", "bucket").agg(F.sum("room").alias("_n"))
    before = totals.select("component", "bucket", (F.sum("_n").over(Window.partitionBy("component").orderBy("bucket")) - F.col("_n")).alias("_before"))
    within = F.sum("room").over(Window.partitionBy("component", "bucket").orderBy("least", "doc_id", "file", "row").rowsBetween(Window.unboundedPreceding, 0)) - F.col("room")
    numbered = large.withColumn("_within", within).join(before, ["component", "bucket"])
    block = F.xxhash64("component", F.floor((F.col("_before") + F.col("_within")) / BLOCK_GRAMS))
    blocks_ = materialise(numbered.select("file", "row", block.alias("value")), "row-blocks")
    held = near.select("size", "prefix", "grams", "file", "row").mapInArrow(_held(count, side.stored(blocks_, count, "row-blocks")), "block int, grams binary, owners binary, low binary, high binary")
    pairs = gathered(held, count, "block", _meetings(threshold), "a long, b long").distinct()
    cross = F.when(F.col("a") == F.col("b"), 0).otherwise(2)
    ends = pairs.select(code("a", "b").bitwiseOR(cross).alias("_task"), F.explode(F.array_distinct(F.array("a", "b"))).alias("value"), F.col("b"))
    spread = blocks_.join(ends, "value").select("file", "row", F.col("_task").bitwiseOR(F.when(F.col("_task").bitwiseAND(F.lit(2)) == 0, 0).otherwise((F.col("value") == F.col("b")).cast("int"))).alias("value"))
    path = side.stored(small.union(spread), count, "product-tasks")
    return near.select("doc_id", "key", "members", "size", "grams", "file", "row").mapInArrow(_assigned(count, path), "task long, doc_id long, key long, members int, size int, side int, cross boolean, grams binary")


def _spread(begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The numbers of ranges that begin at begin, behind each other."""
    return np.arange(int(length.sum())) + np.repeat(begin - np.cumsum(length) + length, length)


def _pieces(row: np.ndarray, length: np.ndarray) -> Iterator[slice]:
    """Entries whose ranges have about ADDITIONS numbers together, cut between rows."""
    last = np.flatnonzero(np.append(row[1:] != row[:-1], True)) + 1
    sums = np.cumsum(length)[last - 1]
    lo = at = 0
    while at < len(last):
        done = int(sums[at - 1]) if at else 0
        at = max(at + 1, int(np.searchsorted(sums, done + ADDITIONS, "right")))
        yield slice(lo, int(last[at - 1]))
        lo = int(last[at - 1])


def _tiles(row: np.ndarray, column: np.ndarray, other_row: np.ndarray, other_column: np.ndarray, rows: int, others: int, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Overlaps of the rows of one matrix with those of another, or (same) with the later ones of the same, tile by tile.

    Entries (some) come in the order of their rows. Columns with few additions in a tile are added pair by pair, the others multiplied.
    """
    order = np.argsort(other_column, kind="stable")
    post = other_row[order]
    starts = np.searchsorted(other_column[order], np.arange(int(max(column.max(), other_column.max())) + 2))
    begin = starts[column]
    if same:
        begin = np.empty(len(order), np.int64)
        begin[order] = np.arange(1, len(order) + 1)
    length = starts[column + 1] - begin
    cuts = np.searchsorted(row, np.arange(0, rows + TILE, TILE))
    for lo, s, e in zip(range(0, rows, TILE), cuts[:-1], cuts[1:]):
        if s == e:
            continue
        first = lo if same else 0
        high, wide = min(lo + TILE, rows) - lo, others - first
        columns, which = np.unique(column[s:e], return_inverse=True)
        work = np.bincount(which, weights=length[s:e])
        many = work * ADDITION > high * wide
        if work[many].sum() <= CELL * high * wide:
            many[:] = False
        thin = np.flatnonzero(~many[which]) + s
        if not many.any():
            for piece in _pieces(row[thin], length[thin]):
                at = thin[piece]
                code = np.sort(np.repeat(row[at] * others, length[at]) + post[_spread(begin[at], length[at])])
                runs = _runs(code)
                if len(runs) > 1:
                    yield code[runs[:-1]] // others, code[runs[:-1]] % others, np.diff(runs)
            continue
        total = np.zeros((high, wide), np.float32)
        chosen = columns[many]
        place = (np.cumsum(many) - 1)[which]
        fat = np.flatnonzero(many[which])
        fat = fat[np.argsort(place[fat], kind="stable")]
        step = max(64, ADDITIONS // max(wide, high))
        for c in range(0, len(chosen), step):
            part = chosen[c : c + step]
            a, b = np.searchsorted(place[fat], (c, c + step))
            left = np.zeros((high, len(part)), np.float32)
            left[row[s + fat[a:b]] - lo, place[fat[a:b]] - c] = 1
            n = starts[part + 1] - starts[part]
            holder, held = post[_spread(starts[part], n)], np.repeat(np.arange(len(part)), n)
            later = holder >= first
            right = np.zeros((wide, len(part)), np.float32)
            right[holder[later] - first, held[later]] = 1
            total += left @ right.T
        for piece in _pieces(row[thin], length[thin]) if len(thin) else ():
            at = thin[piece]
            np.add.at(total.ravel(), np.repeat((row[at] - lo) * wide - first, length[at]) + post[_spread(begin[at], length[at])], np.float32(1))
        if same:
            total = np.triu(total, 1)
        strip = max(1, CELLS // wide)
        for top in range(0, high, strip):
            i, j = np.nonzero(total[top : top + strip])
            yield i + (lo + top), j + first, total[i + top, j].astype(np.int64)


def _multiplied(grams: list[np.ndarray], side: np.ndarray | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of one task and their overlap: of all rows, or of those of side 0 with those of side 1."""
    row = np.repeat(np.arange(len(grams)), [len(x) for x in grams])
    _, column = np.unique(np.concatenate(grams), return_inverse=True)
    if side is None:
        keep = np.bincount(column)[column] > 1
        row, column = row[keep], column[keep]
        if len(row):
            yield from _tiles(row, column, row, column, len(grams), len(grams), True)
        return
    right = side[row] == 1
    both = (np.bincount(column, weights=right) > 0) & (np.bincount(column, weights=~right) > 0)
    left, right = ~right & both[column], right & both[column]
    if not left.any():
        return
    number = np.where(side == 1, np.cumsum(side == 1), np.cumsum(side != 1)) - 1
    here, there = np.flatnonzero(side != 1), np.flatnonzero(side == 1)
    for i, j, n in _tiles(number[row[left]], column[left], number[row[right]], column[right], len(here), len(there), False):
        yield here[i], there[j], n


def _overlaps(task: np.ndarray, grams: list[np.ndarray], side: np.ndarray, cross: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row pairs of the same task (of its two sides, if it has two) and their overlap, over complete tasks, some at a time."""
    cuts = _runs(task)
    small: list[np.ndarray] = []
    for lo, hi in zip(cuts[:-1], cuts[1:]):
        if hi - lo < 2:
            continue
        if hi - lo <= DENSE_ROWS:
            small.append(np.arange(lo, hi))
            continue
        for i, j, n in _multiplied(grams[lo:hi], side[lo:hi] if cross[lo] else None):
            yield i + lo, j + lo, n
    if small:
        rows = np.concatenate(small)
        size = np.array([len(grams[r]) for r in rows])
        every, row = np.concatenate([grams[r] for r in rows]), np.repeat(rows, size)
        order = np.lexsort((row, every, task[row]))
        every, row = every[order], row[order]
        runs = _runs(every, task[row])
        length = np.diff(runs)
        codes = []
        for k in np.unique(length[length > 1]):
            at = runs[:-1][length == k]
            i, j = np.triu_indices(k, 1)
            codes.append((row[at[:, None] + i] * len(grams) + row[at[:, None] + j]).ravel())
        if codes:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            i, j = code // len(grams), code % len(grams)
            apart = ~cross[i] | (side[i] != side[j])
            yield i[apart], j[apart], n[apart]


_PAIR_SCHEMA = "doc_id_a long, doc_id_b long, overlap long, jaccard double"


def _paired(ids: np.ndarray, table: pa.Table, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """The pairs themselves."""
    for i, j, n, union in found:
        a, b = np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j])
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(n.astype(np.int64)), pa.array(n / union)], names=["doc_id_a", "doc_id_b", "overlap", "jaccard"])


_COUNT_SCHEMA = "key long, a long, b long, n long"


def _counted(ids: np.ndarray, table: pa.Table, found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Of each set with a pair: key, document (a) and the number of documents in pairs with it (n). And (a, b) of edges that connect what the pairs connect."""
    key, members = table["key"].to_numpy(), table["members"].to_numpy().astype(np.int64)
    total = np.zeros(len(ids), np.int64)
    root = np.arange(len(ids))
    for i, j, *_ in found:
        total += np.bincount(i, members[j], len(ids)).astype(np.int64) + np.bincount(j, members[i], len(ids)).astype(np.int64)
        apart = root[i] != root[j]
        if apart.any():
            up = np.arange(len(ids))
            a, b = contracted(root[i[apart]], root[j[apart]])
            up[b] = a
            root = up[root]
    some, b = np.flatnonzero(total), np.flatnonzero(root != np.arange(len(ids)))
    a = root[b]
    blank, edge = pa.nulls(len(some), pa.int64()), pa.nulls(len(b), pa.int64())
    yield pa.RecordBatch.from_arrays([pa.array(key[some]), pa.array(ids[some]), blank, pa.array(total[some])], names=["key", "a", "b", "n"])
    yield pa.RecordBatch.from_arrays([edge, pa.array(ids[a]), pa.array(ids[b]), edge], names=["key", "a", "b", "n"])


def _product(threshold: float, made):
    """The product over row blocks: tasks come sorted, and a task that a batch cuts waits for its rest. made: _paired or _counted."""

    def solve(table: pa.Table) -> Iterator[pa.RecordBatch]:
        code = table["task"].to_numpy()
        ids, sizes, side, cross = (table[c].to_numpy() for c in ("doc_id", "size", "side", "cross"))
        sizes = sizes.astype(np.int64)
        every = _grams_of(table["grams"])
        ends = np.cumsum([len(x.as_buffer()) // 7 for x in table["grams"]])
        grams = np.split(every, ends[:-1])

        def found() -> Iterator[tuple[np.ndarray, ...]]:
            for i, j, n in _overlaps(code, grams, side, cross):
                union = sizes[i] + sizes[j] - n
                keep = n >= threshold * union - 1e-9
                yield i[keep], j[keep], n[keep], union[keep]

        return made(ids, table, found())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(pa.Table.from_batches([batch]))
            code = batch.column(0).to_numpy()
            cut = int(np.searchsorted(code != code[-1], False)) if code[0] == code[-1] else int(np.flatnonzero(code != code[-1])[-1]) + 1
            if cut:
                whole = pa.concat_tables(held[:-1] + [held[-1].slice(0, cut)])
                held = [held[-1].slice(cut)]
                yield from solve(whole)
        if held:
            yield from solve(pa.concat_tables(held))

    return run


def _found(docs: DataFrame, threshold: float, n: int, made, schema: str) -> tuple[DataFrame, DataFrame]:
    """What _product makes of all pairs, and the documents (copy) of each set (key) that several have, with the least of them (doc_id) and their number (members)."""
    spark, count = docs.sparkSession, blocks(docs)
    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    heavy = spark.sparkContext.broadcast(heavy_grams(source, n, docs.count(), count))
    by_gram = source.mapInArrow(trimmed(_incidence(n, count, heavy)), _GRAM_SCHEMA)
    by_set = gathered(by_gram, count, "block", _holders(count), _SET_SCHEMA)
    rows = materialise(gathered(by_set, count, "block", _rows(threshold), _ROW_SCHEMA), "incidence")
    near, file, row = side.addressed(rows, ["*"])
    near = near.withColumnsRenamed({file: "file", row: "row"}).where("copy IS NULL").drop("copy")
    posts = near.select("doc_id", "size", "prefix", "grams").mapInArrow(_prefixes(count), _POST_SCHEMA)
    part = connected_components(gathered(posts, count, "block", _links(threshold), "a long, b long"))
    tasks = _tasks(near, part, threshold, count)
    made = tasks.repartition(F.col("task")).sortWithinPartitions("task").mapInArrow(trimmed(_product(threshold, made)), schema)
    return made, rows.where("copy IS NOT NULL").select("key", "doc_id", "copy", "members")


def jaccard_pairs(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Every pair of documents whose sets of word n-grams have a Jaccard index of at least threshold.

    Columns doc_id_a < doc_id_b, overlap, jaccard. Documents with one and the same
    set are first folded into that of the least doc_id: such a document is given as a
    pair with this representative (jaccard 1), and near pairs are given between
    representatives, so a group of c copies adds c - 1 rows and not c * c / 2.

    Rows whose doc_id or text is null, and texts without a word, have no pair. A text
    of fewer than n words has one gram of all its words. Repeated rows of one doc_id
    count once (if their texts differ, each text takes part under that doc_id, and pairs of
    a doc_id with itself are left out). Other columns are not read. No documents: no rows.
    """
    pairs, same = _found(docs, threshold, n, _paired, _PAIR_SCHEMA)
    copies = same.select(F.col("doc_id").alias("doc_id_a"), F.col("copy").alias("doc_id_b"), F.lit(None).cast("long").alias("overlap"), F.lit(1.0).alias("jaccard"))
    return pairs.union(copies).where("doc_id_a <> doc_id_b")


def _classes(counted: DataFrame, same: DataFrame) -> DataFrame:
    """(node, component) of all documents that have a pair or a copy, by the edges of _counted."""
    return connected_components(counted.where("key IS NULL").select("a", "b").union(same.select(F.col("doc_id").alias("a"), F.col("copy").alias("b"))))


def jaccard_links(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, class_id, n_links): every document once, the least doc_id that chains of links lead to from it, and how many documents it is linked with.

    Documents are linked whose sets of word n-grams have a Jaccard index of at least threshold: all of them, copies and the near
    copies of copies too, so n_links adds up to twice the rows of expand_pairs(). Null texts and texts without a word are
    linked with nothing, and their class is their own. Rows whose doc_id is null have no name to be given by, and are
    left out. Repeated rows of one doc_id count once; if their texts have different sets, each of these takes part as a document of
    its own, and the doc_id's row has the sum of their links and their class in common. No documents: no rows.
    """
    made, same = _found(docs, threshold, n, _counted, _COUNT_SCHEMA)
    counted = materialise(made, "links")
    part = _classes(counted, same)
    total = counted.where("key IS NOT NULL").groupBy("key", F.col("a").alias("least")).agg(F.sum("n").alias("n"))
    copied = same.where("copy <> doc_id").join(total, "key").select("copy", "n")
    none = F.lit(None).cast("long")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), none.alias("component"), F.lit(0).cast("long").alias("n")).where("doc_id IS NOT NULL")
    for more in (part.select("node", "component", F.lit(0).cast("long")), total.select("least", none, "n"), copied.select("copy", none, "n"), same.select("copy", none, (F.col("members") - 1).cast("long"))):
        rows = rows.union(more)
    return rows.groupBy("doc_id").agg(F.coalesce(F.min("component"), F.col("doc_id")).alias("class_id"), F.sum("n").alias("n_links"))


def expand_pairs(pairs: DataFrame) -> DataFrame:
    """(doc_id_a, doc_id_b, jaccard): the pairs of jaccard_pairs() with those of all copies, doc_id_a < doc_id_b.

    A group of c copies gives c * (c - 1) / 2 rows, and c rows for each near pair of its representative. Exact where a doc_id
    has one text; of a doc_id with several, any of its texts may be the one that a pair is owed to.
    """
    pairs = materialise(pairs, "jaccard-pairs")
    copies = pairs.where("overlap IS NULL").select(F.col("doc_id_a").alias("first"), F.col("doc_id_b").alias("member"))
    group = copies.union(copies.select("first", F.col("first").alias("member"))).distinct()
    left, right = (group.select(F.col("first").alias(f"doc_id_{x}"), F.col("member").alias(f"member_{x}")) for x in "ab")
    near = pairs.where("overlap IS NOT NULL").join(left, "doc_id_a", "left").join(right, "doc_id_b", "left")
    near = near.select(F.coalesce("member_a", "doc_id_a").alias("a"), F.coalesce("member_b", "doc_id_b").alias("b"), "jaccard")
    inside = group.withColumnRenamed("member", "a").join(group.withColumnRenamed("member", "b"), "first").where("a < b").select("a", "b", F.lit(1.0).alias("jaccard"))
    every = near.union(inside).where("a <> b").select(F.least("a", "b").alias("doc_id_a"), F.greatest("a", "b").alias("doc_id_b"), "jaccard")
    return every.groupBy("doc_id_a", "doc_id_b").agg(F.max("jaccard").alias("jaccard"))


def near_duplicate_groups(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """(doc_id, group_id): documents joined by chains of pairs; a group is named by its least doc_id. Documents without a pair have no row."""
    made, same = _found(docs, threshold, n, _counted, _COUNT_SCHEMA)
    return _classes(materialise(made, "links"), same).select(F.col("node").alias("doc_id"), F.col("component").alias("group_id"))


def keep_one_of_each_group(docs: DataFrame, threshold: float = THRESHOLD, n: int = N) -> DataFrame:
    """Documents without the near duplicates: of each group the document with the least doc_id stays, once.

    Rows that have no pair (null doc_id or text, no words) all stay, and so do repeated
    rows of a doc_id that stays: they are one document.
    """
    drop = near_duplicate_groups(docs, threshold, n).where("doc_id <> group_id").select(F.col("doc_id").alias("_id"))
    placed, file, row = side.addressed(docs, ["*"])
    # ids and addresses alone are joined; the texts stay where they are
    gone = placed.select(F.col("doc_id").cast("long").alias("_id"), F.col(file).alias("file"), F.col(row).alias("row")).join(materialise(drop, "dropped"), "_id")
    count = blocks(docs)
    path = side.stored(gone.select("file", "row", F.lit(1).alias("value")), count, "dropped-rows")
    return placed.where(side.lookup(path, count, 0)(F.col(file), F.col(row)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
