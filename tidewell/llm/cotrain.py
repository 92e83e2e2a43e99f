"""Quality classifier by co-training of a text-content view and a page-metadata view.

The content view sees the text alone: its words (hashed), token shapes, repeats and layout. The metadata view sees
nothing of the text: language, source, their pair, and the declared number of characters. Each view is a logistic regression. First both are fitted to the labelled rows. Then, over several
rounds, every unlabelled document is scored by both; where one calibrated view is confident, its
verdict becomes a pseudo-label for the other, which takes a Newton step on the labelled and the pseudo-labelled
rows. These steps need only sums over documents, which the executors form. In the end both
views are calibrated on held-out labels, and their weighted evidence scores all documents.
A view that tells nothing is never confident, teaches nothing and gets no weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import rows as side
from . import textbatch as tb
from .workspace import blocks, least_hashed, materialise, trim, trimmed

#: At most so many labelled documents (those of the least hash of their doc_id) are fitted on; all others are pseudo-labelled, and every document is scored.
MAX_LABELLED = 20_000
ROUNDS = 3
#: Calibrated probability from which a view passes its verdict on.
CONFIDENT = 0.995
RIDGE = 0.1
SHAPES, WORDS, PAIRS = 64, 256, 512
CONTENT = SHAPES + WORDS + 5 + 11
LANGS, SOURCES, BOTH, SIZES = 8, 32, 64, 24
META = LANGS + SOURCES + BOTH + SIZES + 2

_CLASS = np.zeros(256, np.uint16)
for _bit, _chars in enumerate(("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".", ",;:", "!?", "#$%&*", "\"'()[]{}", "|", "@=+-/\\_<>~^`")):
    _CLASS[[ord(c) for c in _chars]] = 1 << _bit
_CLASS[128:] = 1 << 10
_UPPER, _DIGIT, _SYMBOL = (np.isin(np.arange(256), [ord(c) for c in s]) for s in ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "!?#$%&*|@=+\\_<>~^`"))


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    return part / np.maximum(whole, 1)


def content_view(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the text is made of: shares of token shapes and of hashed words, repeats and lengths, cases and symbols, lines, entropy."""
    n = len(offsets) - 1
    out = np.zeros((n, CONTENT), np.float32)
    starts, ends, doc = tb.spans(~tb.SPACE[data], offsets)
    if not len(starts):
        return out
    length = ends - starts
    bits = np.bitwise_or.reduceat(_CLASS[data], starts)
    shape = bits.astype(np.uint32) * np.uint32(4) + np.searchsorted([3, 8, 16], length).astype(np.uint32)
    bucket = (shape * np.uint32(0x9E3779B1) >> np.uint32(16)) % np.uint32(SHAPES)
    count = np.bincount(doc, minlength=n)
    out[:, :SHAPES] = np.sqrt(_share(np.bincount(doc * SHAPES + bucket, minlength=n * SHAPES).reshape(n, SHAPES), count[:, None]))
    at = SHAPES + WORDS
    out[:, at + 2] = _share(np.bincount(doc, length, n), count) / 10
    out[:, at + 3] = np.log1p(count) / 10
    # words in lower case (of ASCII letters)
    s, e, owner = tb.spans(tb.WORD[data], offsets)
    h = tb.span_hash(tb.prefix_hash(data | (np.uint8(32) * _UPPER[data])), s, e)
    many = np.bincount(owner, minlength=n)
    out[:, SHAPES:at] = np.sqrt(_share(np.bincount(owner * WORDS + (h % np.uint64(WORDS)).astype(np.int64), minlength=n * WORDS).reshape(n, WORDS), many[:, None]))
    out[:, at] = _share(np.bincount(owner[1:][(h[1:] == h[:-1]) & (owner[1:] == owner[:-1])], minlength=n), many)
    order = np.argsort(h)
    order = order[np.argsort(owner[order].astype(np.uint16) if n < 1 << 16 else owner[order], kind="stable")]
    new = np.append(True, (h[order][1:] != h[order][:-1]) | (owner[order][1:] != owner[order][:-1])) if len(h) else np.zeros(0, bool)
    out[:, at + 1] = _share(np.bincount(owner[order][new], minlength=n), many)
    out[:, at + 4] = out[:, at + 1] * out[:, at + 3]
    out[:, at + 5 :] = _layout(data, offsets)
    return out


def _layout(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Lines, shares of capitals, digits, symbols, spaces and other alphabets, and the entropy of bytes and pairs of bytes."""
    n, size = len(offsets) - 1, np.diff(offsets)
    out = np.zeros((n, 11), np.float32)

    def count(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which, dtype=np.int32 if len(which) < 1 << 31 else np.int64)])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    breaks = count(data == 10)
    out[:, 0] = np.log1p(breaks) / 5
    out[:, 1] = np.log1p(size / (breaks + 1)) / 10
    for i, which in enumerate((_UPPER, _DIGIT, _SYMBOL, tb.SPACE, np.arange(256) > 127)):
        out[:, 2 + i] = np.sqrt(_share(count(which[data]), size))
    out[:, 7] = out[:, 2] ** 2 * 4
    out[:, 8] = out[:, 4] ** 2 * 8
    # how well the page would compress
    row = np.repeat(np.arange(n), size)
    for i, (symbol, many) in enumerate(((data.astype(np.int64), 256), (((data[1:].astype(np.uint32) * np.uint32(0x9E3779B1) ^ data[:-1].astype(np.uint32) * np.uint32(0x85EBCA77)) >> np.uint32(23)).astype(np.int64), PAIRS))):
        counts = np.bincount(row[: len(symbol)] * many + symbol, minlength=n * many).reshape(n, many)
        total = np.maximum(counts.sum(1), 1)
        p = counts / total[:, None]
        out[:, 9 + i] = -(p * np.log2(np.maximum(p, 1e-12))).sum(1) / np.minimum(np.log2(total + 1), np.log2(many))
    return out


def _hashes(column: pa.Array) -> np.ndarray:
    data, offsets = tb.utf8(column)
    return tb.span_hash(tb.prefix_hash(data), offsets[:-1], offsets[1:]) if len(column) else np.zeros(0, np.uint64)


def meta_view(lang: pa.Array, source: pa.Array, n_chars: np.ndarray) -> np.ndarray:
    """Language, source, the two together and the declared size, without a look at the text."""
    n = len(n_chars)
    out = np.zeros((n, META), np.float32)
    a, b = _hashes(lang), _hashes(source)
    size = np.log2(1.0 + n_chars)
    at, row = 0, np.arange(n)
    for code, many in ((a, LANGS), (b, SOURCES), (tb.mix(a * np.uint64(0x9E3779B97F4A7C15) + b), BOTH), (np.minimum(size, SIZES - 1), SIZES)):
        out[row, at + (code % np.uint64(many) if code.dtype == np.uint64 else code).astype(np.int64)] = 1
        at += many
    out[:, at] = size / 16
    out[:, at + 1] = (size / 16) ** 2
    return out


def _chunks(x: np.ndarray, y: np.ndarray, rows: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Some rows at a time as doubles with a constant, and their labels."""
    for lo in range(0, len(x), rows):
        part = x[lo : lo + rows]
        yield np.concatenate([part, np.ones((len(part), 1), part.dtype)], 1).astype(float), y[lo : lo + rows]


def _p(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


@dataclass
class View:
    """Weights (the last is the constant) and the calibration z -> a * z + b."""

    w: np.ndarray
    a: float = 1.0
    b: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.a * (x @ self.w[:-1] + self.w[-1]) + self.b, -12, 12)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Gradient and Hessian of the log-likelihood over rows, in one vector."""
        d = len(self.w)
        gradient, hessian = np.zeros(d), np.zeros((d, d))
        for part, truth in _chunks(x, y):
            p = _p(part @ self.w)
            gradient += part.T @ (truth - p)
            hessian += (part * (p * (1 - p))[:, None]).T @ part
        return np.concatenate([gradient, hessian.ravel(), [len(y)]])

    def step(self, sums: np.ndarray, x: np.ndarray, y: np.ndarray) -> None:
        """A Newton step by the sums, shortened until the labelled rows (x, y) fit no worse than before (by a hundredth a row at most)."""
        d = len(self.w)
        ridge = np.full(d, RIDGE)
        ridge[-1] = 1e-3
        move = np.linalg.solve(sums[d : d + d * d].reshape(d, d) + np.diag(ridge), sums[:d] - ridge * self.w)

        def fit(w: np.ndarray) -> float:
            return -sum(np.logaddexp(0, -(2 * truth - 1) * (part @ w)).sum() for part, truth in _chunks(x, y)) - 0.5 * (ridge * w * w).sum()

        least = fit(self.w) - 0.01 * len(y)
        for _ in range(12):
            if fit(self.w + move) >= least:
                self.w = self.w + move
                return
            move = move / 2

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """Platt's two numbers with his smoothed targets, by damped Newton steps."""
        z = x @ self.w[:-1] + self.w[-1]
        up, down = (y == 1).sum(), (y == 0).sum()
        target = np.where(y == 1, (up + 1) / (up + 2), 1 / (down + 2))
        z = np.stack([z, np.ones(len(z))], 1)
        at = np.array([1.0, 0.0])
        loss = lambda v: (np.logaddexp(0, z @ v) - target * (z @ v)).sum() + 5e-4 * (v * v).sum()
        for _ in range(60):
            p = _p(z @ at)
            move = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag([1e-3, 1e-3]), z.T @ (target - p) - 1e-3 * at)
            while loss(at + move) > loss(at) and np.abs(move).max() > 1e-9:
                move = move / 2
            at = at + move
            if np.abs(move).max() < 1e-7:
                break
        # a view that is no better than chance says what is usual
        usual = float(np.log(target.mean() / (1 - target.mean())))
        self.a, self.b = (float(at[0]), float(at[1])) if at[0] > 0 else (0.0, usual)


@dataclass
class Model:
    content: View
    meta: View
    blend: np.ndarray

    def logit(self, c: np.ndarray, m: np.ndarray) -> np.ndarray:
        """The calibrated evidence of both views, weighted as the held-out labels have it."""
        return np.stack([self.content.logit(c), self.meta.logit(m), np.ones(len(c))], 1) @ self.blend

    def combine(self, c: np.ndarray, m: np.ndarray, y: np.ndarray) -> None:
        """Weights of the two views and a constant, by logistic regression held near a plain mean of the two."""
        x = np.stack([self.content.logit(c), self.meta.logit(m), np.ones(len(y))], 1)
        near, hold = np.array([0.5, 0.5, 0.0]), np.array([1.0, 1.0, 1.0])
        w = near.copy()
        loss = lambda v: (np.logaddexp(0, x @ v) - y * (x @ v)).sum() + 0.5 * (hold * (v - near) ** 2).sum()
        for _ in range(40):
            p = _p(x @ w)
            move = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(hold), x.T @ (y - p) - hold * (w - near))
            while loss(w + move) > loss(w) and np.abs(move).max() > 1e-9:
                move = move / 2
            w = w + move
            if np.abs(move).max() < 1e-7:
                break
        w[:2] = np.maximum(w[:2], 0)
        self.blend = w


def _views(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Row ranges with the features of a batch of (doc_id, text, lang, source, n_chars, ...)."""
    text = batch.column(1)
    chars = batch.column(4).fill_null(0).to_numpy(zero_copy_only=False)
    for lo, hi in tb.slices(text):
        yield lo, hi, content_view(*tb.utf8(text.slice(lo, hi - lo))), meta_view(batch.column(2).slice(lo, hi - lo), batch.column(3).slice(lo, hi - lo), np.maximum(chars[lo:hi], 0))


def _columns(docs: DataFrame) -> list:
    return [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.expr("try_cast(n_chars AS long)").alias("n_chars")]


_TABLE = "doc_id long, file long, row long, content binary, meta binary"


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, file, row, content, meta): both views of every document, as half-precision bytes, with its address."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, c, m in _views(batch):
                pack = lambda x: tb.binaries(x.astype(np.float16).ravel(), np.arange(hi - lo + 1) * x.shape[1])
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(lo, hi - lo) for i in (0, 5, 6)), pack(c), pack(m)], names=["doc_id", "file", "row", "content", "meta"])

    return side.addressed(docs, _columns(docs))[0].mapInArrow(trimmed(run), _TABLE)


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return tb.joined(column, np.float16).reshape(-1, width).astype(np.float32)


def _pseudo(model: Model) -> Callable:
    """Sums over the unlabelled rows of a task: what each view learns from the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = [np.zeros(w + w * w + 1) for w in (CONTENT + 1, META + 1)]
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                c, m = _matrix(part.column(0), CONTENT), _matrix(part.column(1), META)
                for i, (view, x, teacher, seen) in enumerate(((model.content, c, model.meta, m), (model.meta, m, model.content, c))):
                    p = _p(teacher.logit(seen))
                    sure = (p >= CONFIDENT) | (p <= 1 - CONFIDENT)
                    if sure.any():
                        totals[i] += view.sums(x[sure], (p[sure] > 0.5).astype(float))
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % 32], pa.int32()), pa.array([totals[0].tobytes()]), pa.array([totals[1].tobytes()])], names=["part", "content", "meta"])

    return run


def _added(table: pa.Table) -> pa.Table:
    pack = lambda name: pa.array([np.sum([np.frombuffer(x.as_buffer()) for x in table[name]], axis=0).tobytes()])
    return pa.Table.from_arrays([table["part"].slice(0, 1), pack("content"), pack("meta")], names=["part", "content", "meta"])


def truth(labels: DataFrame) -> DataFrame:
    """(doc_id, quality): one label a document, the majority of its labels (a tie is good); null ids and labels are left out."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL")
    return known.groupBy("doc_id").agg((F.avg("quality") >= 0.5).cast("int").alias("quality"))


def train(table: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> Model | None:
    """The model, from the features of all documents; None unless there are labelled documents of either quality."""
    # only labels whose document is there: the sample is cut by their count
    known = materialise(truth(labels).join(table.select("doc_id"), "doc_id", "left_semi"), "quality-labels")
    chosen = materialise(least_hashed(known, "doc_id", max_labelled, known.count()), "quality-sample")
    named = table.select("doc_id", "content", "meta").join(F.broadcast(chosen), "doc_id", "left")  # at most max_labelled rows
    sample = named.where("quality IS NOT NULL").toArrow()
    ids, contents = sample["doc_id"].to_pylist(), sample["content"].to_pylist()
    order = np.array(sorted(range(len(ids)), key=lambda i: (ids[i], contents[i])), np.int64)
    y = sample["quality"].to_numpy()[order].astype(float)
    if not (y == 1).any() or not (y == 0).any():
        return None
    c, m = (_matrix(sample[k], width)[order] for k, width in (("content", CONTENT), ("meta", META)))
    del sample, ids, contents
    held = np.arange(len(y)) % 4 == 3
    for which in (0, 1):  # either side needs both qualities
        if not (y[held] == which).any() or not (y[~held] == which).any():
            held[:] = False
    fit, check = ~held, held if held.any() else ~held
    model = Model(View(np.zeros(CONTENT + 1)), View(np.zeros(META + 1)), np.zeros(3))
    pairs = ((model.content, c), (model.meta, m))
    for view, x in pairs:
        for _ in range(12):
            view.step(view.sums(x[fit], y[fit]), x[fit], y[fit])
        view.calibrate(x[check], y[check])
    unlabelled = named.where("quality IS NULL").select("content", "meta")
    for _ in range(rounds):
        found = unlabelled.mapInArrow(trimmed(_pseudo(model)), "part int, content binary, meta binary").groupBy("part").applyInArrow(_added, "part int, content binary, meta binary").orderBy("part").collect()
        for (view, x), name in zip(pairs, ("content", "meta")):
            extra = np.sum([np.frombuffer(r[name]) for r in found], axis=0) if found else 0.0
            own = view.sums(x[fit], y[fit])
            # pseudo-labels together weigh no more than the labels
            many = extra[-1] if found else 0.0
            view.step(own + extra * min(1.0, own[-1] / many) if many else own, x[fit], y[fit])
        for view, x in pairs:
            view.calibrate(x[check], y[check])
    model.combine(c[check], m[check], y[check])
    trim()
    return model


def score_quality(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, keep): the probability that each document is good, and whether it is 0.5 or more.

    Labels are matched by doc_id; see truth() for several labels of one. Without labels of either
    quality every score is 0.5. A null or empty text, null lang, source or n_chars have features like any other (empty, unknown, 0);
    texts of any length are read whole. Repeated rows are scored alike, each in a row. Other columns are not read. No documents: no rows.
    """
    table = materialise(features(docs), "quality-features")
    return table.select("doc_id", "content", "meta").mapInArrow(_scored(train(table, labels, rounds, max_labelled)), "doc_id long, score double, keep boolean")


def _scored(model: Model | None) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                part = batch.slice(lo, 4096)
                p = _p(model.logit(_matrix(part.column(1), CONTENT), _matrix(part.column(2), META))) if model else np.full(part.num_rows, 0.5)
                p = np.round(p, 6)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(p), pa.array(p >= 0.5)], names=["doc_id", "score", "keep"])

    return run


def keep_good(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """The documents that the classifier keeps, with all their columns; judged row by row, so null or repeated doc_ids make no difference."""
    docs = side.scanned(docs)
    table = materialise(features(docs), "quality-features")
    model = train(table, labels, rounds, max_labelled)
    if model is None:
        return docs
    count = blocks(docs)

    def rejected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _scored(model)(iter([pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), *batch.columns[2:]], names=["doc_id", "content", "meta"])])):
                bad = part.column(0).filter(pc.invert(part.column(2))).to_numpy()
                if len(bad):
                    yield side.pack(batch.column(0).to_numpy()[bad], batch.column(1).to_numpy()[bad], np.ones(len(bad)), count)

    path = side.store(table.select("file", "row", "content", "meta").mapInArrow(rejected, side.PACKED), count, "rejected-rows")
    placed, file, row = side.addressed(docs, ["*"])
    return placed.where(side.lookup(path, count, 0)(F.col(file), F.col(row)) == 0).select(*[F.col(f"`{c}`") for c in docs.columns])
