"""Sharding by a k-d tree over document metadata.

The tree is grown level by level, by tables alone. Each level is one aggregate that finds the bytes and the extent of
every open node, and one that finds the weighted median along the widest dimension from a
histogram of BINS equal steps of the node's extent. Nodes above the target split there; rows of the others
are done and leave the table. Only the narrow metadata table takes part. Language and source count by their rank
among all values, whole strings in their order. The driver gets the finished splits as arrays, some 30 bytes a node.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .workspace import discard, fresh, materialise

TARGET_BYTES = 16 << 20
BINS = 1024
DIMENSIONS = ("lang", "source", "size", "number")
#: Splits of a level that are broadcast (40 bytes each); more are joined by shuffle.
TREE_NODES = 500_000
_PART = 33  # monotonically_increasing_id has the partition above these bits


def coordinates(docs: DataFrame) -> list[Column]:
    """The four dimensions and the weight: language, source, log2 of 1 + bytes, doc_id, and the bytes of the text; nulls are '' and 0."""
    weight = F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long")
    text = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in DIMENSIONS[:2]]
    return [*text, F.log2(1 + weight).alias("size"), F.coalesce(F.col("doc_id").cast("double"), F.lit(0.0)).alias("number"), weight.alias("bytes")]


def ranks(table: DataFrame, name: str) -> DataFrame:
    """(value, rank) of the distinct strings of a column, in their order from 0; sorted by ranges, so no task has them all."""
    values = table.select(F.col(name).alias("value")).distinct().repartitionByRange("value").sortWithinPartitions("value")
    values = materialise(values.withColumn("_id", F.monotonically_increasing_id()), "shard-values")
    part = F.shiftright("_id", _PART)
    before = values.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = before.select("_part", (F.sum("_n").over(Window.partitionBy().orderBy("_part")) - F.col("_n")).alias("_before"))
    numbered = values.join(F.broadcast(before), part == F.col("_part"))  # a row a partition
    return materialise(numbered.select("value", (F.col("_before") + F.col("_id").bitwiseAND(F.lit((1 << _PART) - 1))).cast("double").alias("rank")), "shard-ranks")


class Tree:
    """The splits as arrays: children of inner node i are child[i, 0] (value <= cut) and child[i, 1]; -1 - s is shard s.

    Shards are numbered in the order of their place. A cut of a string dimension is its number among the sorted cuts.
    """

    def __init__(self, levels: list[pa.Table]) -> None:
        """levels: (node, dim, cut, text, next), of which the children are called 2 * next and 2 * next + 1."""
        columns = [[level[c].to_numpy() for c in ("node", "dim", "cut", "next")] for level in levels]
        first = np.concatenate([[0], np.cumsum([len(x[0]) for x in columns])]).astype(np.int64)
        order = [np.argsort(x[0]) for x in columns]
        self.dim = np.concatenate([x[1][o] for x, o in zip(columns, order)]).astype(np.int8) if levels else np.zeros(0, np.int8)
        self.cut = np.concatenate([x[2][o] for x, o in zip(columns, order)]).astype(float) if levels else np.zeros(0)
        self.child = np.full((len(self.dim), 2), -1, np.int64)
        for depth in range(len(levels) - 1):
            names = columns[depth + 1][0][order[depth + 1]]
            for way in (0, 1):
                wanted = 2 * columns[depth][3][order[depth]] + way
                at = np.minimum(np.searchsorted(names, wanted), len(names) - 1)
                inner = names[at] == wanted
                self.child[first[depth] : first[depth + 1], way][inner] = first[depth + 1] + at[inner]
        # leaves below each node, from the last level up; then their numbers, from the root down
        below = np.ones((len(self.dim), 2), np.int64)
        for a, b in reversed(list(zip(first[:-1], first[1:]))):
            inner = self.child[a:b] >= 0
            below[a:b][inner] = below[self.child[a:b][inner]].sum(1)
        self.shards = int(below[0].sum()) if len(below) else 1
        start = np.zeros(len(self.dim), np.int64)
        for a, b in zip(first[:-1], first[1:]):
            at = np.stack([start[a:b], start[a:b] + below[a:b, 0]], 1)
            part = self.child[a:b]
            inner = part >= 0
            start[part[inner]] = at[inner]
            part[~inner] = -1 - at[~inner]
        self.texts: list[np.ndarray] = []
        text = np.concatenate([level["text"].to_pandas().to_numpy(object)[o] for level, o in zip(levels, order)]) if levels else np.zeros(0, object)
        for d in (0, 1):
            mine = np.flatnonzero(self.dim == d)
            names, number = np.unique(text[mine].astype(object), return_inverse=True) if len(mine) else (np.zeros(0, object), np.zeros(0))
            self.texts.append(names)
            self.cut[mine] = number

    def place(self, lang: pd.Series, source: pd.Series, size: np.ndarray, number: np.ndarray) -> np.ndarray:
        """The shards of rows, by a vectorised walk down the tree."""
        x = np.empty((4, len(size)))
        for d, column in enumerate((lang, source)):
            codes, values = pd.factorize(column)
            # above the i-th cut are the values that i + 1 cuts or more are less than
            x[d] = np.searchsorted(self.texts[d], np.asarray(values, object), "left")[codes] if len(self.texts[d]) else 0
        x[2], x[3] = size, number
        node = np.zeros(len(size), np.int64) if len(self.dim) else np.full(len(size), -1, np.int64)
        while len(live := np.flatnonzero(node >= 0)):
            at = node[live]
            node[live] = self.child[at, (x[self.dim[at], live] > self.cut[at]).astype(np.int8)]
        return -1 - node

    def shard(self, spark: SparkSession):
        """The shard of a row that has the coordinates."""
        held = spark.sparkContext.broadcast(self)

        def walk(lang: pd.Series, source: pd.Series, size: pd.Series, number: pd.Series) -> pd.Series:
            return pd.Series(held.value.place(lang, source, size.to_numpy(), number.to_numpy()))

        return F.pandas_udf(walk, "long")


def _known(table: DataFrame, rows: int) -> DataFrame:
    """A table of so many rows, one a node, with a broadcast hint if they are few enough."""
    return F.broadcast(table) if rows <= TREE_NODES else table


def build_tree(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> Tree:
    """Split until every leaf has at most target_bytes, or holds rows of one and the same place only."""
    plain = materialise(docs.select(*coordinates(docs)), "shard-plain")
    names = [ranks(plain, d) for d in DIMENSIONS[:2]]
    meta = plain
    for d, known in zip(DIMENSIONS, names):
        meta = meta.join(known.select(F.col("value").alias(d), F.col("rank").alias(f"{d}_rank")), d).drop(d)
    meta = materialise(meta.select(F.col("lang_rank").alias("lang"), F.col("source_rank").alias("source"), "size", "number", "bytes", F.lit(0).cast("long").alias("node")), "shard-meta")
    discard(plain)
    levels: list[DataFrame] = []
    width: list[float] | None = None
    while True:
        found = meta.groupBy("node").agg(F.sum("bytes").alias("bytes"), *(f(d).alias(f"{d}_{n}") for d in DIMENSIONS for n, f in (("lo", F.min), ("hi", F.max))))
        if width is None:
            root = found.first()
            if root is None:
                break
            width = [root[f"{d}_hi"] - root[f"{d}_lo"] for d in DIMENSIONS]
        share = F.array(*[(F.col(f"{d}_hi") - F.col(f"{d}_lo")) / w if w else F.lit(0.0) for d, w in zip(DIMENSIONS, width)])
        ends = [F.element_at(F.array(*[f"{d}_{n}" for d in DIMENSIONS]), F.col("dim") + 1).alias(n) for n in ("lo", "hi")]
        splits = found.withColumn("share", share).where((F.col("bytes") > target_bytes) & (F.array_max("share") > 0))
        splits = splits.withColumn("dim", (F.array_position("share", F.array_max("share")) - 1).cast("int")).select("node", "dim", *ends, F.col("bytes").cast("double").alias("total"))
        splits = materialise(splits, "shard-splits")
        count = splits.count()
        if not count:
            break
        value = F.element_at(F.array(*DIMENSIONS), F.col("dim") + 1)
        joined = meta.join(_known(splits, count), "node").withColumn("value", value)
        binned = joined.withColumn("bin", F.least(F.floor((F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo")) * BINS), F.lit(BINS - 1)).cast("int"))
        steps = binned.groupBy("node", "dim", "total", "bin").agg(F.sum("bytes").alias("bytes"), F.max("value").alias("top"))
        order = Window.partitionBy("node").orderBy("bin")
        steps = steps.withColumn("below", F.sum("bytes").over(order)).withColumn("more", F.lead("bin").over(order))
        # the first step that reaches half of the weight, but never the last that has rows
        steps = steps.where("more IS NOT NULL").withColumn("reached", F.col("below") * 2 >= F.col("total"))
        cuts = steps.groupBy("node", "dim").agg(F.coalesce(F.min(F.when(F.col("reached"), F.col("top"))), F.max("top")).alias("cut"))
        # children take new numbers at every level, so no depth is too deep for them
        level = materialise(cuts.withColumn("next", F.monotonically_increasing_id()), "shard-level")
        levels.append(level)
        old, meta = meta, materialise(meta.join(_known(level, count), "node").select(*DIMENSIONS, "bytes", (F.col("next") * 2 + (value > F.col("cut")).cast("int")).alias("node")), "shard-meta")
        discard(old), discard(splits)
    every = None
    for depth, level in enumerate(levels):
        part = level.withColumn("depth", F.lit(depth))
        every = part if every is None else every.union(part)
    if every is None:
        return Tree([])
    named = names[0].withColumn("dim", F.lit(0)).union(names[1].withColumn("dim", F.lit(1))).withColumnRenamed("value", "text")
    every = every.join(named, (every["dim"] == named["dim"]) & (every["cut"] == named["rank"]), "left").select("depth", "node", every["dim"], "cut", "text", "next").toArrow()
    depth = every["depth"].to_numpy()
    return Tree([every.filter(pa.array(depth == d)).combine_chunks() for d in range(len(levels))])


def assign_shards(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """The documents with a column shard (0, 1, ... in the order of the tree's leaves).

    No shard is above target_bytes of text unless it holds a single document, or rows
    that agree in all four dimensions (repeated rows stay together). A text null or empty weighs 0; a null language or
    source counts as '' and a null doc_id as 0. All columns are carried through; where one is called shard, whatever its case, the
    new one is called shard_ (and so on, until it clashes with none). No documents: no rows.
    """
    tree = build_tree(docs, target_bytes)
    return docs.select("*", tree.shard(docs.sparkSession)(*coordinates(docs)[:4]).alias(fresh("shard", docs.columns)))


def shard_table(docs: DataFrame, target_bytes: int = TARGET_BYTES) -> DataFrame:
    """(doc_id, bytes, shard) of every document."""
    tree = build_tree(docs, target_bytes)
    at = coordinates(docs)
    return docs.select("doc_id", at[4], tree.shard(docs.sparkSession)(*at[:4]).alias("shard"))
