"""Mixing sources to target weights by a low-discrepancy schedule.

Documents of each source are shuffled and laid end to end; every block_tokens tokens make
a block. Slot i of the schedule draws the golden-ratio point frac((i + 1/2) / phi), which the
cumulative target weights map to a source, and the r-th slot of a source takes its r-th block. Any
run of slots then holds each source within a few slots of its weight. The schedule is long
enough for every block to appear; sources above their natural share start over.

Running sums (tokens of a source, slots of a source) are taken in two levels, within buckets and
over bucket totals, so that no single task has to hold a hot source.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import rows as side
from .workspace import blocks, fresh, materialise

BLOCK_TOKENS = 8192
#: Target weights are the natural token shares to this power (1: as they are, 0: all sources alike).
TEMPERATURE = 0.7
SEED = "tidewell"
GOLDEN = 0.6180339887498949
#: Weights are whole parts of this.
PARTS = 1_000_000
#: With given weights a schedule may be this many times as long as all blocks at most.
LONGEST = 1000.0


def tokens(text: str = "text") -> Column:
    """Tokens of a text: maximal runs without white space; null has none."""
    return F.coalesce(F.regexp_count(F.col(text).cast("string"), F.lit(r"[^ \t\n\r]+")), F.lit(0)).cast("long")


def running(df: DataFrame, group: str, bucket: str, order: list[str], amount: Column, name: str) -> DataFrame:
    """Adds the sum of amount over all earlier rows of the group, in the order of (bucket, *order)."""
    df = df.withColumn("_amount", amount)
    totals = df.groupBy(group, bucket).agg(F.sum("_amount").alias("_total"))
    before = totals.withColumn("_before", F.sum("_total").over(Window.partitionBy(group).orderBy(bucket)) - F.col("_total")).drop("_total")
    within = F.sum("_amount").over(Window.partitionBy(group, bucket).orderBy(*order)) - F.col("_amount")
    return df.join(before, [group, bucket]).withColumn(name, F.col("_before") + within).drop("_before", "_amount")


def shuffle_key(docs: DataFrame) -> Column:
    """Where a document comes in its shuffled source: a hash of the seed, its doc_id and its text."""
    return F.md5(F.concat_ws("|", F.lit(SEED), F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.md5(F.coalesce(docs["text"].cast("string"), F.lit("")))))


def placed(docs: DataFrame) -> DataFrame:
    """(source, doc_id, place, n_tokens, file, row, start): every document with a token, its first token's place in the shuffled source, and its address."""
    columns = [F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"), F.col("doc_id").cast("long").alias("doc_id"), shuffle_key(docs).alias("place"), tokens().alias("n_tokens")]
    rows, file, row = side.addressed(docs, columns)
    rows = rows.withColumnsRenamed({file: "file", row: "row"}).where("n_tokens > 0").withColumn("bucket", F.substring("place", 1, 3))
    rows = materialise(rows, "mix-rows")
    # equal rows (same doc_id and text) are told apart by a number, so that each has its own tokens
    same = Window.partitionBy("source", "bucket").orderBy("place", F.col("doc_id").asc_nulls_first(), "file", "row")
    numbered = rows.withColumn("_row", F.row_number().over(same))
    return running(numbered, "source", "bucket", ["_row"], F.col("n_tokens"), "start").drop("_row", "bucket")


def target_weights(rows: DataFrame, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """(source, total, weight, high, number): tokens, the source's part [high - weight, high) of PARTS, and its number in the order of the parts.

    Given weights apply to the sources they name; other sources then get none. Otherwise the weights follow the temperature.
    """
    totals = rows.groupBy("source").agg(F.sum("n_tokens").cast("double").alias("total"))
    every = Window.partitionBy()
    if weights is None:
        share = F.pow(F.col("total") / F.sum("total").over(every), F.lit(temperature))
    else:
        known = rows.sparkSession.createDataFrame(sorted(weights.items()) or [("", 0.0)], "source string, _w double")
        totals, share = totals.join(known, "source").where("_w > 0"), F.col("_w")
    parts = totals.withColumn("_s", share).withColumn("weight", F.greatest(F.round(F.col("_s") / F.sum("_s").over(every) * PARTS), F.lit(1)).cast("long"))
    order = Window.partitionBy().orderBy("source")
    return parts.select("source", F.col("total").cast("long").alias("total"), "weight", F.sum("weight").over(order).alias("high"), (F.row_number().over(order) - 1).alias("number"))


def drawn_slots(parts: DataFrame, length: int) -> DataFrame:
    """(slot, number): the first slots, with the number of the source that each one draws, by binary search in the cumulative weights."""
    spark = parts.sparkSession
    held = spark.sparkContext.broadcast(np.sort(parts.select("high").toArrow()["high"].to_numpy()))  # eight bytes a source

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        high = held.value
        for batch in batches:
            at = (batch.column(0).to_numpy() + 0.5) * GOLDEN
            point = np.floor((at - np.floor(at)) * float(high[-1])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.searchsorted(high, point, "right").astype(np.int32))], names=["slot", "number"])

    return spark.range(length).mapInArrow(draw, "slot long, number int")


def missing_slots(parts: DataFrame, length: int, whole: int) -> int:
    """The slots by which a schedule of so many must grow, by the weights, for every source to have all its blocks; 0 if it has them."""
    counts = drawn_slots(parts, length).groupBy("number").agg(F.count("*").alias("_n"))
    short = parts.join(counts, "number", "left").withColumn("_short", F.col("blocks") - F.coalesce(F.col("_n"), F.lit(0))).where("_short > 0")
    return int(short.agg(F.max(F.ceil(F.col("_short") * F.lit(float(whole)) / F.col("weight")))).first()[0] or 0)


def schedule(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> tuple[DataFrame, DataFrame]:
    """(slots, places): (slot, source, block, epoch), and the documents' places as placed() gives them.

    A given weight so small that all blocks of its source need a schedule of more than LONGEST times all blocks is an error.
    """
    spark = docs.sparkSession
    places = materialise(placed(docs), "mix-places")
    parts = materialise(target_weights(places, temperature, weights).withColumn("blocks", F.ceil(F.col("total") / block_tokens).cast("long")), "mix-weights")
    whole, length = parts.agg(F.max("high"), F.max(F.ceil(F.col("blocks") * F.lit(float(PARTS)) / F.col("weight")))).first()
    if whole is None:
        empty = spark.createDataFrame([], "slot long, source string, block long, epoch long")
        return empty, places
    # rounding leaves a source a slot short now and then: one block of every source more
    length = int(math.ceil(length * whole / PARTS)) + parts.count()
    if weights is not None and length > LONGEST * parts.agg(F.sum("blocks")).first()[0]:
        raise ValueError(f"with these weights a schedule that has every block takes {length} slots; leave out the sources of very small weight or raise mixing.LONGEST")
    # a run of slots strays from the weights by more than this at times: on until every source has all its blocks
    while more := missing_slots(parts, length, whole):
        length += more
    drawn = drawn_slots(parts, length).join(parts.select("number", "source", "blocks"), "number").withColumn("bucket", F.floor(F.col("slot") / 65536))
    ranked = running(drawn, "source", "bucket", ["slot"], F.lit(1), "rank")
    return ranked.select("slot", "source", (F.col("rank") % F.col("blocks")).alias("block"), F.expr("rank div blocks").alias("epoch")), places


def mixed_blocks(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """(slot, source, block, epoch, doc_id, token_from, token_to): the schedule with the pieces of documents in each block.

    Token positions count from 0 within the document, token_to is not included. A document that
    crosses block borders has a piece in each block. Every block of a source with a weight
    appears in epoch 0. Texts without a token have no piece; a null source is the source ''; a null doc_id is kept;
    repeated rows are laid behind each other as documents of their own. No documents: no rows.
    """
    slots, places = schedule(docs, block_tokens, temperature, weights)
    first, last = F.expr(f"start div {block_tokens}"), F.expr(f"(start + n_tokens - 1) div {block_tokens}")
    pieces = places.withColumn("block", F.explode(F.sequence(first, last)))
    pieces = pieces.select("source", "block", "doc_id", (F.greatest(F.col("block") * block_tokens, F.col("start")) - F.col("start")).alias("token_from"), (F.least((F.col("block") + 1) * block_tokens, F.col("start") + F.col("n_tokens")) - F.col("start")).alias("token_to"))
    return slots.join(pieces, ["source", "block"]).select("slot", "source", "block", "epoch", "doc_id", "token_from", "token_to")


def mix_documents(docs: DataFrame, block_tokens: int = BLOCK_TOKENS, temperature: float = TEMPERATURE, weights: dict[str, float] | None = None) -> DataFrame:
    """The documents as often as the schedule has the block of their first token; the columns stay as they are.

    Whole documents are kept: each one of a source with a weight appears once or more, and a source above its natural share repeats.
    A text without a token is in no block and appears once, also of a source without a weight. Each row has its own count, repeated rows too; a null source is
    the source ''. No documents: no rows.
    """
    docs = side.scanned(docs)
    slots, places = schedule(docs, block_tokens, temperature, weights)
    times = slots.groupBy("source", "block").agg(F.count("*").alias("times"))
    home = places.withColumn("block", F.expr(f"start div {block_tokens}")).join(times, ["source", "block"], "left")
    # addresses and counts alone travel; the texts stay where they are
    count = blocks(docs)
    path = side.stored(home.select("file", "row", F.coalesce("times", F.lit(0)).alias("value")), count, "mix-copies")
    rows, file, row = side.addressed(docs, ["*"])
    i = fresh("_i", rows.columns)
    copies = rows.withColumn(i, side.lookup(path, count, 1)(F.col(file), F.col(row))).where(F.col(i) > 0)
    return copies.withColumn(i, F.explode(F.sequence(F.lit(1), F.col(i).cast("int")))).select(*[F.col(f"`{c}`") for c in docs.columns])
