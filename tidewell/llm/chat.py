"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole and encoded once; each token's offsets are those of its bytes, and the sorted spans
that are to be learnt are intersected with the token spans by binary search, for many conversations at a time.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb

#: A byte-level vocabulary: lines of a token in base64 and its rank.
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How a text is divided before pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEARNT = ("assistant",)


def vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


_ENCODERS: dict[int, tuple] = {}


def _encoder(ranks: dict[bytes, int], pattern: str) -> tuple:
    """The encoder and the bytes of each token, made once a worker."""
    if id(ranks) not in _ENCODERS:
        import tiktoken

        width = np.zeros(max(ranks.values()) + 1, np.int64)
        width[list(ranks.values())] = [len(token) for token in ranks]
        _ENCODERS[id(ranks)] = tiktoken.Encoding("chat", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), width
    return _ENCODERS[id(ranks)]


def mask(start: np.ndarray, end: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """1 for each token (start, end) that lies within one of the spans (first, last), by binary search over the sorted spans."""
    if not len(first):
        return np.zeros(len(start), np.int8)
    at = np.searchsorted(first, start, "right") - 1
    return ((at >= 0) & (end <= last[np.maximum(at, 0)]) & (end > start)).astype(np.int8)


def format_chats(conversations: DataFrame, tokenizer: str = TOKENIZER, learnt: tuple[str, ...] = LEARNT, pattern: str = PATTERN) -> DataFrame:
    """(conv_id, n_tokens, n_learnt, input_ids, loss_mask) of every conversation.

    Turns stand in the order of turn (nulls first; equal numbers by role, then text), each as
    <|role|>, newline, text, <|end|>, newline. Only tokens wholly within an answer of a role of learnt, or its
    end mark, have loss_mask 1. A null role is a user's, a null text is empty, an unknown role is
    rendered like the others; repeated turns all stay. Marks inside a text are ordinary text to the tokenizer. Rows
    with a null conv_id make one conversation. Nothing is cut off. Other columns are not read; no turns: no rows.
    The vocabulary is read on the driver and sent to the executors.
    """
    held = conversations.sparkSession.sparkContext.broadcast(vocabulary(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, width = _encoder(held.value, pattern)
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                part = batch.slice(lo, hi - lo)
                codes = [np.array(encoder.encode_ordinary(x), np.int32) for x in part.column(1).to_pylist()]
                ids, cuts = np.concatenate(codes), np.concatenate([[0], np.cumsum([len(x) for x in codes])]).astype(np.int32)
                # the conversations lie end to end, in tokens as in turns
                end = np.cumsum(width[ids])
                head, body, learn = (part.column(i).flatten().to_numpy(zero_copy_only=False) for i in (2, 3, 4))
                after = np.cumsum(head.astype(np.int64) + body + 1)
                within = mask(end - width[ids], end, (after - body - 1)[learn], (after - 1)[learn])
                sums = np.concatenate([[0], np.cumsum(within, dtype=np.int64)])
                offsets = pa.array(cuts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(cuts)), pa.array((sums[cuts[1:]] - sums[cuts[:-1]]).astype(np.int32)), pa.ListArray.from_arrays(offsets, pa.array(ids)), pa.ListArray.from_arrays(offsets, pa.array(within))],
                    names=["conv_id", "n_tokens", "n_learnt", "input_ids", "loss_mask"],
                )

    turns = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")).alias("turn"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("turn")).alias("turns"))
    role = lambda x: F.coalesce(x["role"], F.lit("user"))
    head = lambda x: F.concat(F.lit("<|"), role(x), F.lit("|>\n"))
    body = lambda x: F.concat(F.coalesce(x["text"], F.lit("")), F.lit("<|end|>"))
    rendered = whole.select(
        "conv_id",
        F.array_join(F.transform("turns", lambda x: F.concat(head(x), body(x), F.lit("\n"))), "").alias("text"),
        F.transform("turns", lambda x: F.octet_length(head(x))).alias("heads"),
        F.transform("turns", lambda x: F.octet_length(body(x))).alias("bodies"),
        F.transform("turns", lambda x: role(x).isin(*learnt) if learnt else F.lit(False)).alias("learnt"),
    )
    return rendered.mapInArrow(run, "conv_id long, n_tokens int, n_learnt int, input_ids array<int>, loss_mask array<byte>")
