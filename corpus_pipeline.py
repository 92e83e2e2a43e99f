"""The corpus pipeline: raw documents in, sharded training documents out.

Quality classifier, near-duplicate removal, benchmark decontamination, mixing to target weights, sharding.
``run`` applies STAGES to the documents of a folder; every stage is written to the shared folder as
Parquet and read again as the next one's documents, so that a lost executor costs a task and not a stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidewell.llm.cotrain import keep_good
from tidewell.llm.decontaminate import drop_contaminated
from tidewell.llm.jaccard import keep_one_of_each_group
from tidewell.llm.mixing import mix_documents
from tidewell.llm.sharding import assign_shards
from tidewell.llm.workspace import materialise
from tidewell.session import prepare


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier keeps (probability of being good 0.5 or more), with their columns.

    Every document is scored; a null text, lang, source or n_chars is scored as empty, unknown or 0. Without labels of
    either quality all stay.
    """
    return keep_good(docs, prepare(spark).read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that pairs of word 5-gram Jaccard 0.4 or more connect: the one of the least doc_id.

    Rows with a null doc_id or text, and texts without a word, are in no group and stay.
    """
    prepare(spark)
    return keep_one_of_each_group(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no span of 10 words or more with a benchmark item, and hold no item of 5 to 9 words whole. Items of fewer words count for nothing. Null texts stay."""
    return drop_contaminated(docs, prepare(spark).read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the low-discrepancy schedule has their block: each at least once, those of small sources more often.

    Null sources are a source of their own. Texts without a token stay once.
    """
    prepare(spark)
    return mix_documents(docs)


def sharding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their shard; shards hold at most 16 MiB of text unless their rows cannot be told apart. A column of that name stays, and the new one is then called shard_."""
    prepare(spark)
    return assign_shards(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing sources to target weights", mixing_stage),
    ("sharding", sharding_stage),
]

#: Neither the classifier nor the k-d tree can be expressed in SQL; tests hold the stages against brute-force versions.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents of sf_dir."""
    docs = prepare(spark).read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, name.replace(" ", "-"))
    return docs
