"""The pipeline: its stages keep their columns, take effect, and agree with their operators one by one."""

from __future__ import annotations

from corpora import corpus, frame

import corpus_pipeline
from tidewell.llm import cotrain, decontaminate, jaccard, sharding

FOLDER = "/root/testdata/sf0.001"


def test_stages_are_named_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "mixing sources to target weights", "sharding"]


def test_run_is_the_stages_one_by_one(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels, bench = (spark.read.parquet(f"{FOLDER}/{t}.parquet") for t in ("labels", "benchmark"))
    good = {r.doc_id for r in cotrain.score_quality(docs, labels).collect() if r.keep}
    kept = docs.where(docs.doc_id.isin(sorted(good)))
    dropped = {r.doc_id for r in jaccard.near_duplicate_groups(kept).where("doc_id <> group_id").collect()}
    alone = kept.where(~kept.doc_id.isin(sorted(dropped) or [-1]))
    leaked = {r.doc_id for r in decontaminate.contaminated_spans(alone, bench).collect()}
    expected = good - dropped - leaked
    out = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in out} == expected
    assert len(out) >= len(expected)
    by = {}
    for r in out:
        by[r.shard] = by.get(r.shard, 0) + len(r.text.encode())
    assert all(b <= sharding.TARGET_BYTES for b in by.values())


def test_stages_keep_the_columns(spark):
    docs = frame(spark, corpus(1), True)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.columns == (docs.columns + ["shard"] if name == "sharding" else docs.columns), name
        assert out.count() > 0
        assert stage(spark, docs.limit(0), FOLDER).count() == 0


def test_stages_keep_columns_with_odd_names(spark):
    docs = frame(spark, corpus(1)).selectExpr("*", "1 AS `a.b`", "2 AS `with space`", "3 AS _metadata", "4 AS _file")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, FOLDER)
        assert out.columns[: len(docs.columns)] == docs.columns and out.select("`a.b`", "_metadata", "_file").distinct().collect() == [(1, 3, 4)], name


def test_stages_with_a_very_long_text(spark):
    """A text of 200,000 words goes through all stages whole, beside nulls, blanks and repeated rows."""
    words = " ".join(f"w{i * 7919 % 99991}x{i}" for i in range(200_000))
    rows = [(5000, words, "en", "s0", 9), *corpus(2)]
    docs = frame(spark, rows, True)
    for name, stage in corpus_pipeline.STAGES:
        if name == "quality classifier":
            continue  # sf0.001's labels say nothing about these texts
        docs = stage(spark, docs, FOLDER)
    found = docs.where("doc_id = 5000").collect()
    assert found and all(r.text == words for r in found)
    kept = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {None, 900, 901, 902, 903} <= kept
