"""Operators that SQL can express, on tables with everything odd, against their SQL."""

from __future__ import annotations

import pyarrow as pa
import pytest
from corpora import arrow, corpus, frame
from oracle import assert_same

from tidewell.llm import decontaminate, jaccard, linededup, mixing
from tidewell.llm.queries import JACCARD_PAIRS, ORACLES, QUERIES

BENCH = "item_id bigint, text string"


def bench_rows(rows):
    t = max((r[1] for r in rows[:40]), key=len).split(" ")
    return [(1, " ".join(t[3:40])), (2, " ".join(t[50:62])), (3, None), (None, "a b c d e f g h i j k l m"), (4, ""), (5, "wholly other words that no document of this table has in any place at all"), (1, " ".join(t[3:40])), (6, " ".join(t[10:18]))]


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_decontamination(spark, seed, clash):
    rows = corpus(seed)
    bench = bench_rows(rows)
    table = pa.table({"item_id": pa.array([b[0] for b in bench], pa.int64()), "text": pa.array([b[1] for b in bench], pa.string())})
    found = decontaminate.contaminated_spans(frame(spark, rows, clash), spark.createDataFrame(bench, BENCH))
    long = found.where("item_id <> 6")  # shorter than the guaranteed span: the SQL leaves it out
    assert_same(long, ORACLES["op1_benchmark_decontamination"], documents=arrow(rows), benchmark=table)
    assert found.count() > 0


def test_short_items_are_found_whole(spark):
    """Items of 5 to 9 words in documents at any place: always; of fewer words: never; brute force, both ways of use."""
    import random

    from corpora import text

    r = random.Random(7)
    plain = lambda n: [w.strip(".,").lower() for w in text(r, n).split()]
    items = {i: plain(1 + i % 12) for i in range(60)}
    rows = []
    for i in range(200):
        w = plain(r.randint(0, 50))
        if i % 2:
            at = r.randint(0, len(w))
            w[at:at] = items[r.randrange(60)]
        rows.append((i, " ".join(w), "en", "s", 1))
    docs, bench = frame(spark, rows), spark.createDataFrame([(i, " ".join(w)) for i, w in items.items()], BENCH)
    holds = lambda t, w: any(t[k : k + len(w)] == w for k in range(len(t) - len(w) + 1))
    want = {(d, i) for d, t, *_ in rows for i, w in items.items() if len(w) < 10 and len(w) >= 5 and holds(t.split(), w)}
    found = decontaminate.contaminated_spans(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in found if len(items[x.item_id]) < 10} == want and want
    assert all(x.span_words == len(items[x.item_id]) for x in found if len(items[x.item_id]) < 10)
    bad = {x.doc_id for x in found}
    assert {x.doc_id for x in decontaminate.drop_contaminated(docs, bench).collect()} == {d for d, *_ in rows} - bad


def test_decontamination_in_slices(spark, monkeypatch):
    rows = corpus(1)
    bench = spark.createDataFrame(bench_rows(rows), BENCH)
    docs = frame(spark, rows)
    whole = sorted(map(tuple, decontaminate.contaminated_spans(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "SLICE_WORDS", 20)
    assert sorted(map(tuple, decontaminate.contaminated_spans(docs, bench).collect())) == whole


def test_decontamination_drops(spark):
    rows = corpus(1)
    docs, bench = frame(spark, rows, True), spark.createDataFrame(bench_rows(rows), BENCH)
    bad = {r.doc_id for r in decontaminate.contaminated_spans(docs, bench).collect()}
    kept = decontaminate.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in bad)
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert decontaminate.contaminated_spans(docs.limit(0), bench).count() == 0
    with pytest.raises(ValueError):
        decontaminate.contaminated_spans(docs, bench, min_span=5)


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_jaccard_pairs(spark, seed, clash):
    rows = corpus(seed)
    pairs = jaccard.jaccard_pairs(frame(spark, rows, clash)).selectExpr("doc_id_a", "doc_id_b", "round(jaccard, 9) AS jaccard")
    assert_same(pairs, JACCARD_PAIRS, documents=arrow(rows))


def test_expanded_pairs_by_brute_force(spark):
    """All pairs of all copies, not only those of the least doc_id."""
    import re

    rows = {r[0]: r for r in corpus(1) if r[0] is not None and r[1] is not None}
    for i in (3, 4):  # more copies of texts that have near copies
        rows |= {2000 + 10 * i + k: (2000 + 10 * i + k, *rows[i][1:]) for k in range(2)}
    sets = {}
    for i, t, *_ in rows.values():
        w = re.findall(r"[^\x00-/:-`{-\x7f]+", t.lower())
        if w:
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    want = {}
    for a in sets:
        for b in sets:
            if a < b and (j := len(sets[a] & sets[b]) / len(sets[a] | sets[b])) >= 0.4:
                want[a, b] = round(j, 9)
    pairs = jaccard.jaccard_pairs(frame(spark, list(rows.values())))
    got = jaccard.expand_pairs(pairs).collect()
    assert {(r.doc_id_a, r.doc_id_b): round(r.jaccard, 9) for r in got} == want and len(got) == len(want)
    assert len(want) > pairs.count()


@pytest.mark.parametrize("seed", [1, 2])
def test_links_by_brute_force(spark, seed):
    """Every document has all its links counted, those of copies and with copies too, and a row of its own."""
    import re

    rows = corpus(seed)
    for i in (3, 4):  # more copies of texts that have near copies, as other texts of the same words
        rows += [(2000 + 10 * i + k, rows[i][1].upper() + "!" * k, *rows[i][2:]) for k in range(2)]
    sets = {}
    for i, t, *_ in rows:
        if i is not None:
            w = re.findall(r"[^\x00-/:-`{-\x7f]+", (t or "").lower())
            sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    near = {a: {b for b in sets if a != b and sets[a] and len(sets[a] & sets[b]) >= 0.4 * len(sets[a] | sets[b]) - 1e-9} for a in sets}
    name = {}
    for a in sorted(sets):
        todo = [a]
        while todo:
            x = todo.pop()
            if x not in name:
                name[x] = a
                todo += near[x]
    docs = frame(spark, rows, True)
    got = [tuple(r) for r in jaccard.jaccard_links(docs).collect()]
    assert sorted(got) == [(a, name[a], len(near[a])) for a in sorted(sets)]
    assert max(n for *_, n in got) > 3 and jaccard.jaccard_links(docs.limit(0)).count() == 0


def test_links_of_a_document_with_several_texts(spark):
    rows = corpus(1)
    rows += [(3, rows[5][1], "en", "s", 1), (3, rows[6][1] + " and more", "en", "s", 1), (5, rows[6][1], "en", "s", 1)]
    assert_same(jaccard.jaccard_links(frame(spark, rows)), ORACLES["op9_ngram_jaccard_join"], documents=arrow(rows))


def loose(n: int) -> list[tuple]:
    """Short texts of two common lines and words of their own: one component by their grams, with few pairs."""
    import random

    from corpora import text

    r = random.Random(3)
    lines = [text(r, 12).replace("\n", " ") for _ in range(60)]
    return [(i, "\n".join([*r.sample(lines, 2), text(r, r.randint(1, 12))]), "en", "s", 1) for i in range(n)]


def test_loose_components_move_few_rows(spark, monkeypatch):
    """Short sets go to few blocks, as blocks end by their grams, and no row goes to a task for each 512 others."""
    docs = frame(spark, loose(3_000))
    tasks, moved = jaccard._tasks, []

    def counted(*args):
        found = tasks(*args)
        moved.append(found.count())
        return found

    monkeypatch.setattr(jaccard, "_tasks", counted)
    jaccard.jaccard_links(docs)
    assert 2_000 < moved[0] <= 3_000


@pytest.mark.parametrize("block,addition", [(16_384, 640), (100, 640), (100, 1e-9), (100, 1e9), (16_384, 1e9)])
def test_blocks_and_products_change_nothing(spark, monkeypatch, block, addition):
    """Added pair by pair, multiplied or mixed, in one block or in many: the same links."""
    rows = loose(400) + [(1000 + i, t, *rest) for i, (_, t, *rest) in enumerate(corpus(2))]
    w = rows[-1][1].split()
    rows += [(5000 + i, " ".join([*w[:60], f"x{i % 40}", *w[60 + i % 30 : 90]]), "en", "s", 1) for i in range(200)]
    for k, v in {"ROW_BLOCK": block, "ADDITION": addition, "TILE": 30, "ADDITIONS": 500, "CELLS": 300}.items():
        monkeypatch.setattr(jaccard, k, v)
    assert_same(jaccard.jaccard_links(frame(spark, rows)), ORACLES["op9_ngram_jaccard_join"], documents=arrow(rows))


def test_jaccard_large_components(spark, monkeypatch):
    """Row blocks and the dense product give the pairs that the plain way gives."""
    import random

    from corpora import text

    r = random.Random(5)
    base = text(r, 60).split(" ")
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(3):
            w[r.randrange(60)] = f"new{r.randint(0, 5)}"
        rows.append((i, " ".join(w), "en", "s", 1))
    monkeypatch.setattr(jaccard, "ROW_BLOCK", 25)
    pairs = jaccard.jaccard_pairs(frame(spark, rows)).selectExpr("doc_id_a", "doc_id_b", "round(jaccard, 9) AS jaccard")
    assert_same(pairs, JACCARD_PAIRS, documents=arrow(rows))


def test_near_duplicates_leave_one(spark):
    rows = corpus(1)
    docs = frame(spark, rows, True)
    groups = {}
    for a, b, *_ in jaccard.jaccard_pairs(docs).collect():
        groups.setdefault(a, a), groups.setdefault(b, b)

    def top(x):
        while groups[x] != x:
            x = groups[x]
        return x

    for a, b, *_ in jaccard.jaccard_pairs(docs).collect():
        a, b = sorted((top(a), top(b)))
        groups[b] = a
    gone = {x for x in groups if top(x) != x}
    kept = jaccard.keep_one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r[0]) for r in rows if r[0] not in gone)
    assert gone and jaccard.keep_one_of_each_group(docs.limit(0)).count() == 0


def _line_rows(seed):
    """Nulls, repeated rows, two texts of one doc_id, texts that begin, end or consist of breaks."""
    rows = corpus(seed) + [(5, corpus(seed)[6][1], "en", "s", 1)]
    long = "this line stands in a number of the documents"
    odd = ["\n", "\n\n", f"{long}", f"{long}\n", f"\n{long}", f"{long}\n{long}", f"short\n{long}\n{long}", f"{long}\nshort\n", f" {long}\t\n\n{long}\nshort", f"a\r\n{long}\r\nb\r\n"]
    return rows + [(3000 + i, t, "en", "s", 1) for i, t in enumerate(odd)] + [(None, f"{long}\nx", None, None, None)] * 2


@pytest.mark.parametrize("clash", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_line_dedup(spark, seed, clash):
    rows = [r for r in _line_rows(seed) if r[1] is not None]  # the SQL has no row for a null text
    assert_same(linededup.dedup_lines(frame(spark, rows, clash)), ORACLES["op8_line_dedup"], documents=arrow(rows))


@pytest.mark.parametrize("least", [1, 24])
def test_line_dedup_by_brute_force(spark, monkeypatch, least):
    """With tasks of a few lines, so that a shard has several tasks, and lots of a few."""
    monkeypatch.setattr(linededup, "PROBES", 7)
    monkeypatch.setattr(linededup, "FLUSH_LINES", 30)
    rows = _line_rows(1)
    key = lambda line: line.strip(" \t\r\x0b\x0c")
    first = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n") if i is not None else []:
            first[key(line)] = min(i, first.get(key(line), i))
    want = []
    for i, t, *_ in rows:
        kept, seen = [], set()
        for line in t.split("\n") if t is not None else []:
            k = key(line)
            if len(k.encode()) >= least and (k in seen or k in first and first[k] != i):
                continue
            seen.add(k)
            kept.append(line)
        n = 0 if t is None else t.count("\n") + 1
        want.append((i, n, n - len(kept), None if t is None else "\n".join(kept)))
    got = linededup.dedup_lines(frame(spark, rows, True), least).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))


def test_line_shards_are_read_once_per_lot_of_probes():
    """The tasks, of which each reads one shard, are as many as the shards and the lots of lines looked up there."""
    import numpy as np

    sizes = np.array([0, 1, linededup.PROBES, linededup.PROBES + 1, 10 * linededup.PROBES])
    assert np.diff(linededup.probing_tasks(sizes)).tolist() == [1, 1, 1, 2, 10]


def test_line_dedup_of_nothing(spark):
    assert linededup.dedup_lines(frame(spark, [])).count() == 0
    out = linededup.dedup_lines(frame(spark, [(1, None, None, None, None), (2, "", None, None, None)])).orderBy("doc_id").collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in out] == [(0, 0, None), (1, 0, "")]


def test_perfect_hash_is_minimal_and_rejects():
    import numpy as np

    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 63, 20_000).astype(np.uint64))
    p = linededup.PerfectHash.of(keys)
    assert sorted(p.place(keys)) == list(range(len(keys)))
    assert (linededup.PerfectHash.of(keys[:0]).place(keys) == -1).all()


@pytest.mark.parametrize("clash", [False, True])
def test_mixing(spark, clash):
    rows = corpus(1)
    sql = ORACLES["op4_source_mixing"].replace("8192", "64")
    docs = frame(spark, rows, clash)
    assert_same(mixing.mixed_blocks(docs, 64), sql, documents=arrow(rows))


def test_mixing_keeps_to_weights(spark):
    rows = corpus(1)
    docs = frame(spark, rows, True)
    slots = mixing.mixed_blocks(docs, 64).select("slot", "source").distinct().collect()
    weights = {r.source: r.weight for r in mixing.target_weights(mixing.placed(docs)).collect()}
    total = sum(weights.values())
    n = max(r.slot for r in slots) + 1
    for s, w in weights.items():
        assert abs(sum(r.source == s for r in slots) - n * w / total) < 4
    # a given share of one source only
    only = mixing.mixed_blocks(docs, 64, weights={"s1": 1.0})
    assert {r.source for r in only.select("source").distinct().collect()} == {"s1"}
    assert mixing.mixed_blocks(docs.limit(0), 64).count() == 0


def test_mixing_gives_every_source_all_its_blocks(spark):
    """The slots of four equal sources of 200 blocks stray from the weights by more than the slack of one block each."""
    rows = [(i, f"w{i}", "en", f"s{i % 4}", 1) for i in range(800)]
    docs = frame(spark, rows)
    out = mixing.mixed_blocks(docs, 1).where("epoch = 0").collect()
    assert sorted(r.doc_id for r in out) == list(range(800))
    assert {r.doc_id for r in mixing.mix_documents(docs, 1).collect()} == set(range(800))


def test_mixed_documents_are_all_there(spark):
    rows = corpus(1)
    docs = frame(spark, rows, True)
    out = mixing.mix_documents(docs, 64)
    assert out.columns == docs.columns
    got = {(r.doc_id, r.text) for r in out.collect()}
    assert got == {(r[0], r[1]) for r in rows}
    assert out.count() >= len(rows)
    assert mixing.mix_documents(docs.limit(0), 64).count() == 0


def test_mixed_documents_as_often_as_their_blocks(spark):
    """Brute force: each row as often as the schedule has the block of its first token; repeated rows count by themselves."""
    from collections import Counter

    rows = corpus(1)
    docs = frame(spark, rows, True)
    pieces = mixing.mixed_blocks(docs, 64).where("token_from = 0").collect()
    want = Counter(r.doc_id for r in pieces) + Counter(r[0] for r in rows if not (r[1] or "").split())
    assert Counter(r.doc_id for r in mixing.mix_documents(docs, 64).collect()) == want
    # weights of some sources: others go, texts without a token stay
    some = {r[0] for r in rows if r[3] == "s1" or not (r[1] or "").split()}
    assert {r.doc_id for r in mixing.mix_documents(docs, 64, weights={"s1": 2.0}).collect()} == some
    with pytest.raises(ValueError):
        mixing.mixed_blocks(docs, 64, weights={"s1": 1.0, "s2": 1e-12})


@pytest.mark.parametrize("name", sorted(set(ORACLES)))
def test_production_queries(spark, name):
    folder = "/root/testdata/sf0.001"
    assert_same(QUERIES[name](spark, folder), ORACLES[name], folder)


@pytest.mark.parametrize("name", ["op8_line_dedup", "op9_ngram_jaccard_join"])
def test_blocks_by_the_bytes_of_the_table(spark, monkeypatch, name):
    """Where the files are large against the session's partitions, more blocks give the same rows."""
    from tidewell.llm import workspace

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert workspace.blocks(docs) == 4
    monkeypatch.setattr(workspace, "BLOCK_BYTES", 15_000)
    assert workspace.blocks(docs) > 8 and workspace.blocks(docs.where("true")) == 4
    assert_same(QUERIES[name](spark, folder), ORACLES[name], folder)


def test_very_long_texts(spark):
    """One text of 300,000 words, its copy, and its half: whole texts take part."""
    words = [f"w{i * 7919 % 99991}x{i}" for i in range(300_000)]
    rows = [(1, " ".join(words), "en", "s", 1), (2, " ".join(words), "en", "s", 1), (3, " ".join(words[150_000:]), "en", "s", 1), (4, "short one", "en", "s", 1)]
    docs = frame(spark, rows)
    assert sorted((r.doc_id_a, r.doc_id_b) for r in jaccard.jaccard_pairs(docs).collect()) == [(1, 2), (1, 3)]
    bench = spark.createDataFrame([(7, " ".join(words[299_970:]))], BENCH)
    assert {(r.doc_id, r.span_words) for r in decontaminate.contaminated_spans(docs, bench).collect()} == {(1, 30), (2, 30), (3, 30)}
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == {1: rows[0][1], 2: "", 3: rows[2][1], 4: "short one"}


@pytest.mark.parametrize("seed", [1, 4])
def test_heavy_grams_change_nothing(spark, monkeypatch, seed):
    """Grams of many documents travel with their sets; the pairs stay as they are."""
    rows = [(i, f"{t} and all of them end with the same words here", *rest) if t else (i, t, *rest) for i, t, *rest in corpus(seed)]
    monkeypatch.setattr(jaccard, "HEAVY", 20)
    docs = frame(spark, rows)
    assert len(jaccard.heavy_grams(docs.select("doc_id", "text").where("doc_id IS NOT NULL AND text IS NOT NULL"), 5, len(rows), 3)) >= 5
    pairs = jaccard.jaccard_pairs(docs).selectExpr("doc_id_a", "doc_id_b", "round(jaccard, 9) AS jaccard")
    assert_same(pairs, JACCARD_PAIRS, documents=arrow(rows))
