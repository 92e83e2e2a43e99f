"""Small document tables with everything that may be odd about them."""

from __future__ import annotations

import random

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega été naïve größe señor".split()
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASH = ["block", "sets", "grams", "task", "bucket", "slot", "place", "start", "_dropped", "_copies", "_i", "_source", "_place", "component", "node", "size", "lang_lo", "digest", "keep", "score"]


def text(r: random.Random, n: int) -> str:
    out = []
    for i in range(n):
        out.append(r.choice(WORDS) + str(r.randint(0, 40)))
        if r.random() < 0.08:
            out[-1] += r.choice([".", ",", "\n"])
    return " ".join(out)


def corpus(seed: int = 1, n: int = 40) -> list[tuple]:
    """Fresh texts, copies, near copies, repeated rows, shared lines, nulls, blanks and one very long text."""
    r = random.Random(seed)
    rows = [(i, text(r, r.randint(1, 120)), r.choice(["en", "de", None]), f"s{i % 4}" if i % 9 else None, 10) for i in range(n)]
    for i in range(n // 4):
        t = rows[i][1]
        w = t.split(" ")
        near = list(w)
        for j in range(0, len(near), 13):
            near[j] = "changed"
        rows.append((n + 3 * i, t, "en", "s0", 5))
        rows.append((n + 3 * i + 1, " ".join(near), "en", "s1", 5))
        rows.append((n + 3 * i + 2, text(r, 30) + "\n" + "this line stands in a number of the documents\n" + text(r, 20), "en", "s2", None))
    rows += [rows[3], rows[3], (None, rows[4][1], None, None, None), (None, None, None, None, None), (900, "", "en", "s0", 0), (901, None, "en", "s0", 0), (902, " \n\t ", "en", "s0", 4), (903, "...!!!", "en", "s0", 6), (904, "one", "en", "s0", 3), (905, "one", "en", "s0", 3)]
    rows.append((999, text(r, 3_000), "en", "s3", 1))
    return rows


def frame(spark, rows: list[tuple], clash: bool = False):
    df = spark.createDataFrame(rows, SCHEMA)
    if clash:
        from pyspark.sql import functions as F

        df = df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])
    return df


def arrow(rows: list[tuple]):
    import pyarrow as pa

    names = [c.split()[0] for c in SCHEMA.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table({n: pa.array([r[i] for r in rows], t) for i, (n, t) in enumerate(zip(names, types))})
