"""Personal data and secrets by a linear-chain conditional random field over word shapes.

A token (a run without white space) is described by its shape: which classes of characters it has, how
many digits, letters and dots, how it begins, whether it is a word such as ``token``, and the same
of its neighbours. The field is fitted by gradient ascent on the exact likelihood (forward-backward)
over a small labelled table. Decoding is Viterbi over all tokens in numpy batches. Where a token's
evidence for "nothing" outweighs all that any neighbouring transitions could add (a bound that is
computed, not assumed) its tag is known beforehand and cuts the chain; the chains between are
decoded together. The result is that of Viterbi over whole texts.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import textbatch as tb

KINDS = ("EMAIL", "PHONE", "IP", "CARD", "SECRET", "ID")
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
#: Sentences of the labelled table, and steps of the fit.
SENTENCES, STEPS, RIDGE = 700, 90, 0.02
HASHED = 512

_CLASSES = ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", "@", ".", "-", "+", "()", "\"'`", "=", ":", "/\\", "_", ",;!?", "#$%&*|<>[]{}^~")
_CLASS = np.zeros(256, np.uint32)
for _bit, _chars in enumerate(_CLASSES):
    _CLASS[[ord(c) for c in _chars]] = 1 << _bit
_CLASS[128:] = 1 << len(_CLASSES)
_DIGIT, _DOT = _CLASS == 4, _CLASS == 16
_LETTER = np.isin(_CLASS, (1, 2, 1 << len(_CLASSES)))
_HEX = np.isin(np.arange(256), [ord(c) for c in "0123456789abcdefABCDEF"])
_TRIGGERS = "token secret password passwd key apikey api_key phone tel call mail email card ip ssn id iban"
_DIGITS = np.searchsorted([1, 2, 3, 4, 5, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20], np.arange(64), "right")
_LETTERS = np.searchsorted([1, 2, 4, 9, 20], np.arange(64), "right")


@cache
def _trigger_hashes() -> tuple[np.ndarray, np.ndarray]:
    names = _TRIGGERS.split()
    data, offsets = tb.utf8(pa.array(names))
    h = tb.span_hash(tb.prefix_hash(data), offsets[:-1], offsets[1:])
    order = np.argsort(h)
    return h[order], (np.arange(len(names)) + 1)[order]


def tokens(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends, rows and shape codes of the tokens of a slice."""
    data, offsets = tb.utf8(text)
    starts, ends, row = tb.spans(~tb.SPACE[data], offsets)
    if not len(starts):
        return data, starts, ends, row, np.zeros(0, np.uint64)
    bits = np.bitwise_or.reduceat(_CLASS[data], starts).astype(np.uint64)

    def count(which: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(which[data], dtype=np.int32)])
        return np.minimum(sums[ends] - sums[starts], 63)

    digits, letters, dots, hexes = count(_DIGIT), count(_LETTER), np.minimum(count(_DOT), 4), count(_HEX)
    # a long run of hexadecimal characters between at most a few others
    long_hex = (hexes >= 16) & (digits >= 4) & (letters - (hexes - digits) <= 0)
    code = bits | _DIGITS[digits].astype(np.uint64) << np.uint64(16) | _LETTERS[letters].astype(np.uint64) << np.uint64(20) | dots.astype(np.uint64) << np.uint64(23)
    first = np.array([int(c).bit_length() for c in _CLASS])[data[starts]].astype(np.uint64)
    code |= first << np.uint64(26) | long_hex.astype(np.uint64) << np.uint64(31)
    short = np.flatnonzero((letters >= 2) & (digits == 0) & (ends - starts <= 10))
    if len(short):
        # the word without what stands around it, in lower case
        lower = data | (np.uint8(32) * ((data >= 65) & (data <= 90)))
        s, e = starts[short].copy(), ends[short].copy()
        for _ in range(3):
            s += ~_LETTER[data[np.minimum(s, e - 1)]] & (s < e - 1)
            e -= ~_LETTER[data[e - 1]] & (e > s + 1)
        known, number = _trigger_hashes()
        h = tb.span_hash(tb.prefix_hash(lower), s, e)
        at = np.minimum(np.searchsorted(known, h), len(known) - 1)
        hit = known[at] == h
        code[short[hit]] |= number[at[hit]].astype(np.uint64) << np.uint64(32)
    return data, starts, ends, row, code


def shape_features(code: np.ndarray) -> np.ndarray:
    """Feature numbers (a fixed count a shape, in a space of SPACE_) of distinct shape codes."""
    bits = code & np.uint64(0xFFFF)
    digits, letters, dots, first, long_hex, trigger = ((code >> np.uint64(s) & np.uint64(m)).astype(np.int64) for s, m in ((16, 15), (20, 7), (23, 7), (26, 31), (31, 1), (32, 31)))
    hashed = lambda *x: (tb.mix(sum((np.asarray(v).astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15 * (2 * i + 3) & 0xFFFFFFFFFFFFFFFF) for i, v in enumerate(x))) % np.uint64(HASHED)).astype(np.int64)
    # marks that junk adds to a word (and its case) say nothing about what it is
    core = bits & np.uint64(0xFFFF & ~(1 << 13 | 1 << 14))
    core = np.where(core & np.uint64(2) != 0, core & ~np.uint64(2) | np.uint64(1), core)
    columns = [digits, 16 + letters, 24 + dots, 32 + first, 64 + long_hex, 68 + trigger, 100 + hashed(core), 100 + HASHED + hashed(core, digits), 100 + 2 * HASHED + hashed(core, digits, dots, first)]
    columns += [100 + 3 * HASHED + 2 * i + (bits >> np.uint64(i) & np.uint64(1)).astype(np.int64) for i in (2, 3, 5, 6, 7, 8, 9, 10, 11)]
    return np.stack(columns, 1)


SPACE_ = 100 + 3 * HASHED + 32


class Field:
    """Emission weights of a token's own shape and of its neighbours' shapes, and transitions between tags."""

    def __init__(self, own: np.ndarray, before: np.ndarray, after: np.ndarray, edge: np.ndarray) -> None:
        self.own, self.before, self.after, self.edge = own, before, after, edge
        # the most that tags other than O can win on both sides over O
        into = edge[:, 1:] - edge[:, :1]
        out = edge[1:, :] - edge[:1, :]
        self.bound = float(max(np.max(into[:, y]) + np.max(out[y]) for y in range(len(TAGS) - 1)))
        self.bound = max(self.bound, float(np.max(into)), float(np.max(out)), 0.0)

    def viterbi(self, emission: np.ndarray, lengths: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Best tags of chains laid end to end; left and right: whether an O stands on that side."""
        first = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        n = lengths[order]
        back = np.zeros((len(emission), len(TAGS)), np.int8)
        state = emission[first[order]] + np.where(left[order][:, None], self.edge[0][None], 0.0)
        longest = int(n[0]) if len(n) else 0
        for t in range(1, longest):
            live = int(np.searchsorted(-n, -t, "left"))
            score = state[:live, :, None] + self.edge[None]
            best = score.argmax(1)
            at = first[order[:live]] + t
            back[at] = best
            state[:live] = np.take_along_axis(score, best[:, None, :], 1)[:, 0] + emission[at]
        state = state + np.where(right[order][:, None], self.edge[:, 0][None], 0.0)
        tags = np.zeros(len(emission), np.int8)
        now = state.argmax(1)
        for t in range(longest - 1, -1, -1):
            live = int(np.searchsorted(-n, -t, "left"))
            at = first[order[:live]] + t
            tags[at] = now[:live]
            if t:
                now[:live] = back[at, now[:live]]
        return tags

    def parts(self, code: np.ndarray) -> tuple[np.ndarray, ...]:
        """Own, before and after scores of distinct shapes."""
        f = shape_features(code)
        return tuple(w[f].sum(1) for w in (self.own, self.before, self.after))

    def decode(self, row: np.ndarray, code: np.ndarray, exhaustive: bool = False) -> np.ndarray:
        """Tags of all tokens. exhaustive: without cutting at tokens whose tag is certain."""
        if not len(code):
            return np.zeros(0, np.int8)
        shapes, shape = np.unique(code, return_inverse=True)
        own, before, after = self.parts(shapes)
        new = np.append(True, row[1:] != row[:-1])
        last = np.append(new[1:], True)
        rest = lambda w: (w[:, :1] - w[:, 1:]).min(1)
        # evidence for O of the token and of its neighbours, against the best other tag
        plain = rest(own)
        worst_before, worst_after = min(rest(before).min(), 0.0), min(rest(after).min(), 0.0)
        certain = (plain + worst_before + worst_after > self.bound)[shape]
        doubtful = np.flatnonzero(~certain)
        # the exact neighbours, for those that the worst neighbours leave open
        previous, following = np.maximum(doubtful - 1, 0), np.minimum(doubtful + 1, len(code) - 1)
        emission = own[shape[doubtful]] + np.where(new[doubtful][:, None], 0.0, before[shape[previous]]) + np.where(last[doubtful][:, None], 0.0, after[shape[following]])
        sure = np.zeros(len(code), bool) if exhaustive else certain
        if exhaustive:
            doubtful = np.arange(len(code))
            emission = own[shape] + np.where(new[:, None], 0.0, before[np.roll(shape, 1)]) + np.where(last[:, None], 0.0, after[np.roll(shape, -1)])
        else:
            settled = (emission[:, :1] - emission[:, 1:]).min(1) > self.bound
            sure[doubtful[settled]] = True
            doubtful, emission = doubtful[~settled], emission[~settled]
        tags = np.zeros(len(code), np.int8)
        if not len(doubtful):
            return tags
        start = np.append(True, (np.diff(doubtful) > 1) | new[doubtful[1:]])
        begin = np.flatnonzero(start)
        lengths = np.diff(np.append(begin, len(doubtful)))
        end = doubtful[begin + lengths - 1]
        tags[doubtful] = self.viterbi(emission, lengths, ~new[doubtful[begin]], ~last[end])
        return tags


_SYLLABLES = "an er in on th re ti es or de la que ung sch ent ou ai mente cion da po ri ta lo ne é ü ñ ö ch".split()


def labelled_table(sentences: int = SENTENCES, seed: int = 7) -> list[list[tuple[str, str]]]:
    """The small labelled table: sentences of (token, tag), made up from patterns with a fixed seed."""
    r = random.Random(seed)
    digits = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))

    def word() -> str:
        w = "".join(r.choice(_SYLLABLES) for _ in range(r.randint(1, 5)))
        w = w.capitalize() if r.random() < 0.15 else w.upper() if r.random() < 0.06 else w
        return w + (r.choice([".", ",", ";", ":", "!", "?", ")", '"']) if r.random() < 0.2 else "")

    def name() -> str:
        return r.choice([word().strip('.,;:!?)"').lower(), letters(r.randint(2, 8))]).encode("ascii", "ignore").decode() or "ab"

    def tagged(kind: str, *parts: str) -> list[tuple[str, str]]:
        return [(p, f"{'I' if i else 'B'}-{kind}") for i, p in enumerate(parts)]

    def email() -> list:
        ending = r.choice(["com", "org", "net", "de", "co.uk", "fr", "example", "io"])
        host = r.choice([f"{letters(r.randint(2, 6))}{digits(1)}.{letters(r.randint(3, 9))}.{ending}", f"{letters(r.randint(3, 9))}.{ending}", f"{letters(r.randint(2, 6))}.{letters(r.randint(3, 9))}.{ending}", f"{letters(4)}-{letters(5)}.{ending}"])
        return tagged("EMAIL", r.choice([f"{name()}.{digits(2)}@{host}", f"{name()}@{host}", f"{name()}.{name()}@{host}", f"{name()}_{digits(3)}@{host}", f".{digits(2)}@{host}"]))

    def phone() -> list:
        a, b, c = digits(3), digits(3), digits(4)
        return tagged("PHONE", *r.choice([(f"+1", f"({a})", f"{b}-{c}"), (f"+{digits(2)}", f"({a})", f"{b}-{c}"), (f"({a})", f"{b}-{c}"), (f"{a}-{b}-{c}",), (f"+1-{a}-{b}-{c}",), (f"+{digits(2)}", digits(2), c, digits(4)), (f"+1{a}{b}{c}",), (f"{a}.{b}.{c}",)][: 8 if r.random() < 0.5 else 2]))

    def ip() -> list:
        return tagged("IP", ".".join(str(r.randint(0, 255)) for _ in range(4)))

    def card() -> list:
        n = digits(16)
        return tagged("CARD", *r.choice([(n,), (n,), (n,), (n[:4], n[4:8], n[8:12], n[12:]), ("-".join((n[:4], n[4:8], n[8:12], n[12:])),)]))

    def secret() -> list:
        code = r.choice(["".join(r.choice("0123456789abcdef") for _ in range(r.choice([32, 40, 40, 40, 64]))), "sk_live_" + letters(8) + digits(6) + letters(6), "AKIA" + (letters(6) + digits(4) + letters(6)).upper()])
        key = r.choice(["token", "secret", "password", "api_key", "key"])
        q = r.choice(['"', '"', '"', "'", ""])
        return r.choice([[(key, "O"), ("=", "O")] + tagged("SECRET", f"{q}{code}{q}"), [(key, "O"), ("=", "O")] + tagged("SECRET", f'"{code}"'), [(f"{key}:", "O")] + tagged("SECRET", code), tagged("SECRET", f"{key}={code}"), tagged("SECRET", f'"{code}"')])

    def number() -> list:
        return tagged("ID", r.choice([f"{digits(3)}-{digits(2)}-{digits(4)}", f"DE{digits(20)}", f"GB{digits(2)}ABCD{digits(14)}"]))

    def plain() -> list:
        y = f"{r.randint(1900, 2030)}"
        m = f"{r.randint(1, 12):02d}"
        return [(x, "O") for x in r.choice([(y,), (f"{y}-{m}-{m}",), (f"{m}:{digits(2)}",), (f"{digits(1)}.{digits(1)}.{digits(1)}",), (f"{digits(1)}.{digits(2)}",), (f"{digits(1)},{digits(3)}",), (f"{digits(r.randint(1, 3))},{digits(3)}.{digits(2)}",), (f"978-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}",), (digits(r.randint(1, 8)),), (f"{digits(2)}%",), (f"${digits(3)}",), ("version", f"{digits(1)}.0"), (f"v{digits(1)}.{digits(2)}.{digits(1)}",), (f"{name()}-{name()}",), (name(), "=", f'"{name()}"'), (f"({name()})",), (f"#{digits(3)}",), (f"{digits(4)}-{digits(4)}",), (f"({y})",), (f"{m}/{m}/{y}",), ("page", digits(3)), ("token", name()), (f'"{name()}', f'{name()}"'), (f"@{name()}",), ("CC", "BY-NC", "4.0."), ("|",), ("=",), (f"{name()}.{name()}",), ("+", digits(1)), (f"https://{name()}.org/{name()}",), (f"{digits(10)}",)])]

    marks = ["", "", "", "", "", "!!", "###", "***", "$$$", "%%%", "&&&"]
    rare = [email, phone, ip, card, secret, number]
    out = []
    for _ in range(sentences):
        made: list[tuple[str, str]] = []
        for _ in range(r.randint(3, 7)):
            made += [(word(), "O") for _ in range(r.randint(0, 4))]
            x = r.random()
            made += r.choice(rare)() if x < 0.38 else plain() if x < 0.7 else []
        mark = r.choice(marks)
        shout = mark == "!!" and r.random() < 0.7
        pipes = not mark and r.random() < 0.15
        done = []
        for token, tag in made or [("a", "O")]:
            end = mark or (r.choice([".", ",", ";"]) if r.random() < 0.08 else "")
            done.append(((token.upper() if shout else token) + end, tag))
            if pipes and not tag.startswith("I"):
                done.insert(len(done) - 1, ("|", "O"))
        out.append(done)
    return out


class Likelihood:
    """The log-likelihood of a labelled table and its gradient, by forward-backward over all sentences at once."""

    def __init__(self, table: list[list[tuple[str, str]]]) -> None:
        _, _, _, row, code = tokens(pa.array([" ".join(t for t, _ in s) for s in table]))
        gold = np.array([TAGS.index(t) for s in table for _, t in s])
        if len(code) != len(gold):
            raise ValueError("a labelled token is empty or holds white space")
        self.row, self.gold, self.n, self.k = row, gold, len(table), len(TAGS)
        self.pos = np.arange(len(row)) - np.searchsorted(row, row)
        shapes, self.shape = np.unique(code, return_inverse=True)
        feats = shape_features(shapes)
        self.hot = np.zeros((len(shapes), SPACE_))
        np.add.at(self.hot, (np.repeat(np.arange(len(shapes)), feats.shape[1]), feats.ravel()), 1)
        self.longest = int(self.pos.max()) + 1
        self.mask = np.zeros((self.n, self.longest), bool)
        self.mask[row, self.pos] = True
        self.new, self.last = self.pos == 0, np.append(row[1:] != row[:-1], True)
        self.prev, self.next = np.maximum(np.arange(len(row)) - 1, 0), np.minimum(np.arange(len(row)) + 1, len(row) - 1)
        self.pairs = np.zeros((self.k, self.k))
        inner = np.flatnonzero(~self.new)
        np.add.at(self.pairs, (gold[inner - 1], gold[inner]), 1)

    def start(self) -> list[np.ndarray]:
        """Weights of 0: of a token's own shape, of the shapes before and after it, and of pairs of tags."""
        return [np.zeros((SPACE_, self.k)) for _ in range(3)] + [np.zeros((self.k, self.k))]

    def __call__(self, w: list[np.ndarray]) -> tuple[float, list[np.ndarray]]:
        row, pos, gold, mask, n, k = self.row, self.pos, self.gold, self.mask, self.n, self.k
        lse = lambda a, axis: (m := a.max(axis, keepdims=True)).squeeze(axis) + np.log(np.exp(a - m).sum(axis))
        own, before, after = (self.hot @ x for x in w[:3])
        flat = own[self.shape] + np.where(self.new[:, None], 0, before[self.shape[self.prev]]) + np.where(self.last[:, None], 0, after[self.shape[self.next]])
        e = np.zeros((n, self.longest, k))
        e[row, pos] = flat
        edge = w[3]
        alpha, beta = np.zeros((n, self.longest, k)), np.zeros((n, self.longest, k))
        alpha[:, 0] = e[:, 0]
        for t in range(1, self.longest):
            alpha[:, t] = np.where(mask[:, t, None], lse(alpha[:, t - 1, :, None] + edge[None], 1) + e[:, t], alpha[:, t - 1])
        z = lse(alpha[:, -1], 1)
        expect = np.zeros((k, k))
        for t in range(self.longest - 2, -1, -1):
            inner = edge[None] + (e[:, t + 1] + beta[:, t + 1])[:, None, :]
            beta[:, t] = np.where(mask[:, t + 1, None], lse(inner, 2), 0.0)
            joint = np.exp(alpha[:, t, :, None] + inner - z[:, None, None])
            expect += joint[mask[:, t + 1]].sum(0)
        residual = -np.exp(alpha[row, pos] + beta[row, pos] - z[row, None])
        residual[np.arange(len(row)), gold] += 1
        grads = []
        for source, keep in ((self.shape, slice(None)), (self.shape[self.prev], ~self.new), (self.shape[self.next], ~self.last)):
            per = np.stack([np.bincount(source[keep], residual[keep][:, c], len(self.hot)) for c in range(k)], 1)
            grads.append(self.hot.T @ per)
        value = flat[np.arange(len(row)), gold].sum() + (self.pairs * edge).sum() - z.sum()
        return float(value), [*grads, self.pairs - expect]


def fit(table: list[list[tuple[str, str]]], steps: int = STEPS, ridge: float = RIDGE) -> Field:
    """Maximum likelihood (with a ridge) by Adam on the exact gradient over the whole table."""
    likelihood = Likelihood(table)
    w = likelihood.start()
    moment, square = [np.zeros_like(x) for x in w], [np.zeros_like(x) for x in w]
    for step in range(1, steps + 1):
        for i, g in enumerate(likelihood(w)[1]):
            g = g - ridge * w[i]
            moment[i] = 0.9 * moment[i] + 0.1 * g
            square[i] = 0.99 * square[i] + 0.01 * g * g
            w[i] = w[i] + 0.08 * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-8)
    return Field(*w)


@cache
def production_field() -> Field:
    return fit(labelled_table())


def spans(text: pa.Array, field: Field, exhaustive: bool = False) -> tuple[np.ndarray, list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, kind, first and last byte of each entity, with the bytes and the row bounds."""
    data, starts, ends, row, code = tokens(text)
    tag = field.decode(row, code, exhaustive)
    at = np.flatnonzero(tag)
    kind, inner = (tag[at] - 1) // 2, (tag[at] - 1) % 2 == 1
    # an inner tag that follows no token of its kind begins an entity
    follows = np.append(False, (np.diff(at) == 1) & (kind[1:] == kind[:-1]) & (row[at[1:]] == row[at[:-1]]))
    begin = np.flatnonzero(~(inner & follows)) if len(at) else at
    stop = np.append(begin[1:], len(at)) - 1 if len(at) else at
    first, last = starts[at[begin]].copy(), ends[at[stop]].copy()
    # marks and punctuation around an entity are not part of it
    edge = _DIGIT | _LETTER | (np.arange(256) == ord("+")) | (np.arange(256) == ord("("))
    tail = _DIGIT | _LETTER
    while (move := ~edge[data[first]] & (first < last - 1)).any():
        first += move
    while (move := ~tail[data[last - 1]] & (first < last - 1)).any():
        last -= move
    return row[at[begin]], [KINDS[i] for i in kind[begin]], first, last, data, tb.utf8(text)[1]


#: Tokens of a labelled table that the driver fits on; a larger one is refused, not cut.
MAX_LABELLED = 200_000


def labelled_sentences(labelled: DataFrame) -> list[list[tuple[str, str]]]:
    """The sentences of a table (sentence, place, token, tag), tokens by place; a null tag is O. Rows with a null or blank token or a null sentence are left out."""
    rows = labelled.select("sentence", "place", F.trim("token").alias("token"), F.coalesce("tag", F.lit("O")).alias("tag")).where("sentence IS NOT NULL AND token <> ''")
    if rows.count() > MAX_LABELLED:
        raise ValueError(f"a labelled table has {MAX_LABELLED} tokens at most")
    out: dict = {}
    for r in rows.orderBy("sentence", "place", "token", "tag").collect():
        if r.tag not in TAGS:
            raise ValueError(f"unknown tag {r.tag}")
        out.setdefault(r.sentence, []).append((r.token, r.tag))
    return list(out.values())


def find_private(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(doc_id, kind, start, end, value): every entity that the field finds, by characters of the text (end not included).

    The field is trained from labelled (sentence, place, token, tag with the tags of TAGS), or from labelled_table() where none is given; a table
    without a token finds nothing. Documents without an entity, and null texts, have no row. A null doc_id is reported as null; repeated rows give their entities
    again; texts of any length are decoded whole. Other columns are not read. No documents: no rows.
    """
    schema = "doc_id long, kind string, start int, end int, value string"
    if labelled is None:
        field = production_field()
    elif sentences := labelled_sentences(labelled):
        field = fit(sentences)
    else:
        return docs.sparkSession.createDataFrame([], schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                row, kind, first, last, data, offsets = spans(batch.column(1).slice(lo, hi - lo), field)
                if not len(row):
                    continue
                lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
                base = lead[offsets[row]]
                values = [bytes(data[a:b]).decode("utf-8", "replace") for a, b in zip(first, last)]
                ids = batch.column(0).take(pa.array(lo + row))
                yield pa.RecordBatch.from_arrays([ids, pa.array(kind, pa.string()), pa.array((lead[first] - base).astype(np.int32)), pa.array((lead[last] - base).astype(np.int32)), pa.array(values, pa.string())], names=["doc_id", "kind", "start", "end", "value"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def labelled_frame(spark: SparkSession) -> DataFrame:
    """The labelled table as a DataFrame (sentence, place, token, tag)."""
    return spark.createDataFrame([(i, j, t, g) for i, s in enumerate(labelled_table()) for j, (t, g) in enumerate(s)], "sentence int, place int, token string, tag string")
