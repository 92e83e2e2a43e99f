"""Toxicity by a weighted finite-state pattern grammar.

Four transducers run one behind the other over the word classes of a clause. Negation silences what stands in its
reach, up to a comma. The insult transducer writes hits: words that insult anyone, milder ones only where
somebody is addressed or as "a piece of ...", and tells those aimed at a person from the rest. The threat transducer wants a verb and its victim
in this order ("kill them", "will beat you", "go die", "werde dich schlagen"), so a process that is killed threatens nobody. Reported speech
marks the hits behind it. They are composed into one deterministic machine. Words get their classes from a
lexicon: curated words, and the words of any language that labelled documents show to be toxic. The weight of an insult is the
log-odds of the word; other words cost a little each, so a document is judged by the balance of
its matched clauses against its length, and a clause that insults a person by curated words, or threatens one, decides alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textbatch as tb
from .workspace import least_hashed, materialise

#: At most so many labelled documents (those of the least hash of their doc_id) teach the lexicon; all documents are scored.
MAX_LABELLED = 20_000
#: A learnt word stands in so many toxic documents at least, this many times more often than in others, with this likelihood-ratio statistic.
LEAST_DOCS, LEAST_RATIO, LEAST_G2 = 3, 50.0, 30.0
#: Weights without labels to learn from: an insult, an ordinary word, and the prior log-odds of a toxic document.
INSULT, ORDINARY, PRIOR = 6.0, 0.02, -2.2
THREAT, TARGETED = 6.0, 2.0
#: Weight from which a clause with a target decides alone.
DECISIVE = 6.0
REPORTED = 0.25

#: Classes of words, which are the input symbols.
CLASSES = "OTHER INSULT MILD LEARNT PIECE OF KILL BLOW ABROAD INTENT GO DIE YOU YOUR PERSON LINK THE NEGATION REPORT PAUSE".split()
OTHER, INSULTING, MILD, LEARNT, PIECE, OF, KILL, BLOW, ABROAD, INTENT, GO, DIE, YOU, YOUR, PERSON, LINK, THE, NEGATION, REPORT, PAUSE = range(len(CLASSES))
#: What the machines write: hits, aimed hits, an address that follows a hit, threats; and the hits in reported speech.
HIT, AIMED, LATE, THREATENED, SAID_HIT, SAID_AIMED, SAID_THREAT = range(len(CLASSES), len(CLASSES) + 7)
SYMBOLS = len(CLASSES) + 7
#: Words that make a clause worth running through the machine.
CORE = (INSULTING, MILD, LEARNT, KILL, BLOW, ABROAD, DIE)
LEXICON = {
    INSULTING: "idiot idiots moron morons stupid worthless pathetic disgusting scum scumbag scumbags imbecile imbeciles dumbass jerk vermin filthy bastard bastards cretin dimwit halfwit lowlife repulsive despicable asshole arschloch dummkopf vollidiot idiota idiotas imbécil estúpido estúpida crétin connard imbécile",
    MILD: "clown clowns loser losers trash garbage filth crap dirt pig pigs rat rats snake joke coward cowards liar liars fool fools crybaby waste disgrace dumb ugly freak weirdo basura payaso müll ordure clochard",
    PIECE: "piece pieces pile bag load heap sack waste",
    OF: "of",
    KILL: "kill murder strangle stab shoot hurt torture lynch slaughter execute",
    BLOW: "beat punch crush smash destroy hit break slap choke burn bury end find get ruin",
    ABROAD: "töten umbringen schlagen tuer frapper matar golpear",
    INTENT: "will ll gonna going gotta wanna shall must want should werde werden wird vais va voy vas",
    GO: "go",
    DIE: "die",
    YOU: "you yourself yourselves u dich dir du te tu toi vous ti",
    YOUR: "your yours ur",
    PERSON: "he him himself she her they them themselves their everyone everybody somebody someone people",
    LINK: "all both each every one some up off",
    THE: "the",
    NEGATION: "not never no isn aren wasn don doesn didn won wouldn nobody without nicht kein keine ne pas nunca jamais",
    REPORT: "said says say wrote writes claimed claims told quoted quotes reported reports alleged called sagte dijo dit",
}
_REACH = 4
_NEGATED = 3
U64 = np.uint64
#: What stands for a comma among the word hashes.
COMMA = U64(0x2C2C2C2C2C2C2C2C)


class Machine:
    """A deterministic transducer from state 0: step[state, symbol] is the next state, out[state, symbol] the output symbol."""

    def __init__(self, step: np.ndarray, out: np.ndarray) -> None:
        self.step, self.out = step.astype(np.int32), out.astype(np.int8)

    def then(self, other: Machine) -> Machine:
        """The composition: other reads what this machine writes. Only states that can be reached are kept."""
        names, step, out = {(0, 0): 0}, [], []
        for i, j in (queue := [(0, 0)]):
            written = self.out[i].tolist()
            pairs = [(int(x), int(other.step[j, w])) for x, w in zip(self.step[i], written)]
            for pair in pairs:
                if pair not in names:
                    names[pair] = len(names)
                    queue.append(pair)
            step.append([names[pair] for pair in pairs])
            out.append([int(other.out[j, w]) for w in written])
        return Machine(np.array(step), np.array(out))


def _machine(start, step) -> Machine:
    """The machine of step(state, symbol) -> (state, output), from its start state on."""
    names, steps, outs = {start: 0}, [], []
    for state in (queue := [start]):
        row = [step(state, a) for a in range(SYMBOLS)]
        for after, _ in row:
            if after not in names:
                names[after] = len(names)
                queue.append(after)
        steps.append([names[after] for after, _ in row])
        outs.append([o for _, o in row])
    return Machine(np.array(steps), np.array(outs))


def _negation(left: int, a: int) -> tuple[int, int]:
    """left: words that a negation still reaches."""
    after = _NEGATED if a == NEGATION else 0 if a == PAUSE else max(left - 1, 0)
    return after, OTHER if left and a in CORE else a


def _insults(state: tuple[int, int, int, int], a: int) -> tuple[tuple[int, int, int, int], int]:
    """state: words since somebody was addressed, since a person was named, "piece" or "piece of", and since a hit, counting down."""
    you, person, piece, hit = state
    found = a in (INSULTING, LEARNT) or a == MILD and (you or piece == 2)
    out = (AIMED if you or person else HIT) if found else OTHER if a in (INSULTING, LEARNT) else LATE if a == YOU and hit else a
    if a == MILD and not found and a != PIECE:
        out = OTHER
    lower = lambda x: x if a == PAUSE else max(x - 1, 0)
    after = (
        _REACH if a in (YOU, YOUR) else 0 if a == THE else lower(you),
        _REACH if a == PERSON else lower(person),
        1 if a == PIECE or a == MILD and not found else 2 if a == OF and piece == 1 else 0,
        2 if out == HIT else 0 if out == LATE else lower(hit),
    )
    return after, out


def _threats(state: tuple[int, int, int, int], a: int) -> tuple[tuple[int, int, int, int], int]:
    """state: words since an intent, since somebody was addressed, whether a verb waits for its victim, and whether "go" stands before."""
    intent, you, verb, go = state
    threat = bool(verb) and a in (YOU, LATE, PERSON) or a == DIE and (go or intent and you) or a == ABROAD and intent and you
    out = THREATENED if threat else OTHER if a in (KILL, BLOW, ABROAD, DIE) else a
    if a == PAUSE:
        return (0, 0, 0, 0), out
    after = (
        3 if a == INTENT else max(intent - 1, 0),
        3 if a in (YOU, LATE) else max(you - 1, 0),
        int(a == KILL or a == BLOW and intent > 0 or verb and a in (LINK, OF)),
        int(a == GO or go and a == LINK),
    )
    return after, out


def _report(said: int, a: int) -> tuple[int, int]:
    return int(said or a == REPORT), {HIT: SAID_HIT, AIMED: SAID_AIMED, THREATENED: SAID_THREAT}.get(a, a) if said else a


@cache
def parts() -> tuple[Machine, ...]:
    return _machine(0, _negation), _machine((0, 0, 0, 0), _insults), _machine((0, 0, 0, 0), _threats), _machine(0, _report)


@cache
def grammar() -> Machine:
    """The composed machine."""
    first, *rest = parts()
    for other in rest:
        first = first.then(other)
    return first


def lexicon_hashes() -> dict[int, int]:
    out = {}
    for symbol, line in LEXICON.items():
        names = line.split()
        hashes, bounds = tb.words(pa.array(names))
        out |= {h: symbol for i in range(len(names)) if (h := int(hashes[bounds[i]])) not in out}
    return out


class Lexicon:
    """Hashes of the words that matter, sorted, with their symbols and weights."""

    def __init__(self, learnt: dict[int, float], ordinary: float, prior: float) -> None:
        named = lexicon_hashes()
        table = {h: (s, INSULT if s in (INSULTING, MILD) else 0.0) for h, s in named.items()}
        for h, w in learnt.items():
            if h not in table or table[h][0] == MILD:
                table[h] = (LEARNT, w)
            elif table[h][0] == INSULTING:
                table[h] = (INSULTING, w)
        table[int(COMMA)] = (PAUSE, 0.0)
        self.machine = grammar()
        self.hashes = np.array(sorted(table), U64)
        self.symbol = np.array([table[int(h)][0] for h in self.hashes], np.int64)
        self.weight = np.array([table[int(h)][1] for h in self.hashes], float)
        self.curated = np.array([int(h) in named for h in self.hashes])
        self.ordinary, self.prior = ordinary, prior
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.hashes & U64((1 << 20) - 1)).astype(np.int64)] = True

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol and weight of each word, and its weight if it is a curated one."""
        symbol, weight, curated = np.zeros(len(h), np.int64), np.zeros(len(h)), np.zeros(len(h))
        at = np.flatnonzero(self.known[(h & U64((1 << 20) - 1)).astype(np.int64)])
        i = np.minimum(np.searchsorted(self.hashes, h[at]), len(self.hashes) - 1)
        good = self.hashes[i] == h[at]
        at, i = at[good], i[good]
        symbol[at], weight[at], curated[at] = self.symbol[i], self.weight[i], self.weight[i] * self.curated[i]
        return symbol, weight, curated


_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?;:\n|"]] = True


def clauses(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Hashes of words (COMMA for a comma), their clause numbers (rising over the slice), and their rows."""
    data, offsets = tb.utf8(pc.utf8_lower(text))
    starts, ends, row = tb.spans(tb.WORD[data], offsets)
    h = tb.span_hash(tb.prefix_hash(data), starts, ends)
    if not len(h):
        return h, row, row, len(offsets) - 1
    marks = np.cumsum(_BREAK[data], dtype=np.int32)
    new = np.append(True, (marks[starts[1:]] != marks[starts[:-1]]) | (row[1:] != row[:-1]))
    clause = np.cumsum(new) - 1
    # a comma belongs to the clause of the word before it
    comma = np.flatnonzero(data == 44)
    at = np.searchsorted(starts, comma)
    inside = at > 0
    comma, at = comma[inside], at[inside]
    inside = (row[at - 1] == np.searchsorted(offsets, comma, "right") - 1) & (marks[starts[at - 1]] == marks[comma])
    at = at[inside]
    return np.insert(h, at, COMMA), np.insert(clause, at, clause[at - 1]), np.insert(row, at, row[at - 1]), len(offsets) - 1


def run_grammar(machine: Machine, clause: np.ndarray, symbol: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Clauses that hold a word of a CORE class, the weight of each, and whether it is aimed at a person."""
    hot = np.unique(clause[np.isin(symbol, CORE)])
    if not len(hot):
        return hot, np.zeros(0), np.zeros(0, bool)
    lo, hi = np.searchsorted(clause, hot, "left"), np.searchsorted(clause, hot, "right")
    lengths = hi - lo
    row = np.repeat(np.arange(len(hot)), lengths)
    at = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(lo, lengths)
    # runs of ordinary words matter up to the longest reach only
    s = symbol[at]
    new = np.append(True, row[1:] != row[:-1])
    event = np.flatnonzero((s != OTHER) | new)
    since = np.arange(len(s)) - event[np.searchsorted(event, np.arange(len(s)), "right") - 1]
    kept = (s != OTHER) | (since <= _REACH)
    row, s, w = row[kept], s[kept], weight[at][kept]
    lengths = np.bincount(row, minlength=len(hot))
    first = np.cumsum(lengths) - lengths
    state = np.zeros(len(hot), np.int64)
    value, aimed = np.zeros(len(hot)), np.zeros(len(hot), bool)
    live, i = np.arange(len(hot)), 0
    while len(live):
        j = first[live] + i
        out = machine.out[state[live], s[j]]
        # a hit that weighs nothing here is none, nor is an address behind it
        value[live] += _SHARE[out] * w[j] + _BONUS[out] * ((w[j] > 0) | ~np.isin(out, (AIMED, SAID_AIMED)))
        aimed[live] |= np.isin(out, (AIMED, LATE, THREATENED))
        state[live] = machine.step[state[live], s[j]]
        i += 1
        live = live[lengths[live] > i]
    return hot, value, aimed


_SHARE, _BONUS = np.zeros(SYMBOLS), np.zeros(SYMBOLS)
_SHARE[[HIT, AIMED]], _SHARE[[SAID_HIT, SAID_AIMED]] = 1.0, REPORTED
_BONUS[[AIMED, LATE]], _BONUS[THREATENED], _BONUS[SAID_AIMED], _BONUS[SAID_THREAT] = TARGETED, THREAT, TARGETED * REPORTED, THREAT * REPORTED


def learn(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> Lexicon:
    """The lexicon that the labelled documents teach, next to the curated words."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("double").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL")
    verdicts = known.groupBy("doc_id").agg((F.avg("toxic") >= 0.5).cast("int").alias("toxic"))
    # only labels whose document is there: the sample is taken and cut by their count
    verdicts = materialise(verdicts.join(docs.select(F.col("doc_id").cast("long").alias("doc_id")), "doc_id", "left_semi"), "toxic-verdicts")
    sample = materialise(least_hashed(verdicts, "doc_id", max_labelled, verdicts.count()), "toxic-labels")  # at most max_labelled rows, hence broadcast
    taught = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("text", "toxic")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic = batch.column(1).to_numpy()
            for lo, hi in tb.slices(batch.column(0)):
                h, _, row, n = clauses(batch.column(0).slice(lo, hi - lo))
                h, row = h[h != COMMA], row[h != COMMA]
                bad = toxic[lo:hi][row].astype(bool)
                words, at = np.unique(h, return_inverse=True)
                k = len(words)
                pair = np.unique(at * n + row) if k else np.zeros(0, np.int64)
                in_bad = toxic[lo:hi][pair % n].astype(bool) if k else np.zeros(0, bool)
                cols = [np.bincount(at[bad], minlength=k), np.bincount(at[~bad], minlength=k), np.bincount(pair[in_bad] // n, minlength=k), np.bincount(pair[~in_bad] // n, minlength=k)]
                words = np.append(words, U64(0))  # the totals of words and documents
                t = int(toxic[lo:hi].sum())
                cols = [np.append(c, x) for c, x in zip(cols, (bad.sum(), (~bad).sum(), t, hi - lo - t))]
                yield pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in cols)], names=["word", "bad", "good", "bad_docs", "good_docs"])

    names = ("bad", "good", "bad_docs", "good_docs")
    counts = taught.mapInArrow(count, "word long, " + ", ".join(f"{n} long" for n in names)).groupBy("word").agg(*(F.sum(n).alias(n) for n in names))
    counts = materialise(counts, "toxic-words")
    total = counts.where("word = 0").first()
    if total is None or not total.bad or not total.good:
        return Lexicon({}, ORDINARY, PRIOR)
    bad, good, bad_docs, good_docs = (float(total[n]) for n in names)
    rate_bad, rate_good = (F.col("bad") + 0.5) / F.lit(bad), (F.col("good") + 0.5) / F.lit(good)
    # by documents, as a word may be repeated within one
    pooled = (F.col("bad_docs") + F.col("good_docs")) / F.lit(bad_docs + good_docs)
    g2 = 2 * (F.col("bad_docs") * F.log(F.greatest(F.col("bad_docs"), F.lit(1)) / (pooled * bad_docs)) + F.col("good_docs") * F.log(F.greatest(F.col("good_docs"), F.lit(1)) / (pooled * good_docs)))
    chosen = counts.where("word <> 0").where((F.col("bad_docs") >= LEAST_DOCS) & (rate_bad >= LEAST_RATIO * rate_good) & (g2 >= LEAST_G2)).select("word", "bad", "good", F.log(rate_bad / rate_good).alias("weight")).collect()
    curated = {h for h, s in lexicon_hashes().items() if s == INSULTING}
    learnt = {r.word & 0xFFFFFFFFFFFFFFFF: max(r.weight, INSULT) if (r.word & 0xFFFFFFFFFFFFFFFF) in curated else r.weight for r in chosen}
    # three quarters of the mean excess, so that documents with fewer insults than the mean are found too
    ordinary = max(sum(r.bad for r in chosen) / bad - sum(r.good for r in chosen) / good, 0.0) * 0.75 if chosen else ORDINARY
    return Lexicon(learnt, ordinary, float(np.log((bad_docs + 1) / (good_docs + 1))))


def judge(text: pa.Array, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row: the log-odds, the number of matched clauses, and the weight of the worst."""
    h, clause, row, n = clauses(text)
    symbol, weight, curated = lexicon.look(h)
    score = np.full(n, lexicon.prior) - lexicon.ordinary * np.bincount(row[h != COMMA], minlength=n)
    found, worst, decisive = np.zeros(n, np.int64), np.zeros(n), np.zeros(n, bool)
    hot, value, aimed = run_grammar(lexicon.machine, clause, symbol, weight)
    if len(hot):
        r = row[np.searchsorted(clause, hot)]
        hit = value > 0
        score += np.bincount(r, value, n)
        found = np.bincount(r[hit], minlength=n)
        np.maximum.at(worst, r, value)
        # learnt words add to the balance only; a clause decides alone by curated ones
        alone = run_grammar(lexicon.machine, clause, symbol, curated)[1]
        decisive[r[aimed & (alone >= DECISIVE)]] = True
    return np.where(decisive, np.maximum(score, 1.0), score), found, worst


def toxic_documents(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """(doc_id, score, n_clauses, worst): the toxic documents, those whose log-odds (score) are above 0.

    n_clauses counts the matched clauses and worst is the weight of the heaviest. Negated insults weigh nothing,
    reported ones little, threats need a verb and its victim. Texts of any length are read whole. Labels are matched by doc_id (several: the majority, a tie is toxic); without labels of
    either kind the curated lexicon judges alone. Null and wordless texts are not toxic; a null doc_id is reported as null; repeated
    rows are judged alike, each in a row. Other columns are not read. No documents: no rows.
    """
    lexicon = learn(docs, labels, max_labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in tb.slices(batch.column(1)):
                score, found, worst = judge(batch.column(1).slice(lo, hi - lo), lexicon)
                bad = (score > 0) & (found > 0)
                if bad.any():
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).filter(pa.array(bad)), pa.array(np.round(score[bad], 6)), pa.array(found[bad].astype(np.int32)), pa.array(np.round(worst[bad], 6))], names=["doc_id", "score", "n_clauses", "worst"])

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return source.mapInArrow(run, "doc_id long, score double, n_clauses int, worst double")
