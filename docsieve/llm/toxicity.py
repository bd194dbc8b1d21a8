"""Toxicity by a weighted finite-state pattern grammar (operator 1).

Five transducers read the words of a clause from left to right.  Each is a table of arcs over
classes of words (``Fst``) and says at every word what holds there:

* INSULT and THREAT say what a lexical hit is.  A hit's weight is the log odds of the word,
  or of its first letters, between toxic and other labelled documents;
* TARGET is in a state "addressed" from a pronoun or a form of "to be" for a few words;
* NEGATION is in a state "negated" for a few words after a negator;
* REPORT is in a state "reported" from a verb of saying to the end of its clause, or
  inside quotation marks.

``compose`` makes one machine of them, whose states are tuples of theirs, as far as a text
reaches.  A clause is one path of it: what the transducers say at a hit decides which sum its
weight goes to (an addressed threat is not an addressed insult), and the clause's own weight
is the product of hit and context weights, summed over the path.

What the sums count for is fitted: a logistic regression on the sums over paths of each kind.
Words of targets, negation and reported speech are given below; insults are learned from
labels, and so are threats, except for a few known verbs that count as threats.

Training uses at most ``TRAIN_ROWS`` labelled rows, the first in hash order, whole texts.
Label, language, source and doc_id are never inputs of a score.

Defined results: null and empty texts have no clause and get the intercept's score; equal
texts and repeated rows score alike; repeated label rows vote one by one, and null labels
do not count; without labels of both kinds every score is the share of toxic labels (0
without any); an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Callable
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, lean, only, staged, text_chunks

TRAIN_ROWS = 20_000
LEXICON = 4_096
LEAST_COUNT = 8
LEAST_ODDS = 3.0
PREFIXES = (4, 5)
REACH = 4

#: Fixed word lists of the grammar, in English, German, Spanish and French.
TARGETS = frozenset("you your he she they is are was were du dein sie ihr er ist bist sind tu tus eres es son vous toi il elle est êtes sont".split())
NEGATORS = frozenset("not no never neither without nicht kein keine nie ohne nunca jamás sin ne pas jamais sans aucun".split())
REPORTERS = frozenset("said says say told called claimed wrote according sagte sagt schrieb dijo dice escribió dit disait écrit selon".split())
THREATS = frozenset("kill hurt destroy murder shoot stab töten umbringen matar herir tuer frapper".split())
_TOKEN = re.compile(r"[^\W\d_]+|[.!?;\n]|[\"“”«»]")
_WORD = re.compile(r"[^\W\d_]+")
_QUOTES = frozenset('"“”«»')

#: Sums over matched clauses: kinds of path, most in one clause, and matched clauses.
FEATURES = ("insult", "threat", "addressed", "threatened", "negated", "reported", "most", "clauses")
#: What a hit counts for in its clause where it is denied or somebody else's words.
DENIED = 0.25

#: Classes of words as bits; a word can be in several.
INSULTING, THREATENING, TARGETING, NEGATING, REPORTING = 1, 2, 4, 8, 16
#: Signs are classes of their own.
QUOTE, LINE, STOP = 32, 64, 128


class Fst(NamedTuple):
    """A transducer: ``arcs`` give by state and class the next state, ``says`` what holds at a word read in a state.

    An arc is taken for the first class that the word has, in the order of the arcs; a word of
    none of them takes the arc of class 0, and without one the state stays.  What a state says
    holds at words of the given classes, or at all if none is given.
    """

    start: int
    arcs: dict[int, dict[int, int]]
    says: dict[int, tuple[int, str]]

    def step(self, state: int, classes: int) -> int:
        out = self.arcs.get(state, {})
        return next((to for c, to in out.items() if c & classes), out.get(0, state))

    def said(self, state: int, classes: int) -> set[str]:
        of, what = self.says.get(state, (0, ""))
        return {what} if what and (not of or of & classes) else set()


def _window(opens: int, says: str, reach: int = REACH) -> Fst:
    """In a state that says so for ``reach`` words after one of class ``opens``; the clause's end closes it."""
    arcs = {n: {STOP: 0, LINE: 0, QUOTE: n, opens: reach, 0: max(n - 1, 0)} for n in range(reach + 1)}
    return Fst(0, arcs, {n: (0, says) for n in range(1, reach + 1)})


#: States 0 plain, 1 reported, 2 quoted, 3 both; a line's end also ends a quotation.
REPORT = Fst(
    0,
    {
        0: {LINE: 0, STOP: 0, QUOTE: 2, REPORTING: 1}, 1: {LINE: 0, STOP: 0, QUOTE: 3},
        2: {LINE: 0, STOP: 2, QUOTE: 0, REPORTING: 3}, 3: {LINE: 0, STOP: 2, QUOTE: 1},
    },
    {n: (0, "reported") for n in (1, 2, 3)},
)
TARGET = _window(TARGETING, "addressed")
NEGATION = _window(NEGATING, "negated")
#: What a hit is depends on the word alone, so these have one state.
INSULT, THREAT = Fst(0, {}, {0: (INSULTING, "insult")}), Fst(0, {}, {0: (THREATENING, "threat")})
GRAMMAR = (INSULT, THREAT, TARGET, NEGATION, REPORT)


def compose(machines: tuple[Fst, ...]) -> Callable[[tuple[int, ...], int], tuple[tuple[int, ...], frozenset[str]]]:
    """The product machine: (states, classes) to the next states and all that holds at the word.

    Words are read in the states before them; pairs that a text has met are kept.
    """
    met: dict[tuple[tuple[int, ...], int], tuple[tuple[int, ...], frozenset[str]]] = {}

    def step(states: tuple[int, ...], classes: int) -> tuple[tuple[int, ...], frozenset[str]]:
        if (found := met.get((states, classes))) is None:
            after = tuple(m.step(s, classes) for m, s in zip(machines, states, strict=True))
            said = (m.said(s, classes) for m, s in zip(machines, states, strict=True))
            found = met[states, classes] = after, frozenset().union(*said)
        return found

    return step


def kind_of(said: frozenset[str]) -> str:
    """The sum that a hit's weight goes to, from what the machines say at the word."""
    for context in ("negated", "reported"):
        if context in said:
            return context
    if "addressed" in said:
        return "threatened" if "threat" in said else "addressed"
    return "threat" if "threat" in said else "insult"


class Lexicon(NamedTuple):
    """Log odds of words, and of beginnings by their length."""

    words: dict[str, float]
    starts: dict[int, dict[str, float]]


class Model(NamedTuple):
    lexicon: Lexicon
    weights: np.ndarray  # intercept first, then FEATURES
    quiet: float  # the score of a text without any hit


def weight_of(lexicon: Lexicon, word: str) -> float:
    """The word's own log odds, or else its longest known beginning's."""
    w = lexicon.words.get(word)
    if w is None:
        for n in reversed(PREFIXES):
            if (w := lexicon.starts[n].get(word[:n])) is not None:
                break
    return w or (LEAST_ODDS if word in THREATS else 0.0)


_STEP = compose(GRAMMAR)
_START = tuple(m.start for m in GRAMMAR)


def classes_of(token: str, weight: float) -> int:
    """The classes of a token in lower case with its lexical weight."""
    if token in _QUOTES:
        return QUOTE
    if token == "\n":
        return LINE
    if token in ".!?;":
        return STOP
    return (
        (THREATENING if token in THREATS else INSULTING) * (weight > 0) | TARGETING * (token in TARGETS)
        | NEGATING * (token in NEGATORS) | REPORTING * (token in REPORTERS)
    )


#: Tokens whose classes a task keeps at a time.
KEPT = 200_000


def clause_paths(lexicon: Lexicon, text: str, known: dict[str, tuple[int, float]] | None = None) -> np.ndarray:
    """FEATURES of a text: one run of the composed transducers over its words.

    ``known`` keeps classes and weights of tokens from one text to the next.
    """
    known = {} if known is None else known
    sums = dict.fromkeys(FEATURES, 0.0)
    clause, states = 0.0, _START
    for t in _TOKEN.findall(text.lower()):
        if (found := known.get(t)) is None:
            if len(known) >= KEPT:
                known.clear()
            w = weight_of(lexicon, t)
            found = known[t] = classes_of(t, w), w
        classes, w = found
        if not classes and states == _START:
            continue  # the machines stay at their starts
        states, said = _STEP(states, classes)
        if classes & (STOP | LINE):
            sums["clauses"] += clause > 0
            sums["most"] = max(sums["most"], clause)
            clause = 0.0
        elif classes & (INSULTING | THREATENING):
            kind = kind_of(said)
            sums[kind] += w
            clause += w * (DENIED if kind in ("negated", "reported") else 1.0)
    sums["clauses"] += clause > 0
    sums["most"] = max(sums["most"], clause)
    return np.array([math.log1p(sums[k]) for k in FEATURES])


def has_hit(lexicon: Lexicon, text: str) -> bool:
    """Whether any word has a weight; a text without goes past the transducers."""
    words = set(_WORD.findall(text.lower()))
    if not (words.isdisjoint(lexicon.words) and words.isdisjoint(THREATS)):
        return True
    return any(not {w[:n] for w in words}.isdisjoint(lexicon.starts[n]) for n in PREFIXES)


def _terms(batches):
    """(term, label, documents) of one task: each document counts a term once."""
    counts: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for batch in batches:
        for text, y in zip(batch["text"], batch["toxic"].to_pylist(), strict=True):
            words = set(_WORD.findall((text.as_py() or "").lower()))
            counts[y].update(words | {f"{w[:n]}-" for w in words for n in PREFIXES if len(w) >= n})
            counts[y][""] += 1
    for y, c in counts.items():
        items = list(c.items())
        for at in range(0, len(items), 50_000):
            part = items[at : at + 50_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([t for t, _ in part]), pa.array([y] * len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())],
                ["term", "y", "n"],
            )


def _train_features(lexicon, batch):
    known: dict[str, tuple[int, float]] = {}
    for chunk in text_chunks(batch):
        x = [clause_paths(lexicon, t or "", known).tolist() for t in chunk["text"].to_pylist()]
        yield pa.RecordBatch.from_arrays([chunk["toxic"].cast(pa.int32()), pa.array(x, pa.list_(pa.float64()))], ["y", "x"])


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> np.ndarray:
    """Newton's method with a small ridge; intercept first."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.zeros(a.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (p - y) / len(y) + ridge * w
        hess = (a * (p * (1 - p))[:, None]).T @ a / len(y) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def held_out(doc_id: Column, of: int, remainder: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % of == remainder


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Learn the lexicon and the path weights from labelled rows that are not held out."""
    marks = only(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"), 5, 0))
    marks = marks.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    sample = F.broadcast(marks.withColumnRenamed("doc_id", "_id"))  # at most ``rows`` rows of two numbers
    d = only(docs, "doc_id", "text")
    known = staged(d.join(sample, d["doc_id"] == F.col("_id")).select("text", "toxic"))  # read three times below
    counted = staged(known.mapInArrow(lean(_terms), "term string, y int, n long").groupBy("term").agg(
        F.sum(F.when(F.col("y") == 1, F.col("n")).otherwise(0)).alias("bad"),
        F.sum(F.when(F.col("y") == 0, F.col("n")).otherwise(0)).alias("good"),
    ))
    totals = counted.filter("term = ''").collect()
    bad, good = (totals[0]["bad"], totals[0]["good"]) if totals else (0, 0)
    if not bad or not good:
        share = bad / (bad + good) if bad + good else 0.0
        return Model(Lexicon({}, {n: {} for n in PREFIXES}), np.zeros(len(FEATURES) + 1), share)
    odds = F.log((F.col("bad") + 0.5) / (bad + 1.0)) - F.log((F.col("good") + 2.0) / (good + 4.0))
    terms = counted.filter((F.col("term") != "") & (F.col("bad") >= LEAST_COUNT)).withColumn("odds", odds)
    terms = terms.filter(F.col("odds") >= LEAST_ODDS).orderBy(F.desc("odds"), "term").limit(LEXICON).collect()
    found = {r["term"]: r["odds"] for r in terms}
    starts = {n: {t[:-1]: w for t, w in found.items() if t[-1] == "-" and len(t) == n + 1} for n in PREFIXES}
    lexicon = Lexicon({t: w for t, w in found.items() if t[-1] != "-"}, starts)
    table = arrow_map(known, "y int, x array<double>", partial(_train_features, lexicon)).toPandas()
    w = fit_logistic(np.stack(table["x"]), table["y"].to_numpy(float))
    return Model(lexicon, w, float(1 / (1 + math.exp(-w[0]))))


def score_of(model: Model, text: str, known: dict[str, tuple[int, float]] | None = None) -> float:
    if not model.weights.any() or not has_hit(model.lexicon, text):
        return model.quiet
    z = model.weights[0] + model.weights[1:] @ clause_paths(model.lexicon, text, known)
    return float(1 / (1 + math.exp(-min(max(z, -30.0), 30.0))))


def _scored(model, batch):
    known: dict[str, tuple[int, float]] = {}
    for chunk in text_chunks(batch):
        ids = chunk["doc_id"].to_pylist()
        s = [score_of(model, t or "", known) for t in chunk["text"].to_pylist()]
        held = [None if i is None else zlib.crc32(str(i).encode()) % 5 == 0 for i in ids]
        yield pa.RecordBatch.from_arrays(
            [chunk["doc_id"], pa.array(held, pa.bool_()), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())],
            ["doc_id", "held_out", "score", "predicted"],
        )


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of docs."""
    return arrow_map(only(docs, "doc_id", "text"), "doc_id long, held_out boolean, score double, predicted int", partial(_scored, model))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
