"""Language identification of whole texts and of spans in mixed texts (operator 7).

Scripts come first: a word can be in the languages that use its script (a language uses a
script if at least ``SCRIPT_SHARE`` of its training letters are of it).  Among those, a
word's score for a language is the sum of log probabilities of its byte trigrams, borders
included, in that language, against their mean over languages.  A Viterbi path over the
words, with a penalty for every switch, labels spans; the text's language is the one with
the most letters in its spans, and the score is its share of the letters, brought down by
how unsure the path was.

Training reads text and language of about ``TRAIN_ROWS`` rows that are not held out, the
first of each language in hash order, whole texts: as many rows of every language as there
are or as bring the sum to ``TRAIN_ROWS``, but of a language with up to ``LEAST_ROWS`` rows
always all.  So a language is learned at any size of the table.  Everything is counted in numpy: trigram counts in
``CELLS`` hashed cells a language.  doc_id, source and language are never inputs of a
prediction.

Defined results: null, empty and letterless texts (emoji are no letters) are ``und`` with
score 0, and so is every text when nothing could be learned; a text whose every word is in a
script that no learned language uses gets the first language with score 0; equal texts and repeated rows get equal results; ties
go to the language that is first by code point; an empty table gives an empty table; other
columns are ignored.
"""

from __future__ import annotations

import unicodedata
import zlib
from collections import Counter
from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, lean, only, text_chunks
from .toxicity import held_out

TRAIN_ROWS = 12_000
#: So many rows of a language are read however many languages share TRAIN_ROWS.
LEAST_ROWS = 500
CELLS = 1 << 16
SWITCH = 12.0
SCRIPT_SHARE = 0.01
UNKNOWN = "und"
#: Scripts with fewer letters than this, such as single signs, are one class.
LEAST_LETTERS = 20
OTHER = "OTHER"


def _script(code: int) -> str:
    """The script of a letter is the first word of its Unicode name."""
    return unicodedata.name(chr(code), OTHER).split(" ")[0].split("-")[0]


def _ranges() -> tuple[tuple[str, ...], np.ndarray, np.ndarray]:
    """Script names, and the ranges of code points below 0x20000 by first code point and script."""
    of = {i: _script(i) for i in range(0x20000) if chr(i).isalpha()}
    many = Counter(of.values())
    names = (OTHER, *sorted(n for n, count in many.items() if count >= LEAST_LETTERS and n != OTHER))
    number = {n: i for i, n in enumerate(names)}
    first, kind = [0], [0]
    for code, name in of.items():  # what is between two letters of one script belongs to it
        if (k := number.get(name, 0)) != kind[-1]:
            first.append(code)
            kind.append(k)
    return names, np.array(first), np.array(kind)


NAMES, _FROM, _KIND = _ranges()


class Model(NamedTuple):
    languages: list[str]
    table: np.ndarray  # CELLS x languages: log probability against the mean over languages
    scripts: np.ndarray  # scripts x languages: whether the language uses the script


_LETTER = np.fromiter((chr(i).isalpha() for i in range(0x10000)), bool, 0x10000)
_LOWER = np.fromiter((ord(c) if len(c := chr(i).lower()) == 1 else i for i in range(0x10000)), np.uint32, 0x10000)


class Words(NamedTuple):
    """Words (runs of letters) of many texts: cells of trigrams, where each word's begin, and more a word."""

    cells: np.ndarray
    begins: np.ndarray
    sizes: np.ndarray
    script: np.ndarray
    first: np.ndarray  # where each text's words begin; one more than texts


def words_of(column: pa.Array) -> Words:
    """All words of a column of texts, at once."""
    texts = ["" if t is None else t for t in column.to_pylist()]
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    code = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
    low = np.minimum(code, 0xFFFF)
    letter, high = _LETTER[low], code > 0xFFFF
    if high.any():  # emoji and other signs up there are no letters
        kinds, which = np.unique(code[high], return_inverse=True)
        letter[high] = np.fromiter((chr(k).isalpha() for k in kinds), bool, len(kinds))[which]
    code = np.where(high, code, _LOWER[low])
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    # every word with a border at either end: trigrams are centred on its letters
    c = np.where(letter, code, 0).astype(np.uint32)
    before, after = np.roll(c, 1), np.roll(c, -1)
    if len(c):
        before[0] = after[-1] = 0
    mixed = (before * np.uint32(0x9E3779B1)) ^ (c * np.uint32(0x85EBCA77)) ^ (after * np.uint32(0xC2B2AE3D))
    mixed ^= mixed >> np.uint32(15)
    cells = (mixed * np.uint32(0x2C1B3C6D) >> np.uint32(16)).astype(np.int64)[letter]
    sizes = ends - starts
    begins = np.cumsum(sizes) - sizes
    script = _KIND[np.maximum(np.searchsorted(_FROM, code[starts], side="right") - 1, 0)] if len(starts) else np.zeros(0, int)
    first = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    return Words(cells, begins, sizes, script, first)


def _counts(languages, batches):
    cells = np.zeros((len(languages), CELLS), np.int64)
    scripts = np.zeros((len(languages), len(NAMES)), np.int64)
    for batch in batches:
        for chunk in text_chunks(batch):
            of = np.array([languages.index(x) for x in chunk["lang"].to_pylist()])
            w = words_of(chunk["text"])
            lang = np.repeat(of, np.diff(w.first))
            per_cell = np.repeat(lang, w.sizes)
            cells += np.bincount(per_cell * CELLS + w.cells, minlength=cells.size).reshape(cells.shape)
            scripts += np.bincount(lang * len(NAMES) + w.script, weights=w.sizes, minlength=scripts.size).reshape(scripts.shape).astype(np.int64)
    both = np.concatenate([cells.ravel(), scripts.ravel()])
    at = np.flatnonzero(both)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(both[at])], ["k", "v"])


def rows_each(counts: list[int], rows: int, least: int = LEAST_ROWS) -> float:
    """How many rows a language has at most, so that the smaller of that and its count sum to ``rows``."""
    left = rows
    for i, n in enumerate(sorted(counts)):
        if n * (len(counts) - i) >= left:
            return max(left / (len(counts) - i), least)
        left -= n
    return max(*counts, least)


def train(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    """Trigram tables from rows that are not held out; the driver gets CELLS counts a language."""
    d = only(docs, "doc_id", "text", "lang").filter(~held_out(F.col("doc_id"), 4, 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["count"] for r in d.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], np.zeros((CELLS, 0)), np.zeros((len(NAMES), 0), bool))
    # for each language a share of the hash range that holds about so many of its rows
    most = rows_each(list(counts.values()), rows)
    shares = {k: int(min(1.0, most / n) * (1 << 40)) for k, n in counts.items()}
    if min(shares.values()) < 1 << 40:
        upto = F.create_map(*[F.lit(x) for pair in shares.items() for x in pair])
        d = d.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) < F.element_at(upto, F.col("lang")))
    total = np.zeros(len(languages) * (CELLS + len(NAMES)), np.int64)
    for r in d.select("text", "lang").mapInArrow(lean(partial(_counts, languages)), "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r["k"]] = r["v"]
    cells = total[: len(languages) * CELLS].reshape(len(languages), CELLS).astype(np.float64)
    scripts = total[len(languages) * CELLS :].reshape(len(languages), len(NAMES)).T
    logs = np.log((cells + 0.5) / (cells.sum(axis=1, keepdims=True) + 0.5 * CELLS))
    table = (logs - logs.mean(axis=0)).T.astype(np.float32)
    uses = scripts >= np.maximum(SCRIPT_SHARE * scripts.sum(axis=0), 1)
    return Model(languages, np.ascontiguousarray(table), uses)


def viterbi(emit: np.ndarray, penalty: float = SWITCH) -> tuple[np.ndarray, np.ndarray]:
    """Best paths of many texts of equal word counts: emit is texts x words x languages.

    Returns the language of each word and, a text, the final lead over the second best.
    """
    texts, steps, k = emit.shape
    kind = np.min_scalar_type(max(k - 1, 1))  # wide enough for any number of languages
    came = np.zeros((steps, texts, k), kind)
    s = emit[:, 0].copy()
    own = np.arange(k, dtype=kind)
    for t in range(1, steps):
        best = s.argmax(axis=1)
        switched = s[np.arange(texts), best][:, None] - penalty
        stay = s >= switched
        came[t] = np.where(stay, own, best[:, None])
        s = np.where(stay, s, switched) + emit[:, t]
    path = np.zeros((texts, steps), np.int64)
    path[:, -1] = s.argmax(axis=1)
    for t in range(steps - 1, 0, -1):
        path[:, t - 1] = came[t][np.arange(texts), path[:, t]]
    two = np.sort(s, axis=1)[:, -2:] if k > 1 else np.hstack([s - 1e3, s])
    return path, two[:, 1] - two[:, 0]


def word_scores(model: Model, w: Words) -> np.ndarray:
    """words x languages; a language that does not use the word's script is all but ruled out."""
    out = np.zeros((len(w.sizes), len(model.languages)), np.float32)
    if len(w.sizes):
        np.add.reduceat(model.table[w.cells], w.begins, axis=0, out=out)
        allowed = model.scripts[w.script]
        known = allowed.any(axis=1)
        out[~known] = 0
        out[known[:, None] & ~allowed] = -50
    return out


def label_words(model: Model, w: Words, group: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """The language of every word and the lead of every text.

    Texts of like word counts go through the path search together, padded with words that
    speak for no language.
    """
    score = word_scores(model, w)
    n = np.diff(w.first)
    lang, lead = np.zeros(len(w.sizes), np.int64), np.zeros(len(n))
    order = np.argsort(n, kind="stable")
    order = order[n[order] > 0]
    at = 0
    while at < len(order):
        some = order[at : at + group]
        while len(some) > 1 and n[some[-1]] * len(some) > 400_000:
            some = some[: len(some) // 2]
        at += len(some)
        longest = int(n[some].max())
        inside = np.arange(longest) < n[some][:, None]
        emit = np.zeros((len(some), longest, len(model.languages)), np.float32)
        emit[inside] = np.concatenate([score[w.first[i] : w.first[i + 1]] for i in some])
        path, lead[some] = viterbi(emit)
        for row, i in enumerate(some):
            lang[w.first[i] : w.first[i + 1]] = path[row, : n[i]]
    return lang, lead


def spans(model: Model, text: str) -> list[tuple[str, int, int]]:
    """(language, first word, end word) of a text's spans."""
    w = words_of(pa.array([text], pa.string()))
    if not len(w.sizes) or not model.languages:
        return []
    lang, _ = label_words(model, w)
    cuts = [0, *(np.flatnonzero(np.diff(lang)) + 1).tolist(), len(lang)]
    return [(model.languages[lang[a]], a, b) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def identify(model: Model, column: pa.Array, closed: bool = False) -> tuple[list[str], list[float]]:
    """The language and the score of each text.

    A text whose every word is in a script that no learned language uses is ``und`` or, if
    languages are ``closed``, in the first language, with score 0.
    """
    w = words_of(column)
    texts, k = len(column), len(model.languages)
    if not k:
        return [UNKNOWN] * texts, [0.0] * texts
    lang, lead = label_words(model, w)
    text = np.repeat(np.arange(texts), np.diff(w.first))
    known = model.scripts[w.script].any(axis=1)
    mass = np.bincount(text[known] * k + lang[known], weights=w.sizes[known], minlength=texts * k).reshape(texts, k)
    letters = np.bincount(text, weights=w.sizes, minlength=texts)
    best = mass.argmax(axis=1)
    share = mass[np.arange(texts), best] / np.maximum(letters, 1)
    score = share / (1 + np.exp(-np.minimum(lead, 30)))
    foreign = mass.sum(axis=1) == 0
    none = letters == 0 if closed else foreign
    return [UNKNOWN if u else model.languages[b] for b, u in zip(best, none, strict=True)], np.where(foreign, 0.0, score).tolist()


def _predicted(model, batch):
    for chunk in text_chunks(batch, limit=1 << 19):
        lang, score = identify(model, chunk["text"], closed=True)
        held = [None if i is None else zlib.crc32(str(i).encode()) % 4 == 2 for i in chunk["doc_id"].to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [chunk["doc_id"], pa.array(held, pa.bool_()), pa.array(lang), pa.array(score, pa.float64())],
            ["doc_id", "held_out", "lang_pred", "score"],
        )


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for every row of docs."""
    return arrow_map(
        only(docs, "doc_id", "text"), "doc_id long, held_out boolean, lang_pred string, score double", partial(_predicted, train(docs))
    )


def _keep(model, column, batch):
    for chunk in text_chunks(batch, limit=1 << 19):
        lang, _ = identify(model, chunk[column], closed=True)
        yield chunk.filter(pa.array([x != UNKNOWN for x in lang]))


def with_language(docs: DataFrame) -> DataFrame:
    """The rows of docs whose text is in a language, that is those that ``languages`` does not call ``und``.

    Null, empty and letterless texts go, and so does every row when nothing could be learned;
    repeated rows and rows that share a doc_id are judged each by itself; columns are kept as
    they are, whatever their names; an empty table gives an empty table.
    """
    return arrow_map(docs, docs.schema, partial(_keep, train(docs), "text"))
