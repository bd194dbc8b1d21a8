"""Substring dedup with repeated-phrase automata (operator 6).

A window is 13 consecutive words of a document.  A word goes if a window covers it whose
word sequence also begins in a document with a smaller doc_id.

1. Candidates: a window's anchor is the least hash of the 5-word phrases in it, so equal
   windows have equal anchors, at about a fifth of the windows.  Anchors that two different
   texts share are found with one packed shuffle (``sharing.shared_rows``).
2. Stretches: only text around shared anchors travels on.  The windows in it that two
   documents have are the recurring phrases; the smallest doc_id is the owner.
3. Automata: stretches are dealt out by anchor to so many shards that a shard is small, in
   packed and compressed cells.  A shard has every occurrence of its phrases: it confirms
   them, compiles them, a few symbols a word, into an Aho-Corasick automaton, and streams its
   stretches through it.  Every occurrence in a document other than the owner is a hit.
   Anchors in very many texts are salted over tasks: their phrases are confirmed with a
   grouped minimum and maximum, and each salt compiles the anchor's automaton for its own
   part of the stretches.
Equal texts are one text in steps 1 to 3; all but the smallest doc_id of them lose every
window.

Defined results: null and empty texts have no words; texts under 13 words lose nothing;
rows that repeat a doc_id are judged against other doc_ids only; a null doc_id is compared
with nothing; an empty table gives an
empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import partial

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, mix64, only, staged, text_chunks, utf8, word_hashes
from .sharing import shared_rows

WINDOW = 13
PHRASE = 5
#: Stretches that a shard holds at about, and texts from which on an anchor is salted.
STRETCHES = 40_000
HOT = 1_500
#: Symbols of a place, and places of a word at first: three make strings of one byte a symbol and 614,124 words.
BASE, PLACES = 85, 3
_P = np.uint64(0x9E3779B97F4A7C15)


def anchors(hashes: np.ndarray, first: np.ndarray, window: int = WINDOW, phrase: int = PHRASE) -> tuple[np.ndarray, np.ndarray]:
    """The anchor at every word position, and whether a window of its text begins there."""
    n = len(hashes)
    if n < window:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    g = np.zeros(n - phrase + 1, np.uint64)
    for j in range(phrase):
        g = g * _P + hashes[j : n - phrase + 1 + j]
    least, span, want = mix64(g), 1, window - phrase + 1
    while span < want:  # doubling: the minimum over ``span`` phrases
        step = min(span, want - span)
        least = np.minimum(least[: len(least) - step], least[step:])
        span += step
    out, begins = np.zeros(n, np.uint64), np.zeros(n, bool)
    out[: len(least)] = least
    ends = np.repeat(first[1:], np.diff(first))
    begins[: len(least)] = np.arange(len(least)) + window <= ends[: len(least)]
    return out, begins


def _anchor_rows(window: int, batch: pa.RecordBatch):
    for chunk in text_chunks(batch):
        data, offsets = utf8(chunk["text"])
        _, _, hashes, first = word_hashes(data, offsets)
        raw = data.tobytes()
        node = np.fromiter((xxhash.xxh64_intdigest(raw[a:b], 42) for a, b in zip(offsets[:-1], offsets[1:], strict=True)), np.uint64, chunk.num_rows)
        value, begins = anchors(hashes, first, window)
        new = begins.copy()
        new[1:] &= (value[1:] != value[:-1]) | ~begins[:-1]
        yield value[new], np.repeat(node, np.diff(first))[new]


def _pack_text(batch: pa.RecordBatch):
    """doc_id, the text's hash and the text compressed, which halves what a join shuffles."""
    squeeze = zstandard.ZstdCompressor(level=1).compress
    for chunk in text_chunks(batch):
        texts = [(t.as_py() or "").encode() for t in chunk["text"]]
        row = np.fromiter((xxhash.xxh64_intdigest(t, 42) for t in texts), np.uint64, len(texts)).view(np.int64)
        yield pa.RecordBatch.from_arrays(
            [chunk["doc_id"], pa.array(row), pa.array([squeeze(t) for t in texts], pa.binary())], ["doc_id", "row", "packed"]
        )


def _unpack_text(cell: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(cell)


def _pack(rows: list[tuple[int, int, int, str]]) -> bytes:
    doc, row, begin, words = zip(*rows, strict=True)
    head = np.array([[len(rows)] * len(rows), doc, row, begin], "<i8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + "\n".join(words).encode())


def _unpack(cell: bytes) -> list[tuple[int, int, int, str]]:
    raw = _unpack_text(cell)
    n = int(np.frombuffer(raw[:8], "<i8")[0])
    head = np.frombuffer(raw[: 32 * n], "<i8").reshape(4, n)[1:]
    return list(zip(*head.tolist(), raw[32 * n :].decode().split("\n"), strict=True))


def _stretches(window: int, shards: int, batch: pa.RecordBatch):
    """The text around every run of windows with one shared anchor, packed by where it goes."""
    goes: dict[tuple[int, int, bool], list] = {}
    held = 0

    def flush():
        keys = list(goes)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array([k[0] for k in keys], pa.int64()),
                pa.array([k[1] for k in keys], pa.int32()),
                pa.array([k[2] for k in keys], pa.bool_()),
                pa.array([_pack(goes[k]) for k in keys], pa.binary()),
            ],
            ["part", "salt", "hot", "rows"],
        )
        goes.clear()
        return out

    for doc_id, row, packed, shared, hot in zip(*(batch[c] for c in ("doc_id", "row", "packed", "anchors", "hot")), strict=True):
        doc, of = doc_id.as_py(), row.as_py()
        raw = _unpack_text(packed.as_py())
        starts, ends, hashes, first = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        value, begins = anchors(hashes, first, window)
        known = np.sort(np.array(shared.as_py(), np.int64).view(np.uint64))
        salts = {h["value"]: h["salts"] for h in hot.as_py()}
        place = np.minimum(np.searchsorted(known, value), len(known) - 1)
        hit = begins & (known[place] == value)
        new = hit.copy()
        new[1:] &= ~hit[:-1] | (value[1:] != value[:-1])
        last = hit.copy()
        last[:-1] &= ~hit[1:] | new[1:]
        for a, b in zip(np.flatnonzero(new).tolist(), np.flatnonzero(last).tolist(), strict=True):
            anchor = int(value[a].view(np.int64))
            if anchor in salts:
                key = (anchor, (doc * 31 + a) % salts[anchor], True)
            else:
                key = (int(value[a] % np.uint64(shards)), 0, False)
            words = b" ".join(raw[starts[a] : ends[b + window - 1]].split()).decode()
            goes.setdefault(key, []).append((doc, of, a, words))
            held += len(words)
        if held > 16 << 20:
            held = 0
            yield flush()
    if goes:
        yield flush()


def _windows(words: str, window: int) -> Iterator[str]:
    """One at a time, so that of a long periodic text only the different ones are held."""
    w = words.split(" ")
    for i in range(len(w) - window + 1):
        yield " ".join(w[i : i + window])


def _seen(window: int, rows, seen: dict[str, list[int]]) -> None:
    """Least and greatest doc_id of every window of the rows."""
    for doc, _, _, words in rows:
        for p in _windows(words, window):
            if (v := seen.get(p)) is None:
                seen[p] = [doc, doc]
            elif doc < v[0]:
                v[0] = doc
            elif doc > v[1]:
                v[1] = doc


def _phrases(window: int, batch: pa.RecordBatch):
    """(part, phrase, least doc_id, greatest doc_id) of packed stretches of hot anchors."""
    for part, cell in zip(batch["part"].to_pylist(), batch["rows"], strict=True):
        seen: dict[str, list[int]] = {}
        _seen(window, _unpack(cell.as_py()), seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([part] * len(seen), pa.int64()), pa.array(list(seen), pa.string()), *(pa.array([v[i] for v in seen.values()], pa.int64()) for i in (0, 1))],
            ["part", "phrase", "low", "high"],
        )


class Coder(dict):
    """Words as strings of ``places`` symbols; a new word gets the next number.

    A node of the automaton is searched child by child, so words as single symbols make its
    root slow.  The symbols of different places differ, so that only whole words match.
    """

    def __init__(self, places: int):
        super().__init__()
        self.places = places

    def number(self, n: int) -> str:
        out = ""
        for place in range(self.places):
            n, digit = divmod(n, BASE)
            out = chr(place * BASE + digit) + out
        if n:
            raise OverflowError(f"{self.places} places are too few")
        return out

    def __missing__(self, word: str) -> str:
        self[word] = out = self.number(len(self) + 1)
        return out

    def encode(self, words: str) -> str:
        return "".join([self[w] for w in words.split(" ")])


def with_places(run: Callable[[Coder], pd.DataFrame]) -> pd.DataFrame:
    """run with as many places as its words need."""
    places = PLACES
    while True:
        coder = Coder(places)
        try:
            return run(coder)
        except OverflowError:
            if len(coder) < BASE**places - 1:  # not for want of numbers
                raise
        places += 1


def compile_automaton(owners: dict[str, int]) -> ahocorasick.Automaton:
    """Keys are encoded phrases; the automaton's values are their owners."""
    automaton = ahocorasick.Automaton()
    for phrase, owner in owners.items():
        automaton.add_word(phrase, owner)
    automaton.make_automaton()
    return automaton


def locate(window: int, places: int, owners: dict[str, int], rows) -> pd.DataFrame:
    """Word ranges of the occurrences outside of their owners, merged inside a stretch; all text is encoded."""
    out: list[tuple[int, int, int, int]] = []
    if owners:
        automaton = compile_automaton(owners)
        for doc, row, begin, code in rows:
            start = end = -1
            for last, owner in automaton.iter(code):
                if owner < doc:
                    upto = begin + (last + 1) // places
                    if upto - window > end:
                        if end >= 0:
                            out.append((doc, row, start, end))
                        start = upto - window
                    end = upto
            if end >= 0:
                out.append((doc, row, start, end))
    return pd.DataFrame(out, columns=["doc_id", "row", "start", "end"], dtype=np.int64)


def confirmed(window: int, places: int, rows: list[tuple[int, int, int, str]]) -> dict[str, int]:
    """The owners of the encoded windows that two documents have."""
    seen: dict[str, list[int]] = {}
    size = window * places
    for doc, _, _, code in rows:
        for at in range(0, len(code) - size + 1, places):
            p = code[at : at + size]
            if (v := seen.get(p)) is None:
                seen[p] = [doc, doc]
            elif doc < v[0]:
                v[0] = doc
            elif doc > v[1]:
                v[1] = doc
    return {p: v[0] for p, v in seen.items() if v[0] < v[1]}


def _shard(window: int, cells: pd.DataFrame) -> pd.DataFrame:
    def run(coder: Coder) -> pd.DataFrame:
        rows = [(doc, row, begin, coder.encode(words)) for cell in cells["rows"] for doc, row, begin, words in _unpack(cell)]
        return locate(window, coder.places, confirmed(window, coder.places, rows), rows)

    return with_places(run)


def _salted(window: int, phrases: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
    def run(coder: Coder) -> pd.DataFrame:
        owners = {coder.encode(p): owner for p, owner in zip(phrases["phrase"], phrases["owner"], strict=True)}
        other = coder.number(0)  # of a word that is in no phrase
        texts = ((doc, row, begin, words.split(" ")) for cell in cells["rows"] for doc, row, begin, words in _unpack(cell))
        return locate(window, coder.places, owners, ((doc, row, begin, "".join([coder.get(w, other) for w in words])) for doc, row, begin, words in texts))

    return with_places(run)


def removals(docs: DataFrame, window: int = WINDOW, stretches: int = STRETCHES, hot: int = HOT) -> DataFrame:
    """(doc_id, row, whole, ranges) of every document that loses words.

    row is the text's hash; whole says that an equal text has a smaller doc_id; ranges are
    word ranges to remove.
    """
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    d = only(docs, "doc_id", "text").select("doc_id", text.alias("text")).filter("doc_id is not null")
    ids = staged(d.select("doc_id", F.xxhash64("text").alias("row"), F.xxhash64(F.lit("check"), "text").alias("check")))
    # a table of its own, so that a large group of copies can be split over tasks
    least = staged(ids.groupBy("row", "check").agg(F.min("doc_id").alias("least")))
    shared = staged(shared_rows(d, partial(_anchor_rows, window)).distinct())
    many = shared.groupBy("value").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > hot)
    many = many.select("value", F.ceil(F.col("n") / (hot / 2)).cast("int").alias("salts"))
    lists = shared.join(many, "value", "left").groupBy(F.col("node").alias("row")).agg(
        F.collect_list("value").alias("anchors"),
        F.collect_list(F.when(F.col("salts").isNotNull(), F.struct("value", "salts"))).alias("hot"),
    )
    chosen = lists.join(least, "row").select(F.col("least").alias("doc_id"), "row", "anchors", "hot")
    packed = arrow_map(d, "doc_id long, row long, packed binary", _pack_text)
    kept = packed.join(chosen, ["doc_id", "row"]).select("doc_id", "row", "packed", "anchors", "hot")
    shards = max(4 * parts, shared.count() // stretches)
    cells = staged(arrow_map(kept, "part long, salt int, hot boolean, rows binary", partial(_stretches, window, shards)))
    hits = cells.filter("not hot").groupBy("part").applyInPandas(partial(_shard, window), "doc_id long, row long, start long, end long")
    warm = cells.filter("hot")
    phrases = warm.transform(lambda x: arrow_map(x, "part long, phrase string, low long, high long", partial(_phrases, window)))
    phrases = phrases.groupBy("part", "phrase").agg(F.min("low").alias("owner"), F.max("high").alias("high")).filter("owner < high")
    left = phrases.select("part", "phrase", "owner").join(warm.select("part", "salt").distinct(), "part")
    hits = hits.union(
        left.groupBy("part", "salt").cogroup(warm.select("part", "salt", "rows").groupBy("part", "salt"))
        .applyInPandas(partial(_salted, window), "doc_id long, row long, start long, end long")
    )
    ranges = hits.groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))
    copies = ids.join(least, ["row", "check"]).filter("least < doc_id").select("doc_id", "row").distinct()
    return copies.withColumn("whole", F.lit(True)).join(ranges, ["doc_id", "row"], "full").select(
        "doc_id", "row", F.coalesce("whole", F.lit(False)).alias("whole"), "ranges"
    )


def kept_words(text: bytes, whole: bool, ranges: list[dict] | None, window: int = WINDOW) -> tuple[list[bytes], int]:
    """The words that stay, and how many there were."""
    words = text.split()
    if whole and len(words) >= window:
        return [], len(words)
    if not ranges:
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for r in ranges:
        gone[r["start"]] += 1
        gone[r["end"]] -= 1
    stays = np.cumsum(gone)[:-1] == 0
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s], len(words)


def _report(batch: pa.RecordBatch) -> pa.RecordBatch:
    rows = []
    for doc_id, packed, whole, ranges in zip(batch["doc_id"].to_pylist(), batch["packed"], batch["whole"].to_pylist(), batch["ranges"], strict=True):
        kept, n = kept_words(_unpack_text(packed.as_py()), bool(whole), ranges.as_py())
        rows.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
    kinds = [pa.int64()] * 3 + [pa.string()]
    names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row of docs."""
    d = arrow_map(only(docs, "doc_id", "text"), "doc_id long, row long, packed binary", _pack_text)
    joined = d.join(removals(docs), ["doc_id", "row"], "left").select("doc_id", "packed", "whole", "ranges")
    return arrow_map(joined, "doc_id long, n_words long, n_removed long, kept_sha256 string", _report)
