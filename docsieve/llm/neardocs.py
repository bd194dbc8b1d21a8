"""Near-duplicate documents by their sets of word shingles (the pipeline's near-dedup).

Documents are near when the Jaccard similarity of their sets of shingles of ``WIDTH``
words (A-Z lower-cased; a shorter text is one shingle) is at least ``THRESHOLD``.  At 0.8
two fingerprints of operator 4 are ten bits apart on average and up to about twenty, where
no partition of 64 bits is selective any more, so its links are completed by MinHash:

1. equal sets are one node from the start, with operator 4's fingerprint of its shingles;
   fingerprints at two or fewer differing bits meet by the generalised pigeonhole principle
   (``simhash.alike``), none left out;
2. nodes with the same value of a band meet too: ``BANDS * ROWS`` independent minima a set,
   of which a pair at 0.8 shares no whole band with a chance of 3 in 100,000;
3. every node of a value is compared with the least one there, exactly;
4. where that leaves a value with more than one component, all its nodes of different
   components are compared, up to ``SMALL`` at a time; more are cut into groups of half that
   size of which every two are compared, so no pair is left out and no task is large;
5. distributed union-find over the verified pairs.

A component keeps the row that comes first by (doc_id, hash of the text), null doc_ids
last.

Defined results: null, empty and blank texts have equal sets; repeated rows are one; an
empty table gives an empty table; other columns keep their values.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import arrow_map, first_rows, mix64, only, staged, text_chunks, text_hash, utf8, word_hashes
from .components import components
from .sharing import shared_rows

WIDTH = 5
THRESHOLD = 0.8
BANDS, ROWS = 20, 4
SMALL = 400
_P = np.uint64(0x9E3779B97F4A7C15)
_N = np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)
_XOR, _ODD = mix64(_N), mix64(_N + np.uint64(1 << 32)) | np.uint64(1)


def shingle_sets(column: pa.Array) -> list[np.ndarray]:
    """The sorted different shingle hashes of each text."""
    data, offsets = utf8(column)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    _, _, h, first = word_hashes(data, offsets)
    g = np.zeros(max(len(h) - WIDTH + 1, 0), np.uint64)
    for j in range(WIDTH):
        g = g * _P + h[j : len(h) - WIDTH + 1 + j] if len(g) else g
    g = mix64(g)
    out = []
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        if b - a >= WIDTH:
            out.append(np.unique(g[a : b - WIDTH + 1]))
        else:
            short = np.full(1, b - a, np.uint64)
            for x in h[a:b]:
                short = short * _P + x
            out.append(mix64(short))
    return out


def band_values(shingles: np.ndarray) -> np.ndarray:
    """One value a band of a set."""
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for at in range(0, len(shingles), 2_048):
        part = shingles[at : at + 2_048, None] ^ _XOR
        part *= _ODD
        np.minimum(least, part.min(axis=0), out=least)
    value = np.arange(1, BANDS + 1, dtype=np.uint64)
    for r in range(ROWS):
        value = mix64(value * _P + least.reshape(BANDS, ROWS)[:, r])
    return value


def _node(shingles: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(shingles.tobytes(), 42)


def _marked(batch: pa.RecordBatch):
    for chunk in text_chunks(batch, limit=1 << 18):
        sets = shingle_sets(chunk["text"])
        node = np.array([_node(s) for s in sets], np.uint64).view(np.int64)
        bands = [band_values(s).tobytes() for s in sets]
        fp = simhash.text_fingerprints(chunk["text"], WIDTH, once=True)
        columns = {"doc_id": chunk["doc_id"], "row": chunk["row"], "node": pa.array(node), "bands": pa.array(bands, pa.binary()), "fp": fp}
        yield pa.RecordBatch.from_arrays([*columns.values()], [*columns])


def _banded(batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 20_000):
        part = batch.slice(at, 20_000)
        node = np.ascontiguousarray(part["node"].to_numpy(zero_copy_only=False)).view(np.uint64)
        yield np.frombuffer(b"".join(part["bands"].to_pylist()), np.uint64), np.repeat(node, BANDS)


def _known(batch: pa.RecordBatch):
    for chunk in text_chunks(batch, limit=1 << 18):
        sets = {_node(s): s for s in shingle_sets(chunk["text"])}
        node = np.fromiter(sets, np.uint64, len(sets)).view(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(node), pa.array([s.tobytes() for s in sets.values()], pa.binary())], ["node", "set"])


def near(p: np.ndarray, q: np.ndarray) -> bool:
    """Whether two sets are near; both are sorted."""
    if len(p) > len(q):
        p, q = q, p
    if len(p) < THRESHOLD * len(q) - 1e-9:
        return False
    both = int((q[np.minimum(np.searchsorted(q, p), len(q) - 1)] == p).sum())
    return both >= THRESHOLD * (len(p) + len(q) - both) - 1e-9


def _near_pairs(batch: pa.RecordBatch):
    keep = [near(*(np.frombuffer(c.as_py(), np.uint64) for c in pair)) for pair in zip(batch["p"], batch["q"], strict=True)]
    yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def join_bucket(root: list[int], sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Near pairs that join all components of the bucket that any near pair joins."""
    parent = {r: r for r in root}

    def top(r: int) -> int:
        while parent[r] != r:
            r = parent[r]
        return r

    found = []
    for i in range(len(sets)):
        for j in range(i):
            a, b = top(root[i]), top(root[j])
            if a != b and near(sets[i], sets[j]):
                parent[max(a, b)] = min(a, b)
                found.append((i, j))
    return found


def _join_buckets(batch: pa.RecordBatch):
    for cell in batch["bucket"]:
        rows = cell.as_py()
        found = join_bucket([r["root"] for r in rows], [np.frombuffer(r["set"], np.uint64) for r in rows])
        if found:
            ends = ([rows[x[k]]["node"] for x in found] for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ends], ["a", "b"])


def _linked(marked: DataFrame) -> DataFrame:
    """(value, node): nodes whose fingerprints are at most two bits apart share a value."""
    nodes = staged(marked.select("fp", "node").distinct())
    equal = nodes.groupBy("fp").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.xxhash64("fp").alias("value"), "fp")
    return simhash.alike(nodes.select("fp").distinct()).union(equal).join(nodes, "fp").select("value", "node")


def near_documents(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """doc_id, row (hash of the text), root of every row of docs; near rows have the same root."""
    text = only(docs, "doc_id", "text").withColumn("row", text_hash())
    marked = staged(arrow_map(text, "doc_id long, row long, node long, bands binary, fp long", _marked))
    met = staged(shared_rows(marked.select("node", "bands"), _banded).union(_linked(marked)).distinct())
    wanted = marked.select("node", "row").join(met.select("node").distinct(), "node").groupBy("node").agg(F.min("row").alias("row"))
    texts = text.select("row", "text").join(wanted.select("row").distinct(), "row")
    known = staged(arrow_map(texts.select("text"), "node long, set binary", _known).groupBy("node").agg(F.min("set").alias("set")))

    least = met.groupBy("value").agg(F.min("node").alias("b"))
    pairs = met.join(least, "value").filter("node <> b").select(F.col("node").alias("a"), "b").distinct()
    pairs = pairs.join(known.withColumnsRenamed({"node": "a", "set": "p"}), "a").join(known.withColumnsRenamed({"node": "b", "set": "q"}), "b")
    stars = staged(arrow_map(pairs.select("a", "b", "p", "q"), "a long, b long", _near_pairs))
    rooted = met.join(components(stars), "node", "left").select("value", "node", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted)
    mixed = rooted.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("low"), F.max("root").alias("high")).filter("low <> high")
    groups = F.when(F.col("n") > small, F.ceil(F.col("n") / (small // 2))).otherwise(1).cast("int")
    sized = rooted.join(mixed.select("value", groups.alias("groups")), "value")
    own = F.pmod(F.xxhash64("node", "value"), F.col("groups")).cast("int")
    other = F.when(F.col("groups") == 1, F.array(F.lit(0))).otherwise(F.array_remove(F.sequence(F.lit(0), F.col("groups") - 1), own))
    dealt = sized.withColumn("own", own).withColumn("other", F.explode(other))
    dealt = dealt.select("node", "root", F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"))
    sets = dealt.groupBy("bucket").agg(F.array_sort(F.collect_list(F.struct("node", "root"))).alias("nodes")).filter(F.size("nodes") > 1).select("nodes").distinct()
    named = sets.select(F.xxhash64("nodes").alias("id"), F.inline("nodes"))
    full = named.join(known, "node").groupBy("id").agg(F.collect_list(F.struct("node", "root", "set")).alias("bucket"))
    more = arrow_map(full.select("bucket"), "a long, b long", _join_buckets)
    found = components(stars.union(more))
    return marked.select("doc_id", "row", "node").join(found, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("root"))


def one_of_each(docs: DataFrame, small: int = SMALL) -> DataFrame:
    """Of every component of near documents one row: that with the least (doc_id, hash of the text), null doc_ids last.

    Of rows equal in doc_id and text one stays; null, empty and blank texts are near each other;
    other columns keep their values; an empty table gives an empty table.
    """
    return first_rows(docs, near_documents(docs, small).groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n")))
