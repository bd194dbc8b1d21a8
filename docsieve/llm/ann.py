"""Approximate nearest neighbours with a hierarchical k-means tree (operator 5).

* Fit: k-means splits a bounded sample (``SAMPLE`` rows in hash order) again and again, the
  most populous leaf first.  There are about as many leaves as the root of the number of rows,
  up to ``LEAVES``; the tree is at most LEAVES * 9 / 8 centres, so every task can hold it.
* Index: every row descends to its leaf.  Leaves, in tree order, fill blocks of up to ``BLOCK``
  rows, smaller ones where a table would not fill all tasks; a leaf with more rows is split over
  several blocks by hash.
* Search: a query walks the tree best bin first, with a priority queue of nodes by their
  centre's inner product, and the first ``visits`` leaves out of the queue are its leaves.
* Calibration: a bounded set of queries is compared with all rows, in blocks.  The visits
  are widened until ``RECALL`` of their true neighbours lie in the visited leaves.

A block's rows are sorted by leaf.  Each leaf is multiplied with the queries that visit it and
with no other; a block keeps the best k of each query, and the best of those are the answer.
Scores are inner products in double precision of the original vectors, summed in one order,
so equal vectors tie exactly.

Defined results: null, zero and non-finite vectors, vectors holding null, and vectors of
another dimension than the most common take no part, as queries or candidates; rows with
null vec_id take no part; rows that repeat a vec_id are one candidate (the best score)
and one query (its first vector in order); ties go to the smaller vec_id; fewer candidates than k give all of them; an
empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import heapq
from functools import partial
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, mix64, only, staged

#: Rows of the sample a leaf, and rows of the sample at least and at most.
SAMPLE_EACH, SAMPLE = 40, (20_000, 131_072)
#: Leaves at least and at most.
LEAVES = (64, 8_192)
BRANCHING = 8
BLOCK = 8_192
CALIBRATION = 64
RECALL = 0.97
K = 20


class Tree(NamedTuple):
    """Nodes in one array: centres, the first child and how many, and the leaf's number or -1."""

    centres: np.ndarray
    first: np.ndarray
    children: np.ndarray
    leaf: np.ndarray

    @property
    def leaves(self) -> int:
        return int(self.leaf.max()) + 1


def _means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> tuple[np.ndarray, np.ndarray]:
    centres = x[rng.choice(len(x), k, replace=False)]
    for _ in range(rounds):
        nearest = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
        for j in range(k):
            if (own := nearest == j).any():
                centres[j] = x[own].mean(axis=0)
    nearest = (x @ centres.T - (centres**2).sum(axis=1) / 2).argmax(axis=1)
    used = np.unique(nearest)
    return centres[used], np.searchsorted(used, nearest)


def fit(x: np.ndarray, leaves: int = LEAVES, branching: int = BRANCHING, seed: int = 7) -> Tree:
    """Split the most populous leaf until there are ``leaves`` or nothing splits."""
    rng = np.random.default_rng(seed)
    centres, first, count, rows = [x.mean(axis=0)], [0], [0], {0: np.arange(len(x))}
    while len(rows) + branching - 1 <= leaves:
        node = max(rows, key=lambda n: (len(rows[n]), -n))
        own = rows[node]
        if len(own) < 2 * branching:
            break
        means, nearest = _means(x[own], branching, rng)
        if len(means) < 2:  # equal vectors; a leaf for good
            rows[node] = own[:1]
            continue
        del rows[node]
        first[node], count[node] = len(centres), len(means)
        for j, c in enumerate(means):
            rows[len(centres)] = own[nearest == j]
            centres.append(c)
            first.append(0)
            count.append(0)
    leaf, numbered, stack = np.full(len(centres), -1), 0, [0]
    while stack:  # depth first, so leaves that are near in the tree have near numbers
        node = stack.pop()
        if count[node]:
            stack += range(first[node] + count[node] - 1, first[node] - 1, -1)
        else:
            leaf[node], numbered = numbered, numbered + 1
    return Tree(np.array(centres), np.array(first), np.array(count), leaf)


def descend(tree: Tree, x: np.ndarray) -> np.ndarray:
    """The leaf of each row: the nearest child all the way down."""
    at = np.zeros(len(x), np.int64)
    half = (tree.centres**2).sum(axis=1) / 2
    todo = np.arange(len(x)) if tree.children[0] else np.zeros(0, np.int64)
    while len(todo):
        order = np.argsort(at[todo], kind="stable")
        todo = todo[order]
        nodes, cuts = np.unique(at[todo], return_index=True)
        for node, rows in zip(nodes, np.split(todo, cuts[1:]), strict=True):
            c = slice(tree.first[node], tree.first[node] + tree.children[node])
            at[rows] = tree.first[node] + (x[rows] @ tree.centres[c].T - half[c]).argmax(axis=1)
        todo = todo[tree.children[at[todo]] > 0]
    return tree.leaf[at]


def best_bins(tree: Tree, q: np.ndarray, visits: int) -> np.ndarray:
    """The first ``visits`` leaves that best-bin-first traversal reaches, for each query."""
    score = q @ tree.centres.T
    out = np.full((len(q), min(visits, tree.leaves)), -1, np.int32)
    for i, s in enumerate(score):
        heap, n = [(-s[0], 0)], 0
        while heap and n < out.shape[1]:
            node = heapq.heappop(heap)[1]
            if tree.leaf[node] >= 0:
                out[i, n] = tree.leaf[node]
                n += 1
            else:
                for child in range(tree.first[node], tree.first[node] + tree.children[node]):
                    heapq.heappush(heap, (-s[child], child))
    return out


def _matrix(column: pa.Array, dtype=np.float64) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return flat.reshape(len(column), -1)


def top(q: np.ndarray, x: np.ndarray, ids: np.ndarray, own: int, k: int):
    """Best k rows for one query, by exact score and then id; every near tie is scored exactly."""
    rough = x @ q
    at = np.flatnonzero(ids != own)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0)
    if len(at) > k:
        edge = np.partition(rough[at], len(at) - k)[len(at) - k]
        at = at[rough[at] >= edge - 1e-9 * (1 + abs(edge)) * (1 + np.abs(q).sum())]
    exact = (x[at] * q).sum(axis=1)
    order = np.lexsort((ids[at], -exact))
    at, exact = at[order], exact[order]
    if len(at) > 1:  # rows that repeat an id
        _, seen = np.unique(ids[at], return_index=True)
        keep = np.sort(seen)
        at, exact = at[keep], exact[keep]
    return ids[at[:k]], exact[:k]


def _leaves(tree: Tree, batch: pa.RecordBatch):
    leaf = descend(tree, _matrix(batch["v"]))
    yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array(leaf, pa.int32())], ["vec_id", "v", "leaf"])


def _truth(ids: np.ndarray, q: np.ndarray, k: int, batch: pa.RecordBatch):
    """The best k of a batch for every calibration query, with their leaves."""
    x, own, leaf = _matrix(batch["v"]), batch["vec_id"].to_numpy(zero_copy_only=False), batch["leaf"].to_numpy(zero_copy_only=False)
    of = dict(zip(own.tolist(), leaf.tolist(), strict=True))
    rows = [(int(i), int(v), float(s), of[int(v)]) for i, one in zip(ids, q, strict=True) for v, s in zip(*top(one, x, own, i, k), strict=True)]
    c = list(zip(*rows, strict=True)) or [[], [], [], []]
    yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(c, (pa.int64(), pa.int64(), pa.float64(), pa.int32()), strict=True)], ["query_id", "vec_id", "score", "leaf"])


class Blocks(NamedTuple):
    """The blocks of each leaf: ``first`` and how many, 0 where a leaf has no row."""

    first: np.ndarray
    count: np.ndarray


def deal(rows: np.ndarray, block: int) -> Blocks:
    """Leaves with so many rows each fill blocks in order; one with more than a block has several to itself."""
    first, count = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    used, room = 0, block
    for leaf, n in enumerate(rows.tolist()):
        if n > block:
            count[leaf] = -(-n // block)
            first[leaf], used, room = used + 1, used + 1 + int(count[leaf]), block
        elif n:
            if n > room:
                used, room = used + 1, block
            first[leaf], count[leaf], room = used, 1, room - n
    return Blocks(first, count)


def _place(blocks: Blocks, batch: pa.RecordBatch):
    """Each row's block; rows of a leaf with several are dealt by a hash of the id."""
    leaf = batch["leaf"].to_numpy(zero_copy_only=False)
    hashed = mix64(np.ascontiguousarray(batch["vec_id"].to_numpy(zero_copy_only=False)).view(np.uint64))
    block = blocks.first[leaf] + (hashed % np.maximum(blocks.count[leaf], 1).astype(np.uint64)).astype(np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(block), batch["vec_id"], batch["v"], batch["leaf"]], ["block", "vec_id", "v", "leaf"])


def _visit(tree: Tree, visits: int, blocks: Blocks, batch: pa.RecordBatch):
    """A row for every query and block that holds a leaf of it."""
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        rows: list[dict[int, list[int]]] = [{} for _ in range(part.num_rows)]
        for want, leaves in zip(rows, best_bins(tree, _matrix(part["v"]), visits).tolist(), strict=True):
            for leaf in leaves:
                if leaf >= 0:
                    for b in range(blocks.first[leaf], blocks.first[leaf] + blocks.count[leaf]):
                        want.setdefault(b, []).append(leaf)
        pick = pa.array([i for i, want in enumerate(rows) for _ in want], pa.int64())
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([b for want in rows for b in want], pa.int64()),
                part["vec_id"].take(pick),
                part["v"].take(pick),
                pa.array([x for want in rows for x in want.values()], pa.list_(pa.int32())),
            ],
            ["block", "query_id", "q", "leaves"],
        )


def few_of_each(x: np.ndarray, ids: np.ndarray, few: int) -> np.ndarray:
    """The rows with the ``few`` smallest ids of every different vector; equal ones tie, so no others can be found."""
    whole = np.ascontiguousarray(x).view(np.dtype((np.void, x.dtype.itemsize * x.shape[1]))).ravel()
    _, vector = np.unique(whole, return_inverse=True)
    order = np.lexsort((ids, vector))
    rank = np.arange(len(ids)) - np.searchsorted(vector[order], vector[order])
    return np.sort(order[rank < few])


def search_block(x: np.ndarray, ids: np.ndarray, leaf: np.ndarray, own: np.ndarray, q: np.ndarray, leaves: list, k: int, held: int = 1 << 20):
    """(queries by place, found ids, scores) of one block: each of its leaves meets the queries that visit it.

    What a leaf's k-th best row leaves out, and every later leaf's, is not scored exactly;
    near ties are.  Best first, ties to the smaller id, an id once a query.
    """
    rows = k * int(np.unique(ids, return_counts=True)[1].max())  # so many rows hold k ids
    order = few_of_each(x, ids, rows + rows // k)  # one id more, since a query's own does not count
    order = order[np.argsort(leaf[order], kind="stable")]
    x, ids, leaf = x[order], ids[order], leaf[order]
    numbers, starts = np.unique(leaf, return_index=True)
    ends = dict(zip(numbers.tolist(), zip(starts.tolist(), [*starts[1:].tolist(), len(leaf)], strict=True), strict=True))
    visitors: dict[int, list[int]] = {}
    for i, wanted in enumerate(leaves):
        for one in wanted:
            if one in ends:
                visitors.setdefault(int(one), []).append(i)
    bar, slack = np.full(len(q), -np.inf), 1e-9 * (1 + np.abs(q).sum(axis=1))
    who, at = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for one, some in visitors.items():
        a, b = ends[one]
        step = max(1, held // (b - a))
        for first in range(0, len(some), step):
            these = np.array(some[first : first + step])
            rough = q[these] @ x[a:b].T
            rough[ids[a:b] == own[these, None]] = -np.inf
            if b - a > rows:
                bar[these] = np.maximum(bar[these], np.partition(rough, b - a - rows, axis=1)[:, b - a - rows])
            least = np.where(np.isfinite(bar[these]), bar[these] - slack[these] * (1 + np.abs(bar[these])), -np.inf)
            i, j = np.nonzero((rough >= least[:, None]) & np.isfinite(rough))
            who.append(these[i])
            at.append(a + j)
    who, at = np.concatenate(who), np.concatenate(at)
    score = np.concatenate([np.zeros(0), *((x[at[i : i + 50_000]] * q[who[i : i + 50_000]]).sum(axis=1) for i in range(0, len(at), 50_000))])
    found = ids[at]
    order = np.lexsort((-score, found, who))
    who, found, score = who[order], found[order], score[order]
    fresh = np.ones(len(who), bool)
    fresh[1:] = (who[1:] != who[:-1]) | (found[1:] != found[:-1])
    who, found, score = who[fresh], found[fresh], score[fresh]
    order = np.lexsort((found, -score, who))
    who, found, score = who[order], found[order], score[order]
    rank = np.arange(len(who)) - np.searchsorted(who, who)
    return who[rank < k], found[rank < k], score[rank < k]


def _search(k: int, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    if not (len(left) and len(right)):
        return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
    x, q = np.stack(left["v"]).astype(np.float64), np.stack(right["q"]).astype(np.float64)
    own = right["query_id"].to_numpy()
    who, found, score = search_block(x, left["vec_id"].to_numpy(), left["leaf"].to_numpy(), own, q, list(right["leaves"]), k)
    return pd.DataFrame({"query_id": own[who], "vec_id": found, "score": score})


def valid_vectors(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and v (floats or doubles as stored) of the rows that take part."""
    t = only(table, vec_id, embedding).toDF("vec_id", "v").filter("vec_id is not null and v is not null")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    t = t.filter(fine)
    common = t.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return t.filter(F.size("v") == (common[0]["n"] if common else 0))


def _best(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return once.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def sizes_for(n: int, tasks: int) -> tuple[int, int]:
    """Leaves (about the root of n) and rows a block (so many that n rows are a few blocks a task)."""
    leaves = min(max(1 << round(np.log2(max(n, 1)) / 2), LEAVES[0]), LEAVES[1])
    return leaves, int(min(max(n // (3 * tasks), 512), BLOCK))


def nearest(
    table: DataFrame, is_query: Column, k: int = K, recall: float = RECALL, leaves: int | None = None, block: int | None = None, visits: int | None = None
) -> DataFrame:
    """query_id, rank, vec_id, score for the rows of table (vec_id, embedding) where is_query holds.

    ``visits`` fixes how many leaves a query visits, without calibration.  The driver holds the
    sample, the tree, the calibration's neighbours and a count a leaf.
    """
    spark, out = table.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = staged(valid_vectors(table))
    fitting = sizes_for(rows.count(), int(spark.conf.get("spark.sql.shuffle.partitions")))
    leaves, block = leaves or fitting[0], block or fitting[1]
    size = min(max(SAMPLE_EACH * leaves, SAMPLE[0]), SAMPLE[1])
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(size).toArrow()
    if not len(sample):
        return spark.createDataFrame([], out)
    tree = fit(_matrix(sample["v"].combine_chunks()), leaves)
    kind = dict(rows.dtypes)["v"]
    indexed = staged(arrow_map(rows, f"vec_id long, v {kind}, leaf int", partial(_leaves, tree)))
    queries = indexed.filter(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    few = queries.orderBy(F.xxhash64(F.lit(1), "vec_id"), "vec_id").limit(CALIBRATION).toArrow()
    if not len(few):
        return spark.createDataFrame([], out)
    if visits is None:
        visits = calibrated(tree, indexed, few["vec_id"].to_numpy(), _matrix(few["v"].combine_chunks()), k, recall)
    counts = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():
        counts[r["leaf"]] = r["count"]
    blocks = deal(counts, block)
    left = arrow_map(indexed, f"block long, vec_id long, v {kind}, leaf int", partial(_place, blocks))
    right = arrow_map(queries, f"block long, query_id long, q {kind}, leaves array<int>", partial(_visit, tree, visits, blocks))
    found = left.groupBy("block").cogroup(right.groupBy("block")).applyInPandas(partial(_search, k), "query_id long, vec_id long, score double")
    return _best(found, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def calibrated(tree: Tree, indexed: DataFrame, ids: np.ndarray, q: np.ndarray, k: int, recall: float) -> int:
    """How many leaves hold that share of the true neighbours of a few queries."""
    truth = _best(arrow_map(indexed, "query_id long, vec_id long, score double, leaf int", partial(_truth, ids, q, k)).drop("leaf"), k)
    truth = truth.join(indexed.select("vec_id", "leaf"), "vec_id").select("query_id", "leaf").toPandas()
    order = dict(zip(ids.tolist(), best_bins(tree, q, tree.leaves), strict=True))
    place = np.sort([int(np.flatnonzero(order[i] == leaf)[0]) for i, leaf in zip(truth["query_id"], truth["leaf"], strict=True)])
    return int(place[int(np.ceil(recall * len(place))) - 1]) + 1 if len(place) else 1
