"""Nearest neighbours: leaves of a block against all rows, and the query's own parameters."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from docsieve.llm import ann
from docsieve.llm import queries as Q


def exact(x, ids, q, own, k):
    s = (x * q).sum(axis=1)
    order = [i for i in np.lexsort((ids, -s)) if ids[i] != own]
    return ids[order[:k]].tolist()


def test_a_block_whose_leaves_are_all_visited_is_searched_exactly():
    rng = np.random.default_rng(5)
    x, ids, leaf = rng.normal(size=(300, 8)), np.arange(300), rng.integers(0, 7, 300)
    x[40] = x[41]
    who, found, score = ann.search_block(x, ids, leaf, ids[:30], x[:30], [list(range(7))] * 30, 10)
    for i in range(30):
        assert found[who == i].tolist() == exact(x, ids, x[i], i, 10) and (np.diff(score[who == i]) <= 0).all()


def test_an_id_in_many_rows_counts_once():
    x = np.vstack([np.full((25, 2), 2.0), np.ones((3, 2))])
    ids = np.array([7] * 25 + [1, 2, 3])
    who, found, _ = ann.search_block(x, ids, np.zeros(28, int), np.array([1]), x[25:26], [[0]], 3)
    assert found.tolist() == [7, 2, 3] and set(who) == {0}


def test_only_visited_leaves_are_read():
    rng = np.random.default_rng(6)
    x, ids, leaf = rng.normal(size=(200, 4)), np.arange(200), np.arange(200) % 4
    who, found, _ = ann.search_block(x, ids, leaf, ids[:20], x[:20], [[1, 3]] * 20, 200)
    for i in range(20):
        assert set(found[who == i].tolist()) == {j for j in range(200) if j % 4 in (1, 3) and j != i}


def test_of_equal_vectors_the_smallest_ids_are_found():
    rng = np.random.default_rng(8)
    x = np.vstack([np.full((400, 3), 1.0), rng.normal(size=(50, 3))])
    ids = rng.permutation(450)
    assert len(ann.few_of_each(x, ids, 6)) == 56
    who, found, _ = ann.search_block(x, ids, np.zeros(450, int), ids[:40], x[:40], [[0]] * 40, 5)
    for i in range(40):
        assert found[who == i].tolist() == exact(x, ids, x[i], ids[i], 5)


def test_leaves_fill_blocks():
    b = ann.deal(np.array([5, 0, 3, 25, 4, 9]), 10)
    assert b.count.tolist() == [1, 0, 1, 3, 1, 1] and b.first[0] == b.first[2] == 0 and b.first[3] == 1 and b.first[4] == 4


@pytest.mark.parametrize("visits", [None, 10**6])
def test_recall_with_the_parameters_of_the_query(spark, visits):
    sf = "/root/testdata/sf0.01"
    t = spark.read.parquet(f"{sf}/embeddings.parquet")
    p = t.toPandas().sort_values("vec_id")
    x, ids = np.stack(p.embedding).astype(float), p.vec_id.to_numpy()
    got = (Q.op5_approximate_nearest_neighbours(spark, sf) if visits is None else ann.nearest(t, F.col("vec_id") % 20 == 0, visits=visits)).toPandas()
    queries = ids[ids % 20 == 0]
    hit = sum(len(set(exact(x, ids, x[ids == q][0], q, 20)) & set(got[got.query_id == q].vec_id)) for q in queries)
    assert hit / (20 * len(queries)) >= (0.9 if visits is None else 1)
