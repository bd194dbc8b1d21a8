"""The pipeline's near-dedup against all pairs by brute force."""

from __future__ import annotations

import random

import numpy as np
from llm_texts import sentence

from docsieve.llm import neardocs


def jaccard(p, q):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (p.lower().split(), q.lower().split()))
    return len(a & b) / len(a | b)


def test_near_documents_join_at_their_similarity(spark):
    rng = random.Random(11)
    rows, i = [], 0
    for _ in range(40):
        base = sentence(rng, rng.choice([12, 80, 300])).split()
        for _ in range(5):  # words edited, lines broken anew
            at = set(rng.sample(range(len(base)), rng.randrange(1, 2 + len(base) // 40)))
            words = ["edit" + str(rng.randrange(99)) if k in at else w for k, w in enumerate(base)]
            rows.append((i, "".join(w + rng.choice(" \n ") for w in words)))
            i += 1
    rows += [(i, None), (i + 1, " \n"), (i + 2, "Two words"), (i + 3, "two WORDS"), (i + 4, "other")]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if jaccard(rows[a][1] or "", rows[b][1] or "") >= 0.8]
    parent = list(range(len(rows)))

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        parent[max(a, b)] = min(a, b)
    want = sorted({top(x) for x in range(len(rows))})
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(r.doc_id for r in neardocs.one_of_each(df, small=4).collect())
    assert len(pairs) > 30 and got == want


def test_bands_reach_the_threshold():
    rng = np.random.default_rng(1)
    for n in (9, 90, 900):
        missed = 0
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n + n // 9, dtype=np.uint64)
            p, q = x[:n], x[n // 9 :]
            missed += not (neardocs.band_values(p) == neardocs.band_values(q)).any()
            assert neardocs.near(np.sort(p), np.sort(q)) == ((n - n // 9) / len(x) >= 0.8)
        assert missed == 0
