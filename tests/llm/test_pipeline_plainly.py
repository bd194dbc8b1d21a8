"""Every stage of the pipeline against a plain version, each on its own input."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from llm_texts import sentence
from tokenizers import Tokenizer

import corpus_pipeline
from docsieve.llm import linededup
from docsieve.llm.common import staged

NAMES = "doc_id long, text string, lang string, source string, n_chars long"


def top_of(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def joined(n, pairs):
    parent = list(range(n))
    for a, b in pairs:
        a, b = top_of(parent, a), top_of(parent, b)
        parent[max(a, b)] = min(a, b)
    return [top_of(parent, i) for i in range(n)]


def jaccard(p, q):
    return len(p & q) / len(p | q)


def lines_left(rows):
    """Documents without lines that are near an earlier one."""
    lines, at = [], []
    for d, (_, text) in enumerate(rows):
        for k, raw in enumerate((text or "").split("\n")):
            if line := raw.strip(" \t\x0b\x0c\r"):
                at.append((d, k))
                lines.append(line)
    grams = [{x[i : i + linededup.SHINGLE] for i in range(max(1, len(x) - linededup.SHINGLE + 1))} for x in lines]
    root = joined(len(lines), [(i, j) for i in range(len(lines)) for j in range(i) if jaccard(grams[i], grams[j]) >= 0.8])
    gone = {at[i] for i in range(len(lines)) if root[i] != i}
    out = []
    for d, (doc, text) in enumerate(rows):
        left = "\n".join(x for k, x in enumerate((text or "").split("\n")) if (d, k) not in gone)
        if left.strip() or (text or "") == left:
            out.append((doc, left))
    return out


def one_of_each(rows):
    words = [(t or "").lower().split() for _, t in rows]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in words]
    root = joined(len(rows), [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(sets[i], sets[j]) >= 0.8])
    return [r for i, r in enumerate(rows) if root[i] == i]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(21)
    rows, base = [], [sentence(rng, 80) for _ in range(6)]
    for i in range(60):
        kind = i % 6
        if kind == 0:
            text = "\n".join(sentence(rng, 12) for _ in range(4))
        elif kind == 1:  # near copies, lines broken anew
            w = base[i % 5].split()
            w[rng.randrange(len(w))] = "edited"
            text = " ".join(w[:40]) + f"\n{sentence(rng, 3)}\n" + " ".join(w[40:])
        elif kind == 2:
            text = base[5] + "\n" + sentence(rng, 6)
        elif kind == 3:
            text = " ".join(x + rng.choice([" ", "\n"]) for x in base[i % 5].split())
        else:
            text = ["123 !", None, sentence(rng, 150), "😀", sentence(rng, 9)][rng.randrange(5)]
        rows.append((i, text, rng.choice(["en", None]), rng.choice(["a", "b", None]), 1))
    return spark.createDataFrame(rows, NAMES)


def test_stages_do_what_plain_versions_do(spark, sf, corpus):
    stages = dict(corpus_pipeline.STAGES)
    plain = lambda df: sorted((r.doc_id, r.text) for r in df.collect())

    docs = staged(stages["language_id"](spark, corpus, sf))
    assert plain(docs) == sorted((i, t) for i, t in ((r.doc_id, r.text) for r in corpus.collect()) if t and any(c.isalpha() for c in t))

    before, docs = plain(docs), staged(stages["line_dedup"](spark, docs, sf))
    want = lines_left(before)
    assert len(set(plain(docs)) ^ set(want)) <= 2  # what banding may miss

    before, docs = plain(docs), staged(stages["near_dedup"](spark, docs, sf))
    assert plain(docs) == one_of_each(before)

    before, docs = docs.collect(), staged(stages["mix_sources"](spark, docs, sf))
    size, taken, times = Counter(), Counter(), defaultdict(list)
    for r in before:
        size[r.source] += len(r.text.split())
    for r in docs.collect():
        taken[r.source] += len(r.text.split())
        times[r.doc_id].append(r.text)
    text = {r.doc_id: r.text for r in before}
    for i, found in times.items():
        assert len(found) <= 2 and all(text[i].split()[: len(t.split())] == t.split() for t in found)
    order = sorted(size, key=lambda s: (s is None, s))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want, rest, total = {}, set(order), 1.5 * sum(size.values())
    while over := {s for s in rest if total * weight[s] / sum(weight[x] for x in rest) > 2 * size[s]}:
        want |= {s: 2 * size[s] for s in over}
        total -= sum(2 * size[s] for s in over)
        rest -= over
    want |= {s: total * weight[s] / sum(weight[x] for x in rest) for s in rest}
    assert all(abs(taken[s] - want[s]) <= 1 for s in order)

    mixed, packed = docs.collect(), stages["pack"](spark, docs, sf).toPandas()
    import public_tokenizers

    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    count = sum(len(tokens.encode(r.text, add_special_tokens=False).ids) + 1 for r in mixed)
    assert packed.length.sum() == count and (packed.groupby("sequence_id").length.sum() <= 2048).all()
    assert packed.sequence_id.nunique() == -(-count // 2048)
    for _, g in packed.sort_values("offset").groupby("sequence_id"):
        assert list(g.offset) == [0, *np.cumsum(g.length)[:-1]]
