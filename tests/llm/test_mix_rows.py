"""Rows that share a doc_id, or have none, keep their place in the mix."""

from __future__ import annotations

import random
from collections import Counter

from llm_texts import sentence

from docsieve.llm import mixing


def test_every_row_is_in_the_mix(spark):
    rng = random.Random(9)
    rows = [(i, sentence(rng, 20), "en", "ab"[i % 2]) for i in range(200)]
    rows += [(None, sentence(rng, 20), "en", "a") for _ in range(100)] + [(7, sentence(rng, 20), "en", "b") for _ in range(5)]
    rows += [(900, "the same five words here", lang, "b") for lang in ("en", "en", "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    plan = mixing.mix(df).toPandas()
    assert len(plan.drop_duplicates(["doc_id", "row", "copy"])) == len(rows)
    got = mixing.taken_words(df).toPandas()
    words = Counter()
    for _, text, _, source in rows:
        words[source] += len(text.split())
    assert len(got) == len(rows) - 2 and set(got.source_size) == set(words.values()) and got["size"].sum() == sum(words.values())
    targets = plan.groupby("source").target.first()
    out = Counter()
    for r in mixing.mixed_documents(df).collect():
        out[r.source] += len(r.text.split())
    assert all(abs(out[s] - targets[s]) <= 1 for s in words)
    every = mixing.mixed_documents(df, share=2.0, most=2.0).filter("doc_id = 900").collect()
    assert sorted(r.lang for r in every) == ["de", "de", "en", "en", "en", "en"]
