"""The mix comes through its shards."""

from __future__ import annotations

import random
from collections import Counter, defaultdict

import pytest
from llm_texts import sentence
from pyspark.sql import functions as F

from docsieve.llm import mixing
from docsieve.llm.common import text_hash, word_count


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(12)
    rows = [(i, sentence(rng, rng.choice([5, 40, 120])), "en", "abc"[i % 3 if i % 2 else 0]) for i in range(600)]
    rows += [(7, rows[7][1], "en", rows[7][3]), (7, rows[7][1], "de", rows[7][3]), (None, rows[3][1], "en", None), (9, None, "en", "a")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_every_row_has_its_places(table):
    rows = mixing.mix_report(table).collect()
    assert len(rows) == table.count()
    positions = defaultdict(list)
    for r in rows:
        assert r.taken == sum(p.words for p in r.places) <= 2 * r["size"] and len(r.places) <= 2
        for p in r.places:
            positions[p.shard].append(p.position)
    assert all(sorted(p) == list(range(len(p))) for p in positions.values()) and len(positions) == 16


def test_shards_draw_disjoint_blocks_and_exact_quotas(table):
    sizes = table.select("doc_id", "source", text_hash().alias("row"), word_count(F.col("text")).alias("size"), F.monotonically_increasing_id().alias("copy"))
    _, _, placed = mixing.block_plan(sizes)
    rows = placed.collect()
    drawn = Counter((r.source, r.block, r["pass"]) for r in rows)
    assert set(drawn.values()) == {1}
    quotas = {(r.source, r.shard): r.blocks for r in mixing.split_quotas(placed.groupBy("source").agg(F.count("*").alias("blocks")), 4).collect()}
    assert Counter((r.source, r.shard) for r in rows) == quotas
    per = Counter(r.shard for r in rows)
    assert max(per.values()) - min(per.values()) <= 1


def test_other_draws_give_another_mix(table, monkeypatch):
    shown = lambda: sorted((r.doc_id or -1, r["size"], r.taken, str(r.places)) for r in mixing.mix_report(table).collect())
    first = shown()
    assert shown() == first
    monkeypatch.setattr(mixing, "SEED", 4711)
    assert shown() != first


def test_documents_are_laid_out_by_shard(table):
    plan = {}
    for r in mixing.mix_report(table).collect():
        for p in r.places:
            plan.setdefault((r.doc_id, r["size"], p.words), []).append((p.shard, p.position))
    parts = mixing.mixed_documents(table).rdd.glom().collect()
    assert sum(map(len, parts)) == sum(map(len, plan.values()))
    for part in parts:  # a document's words are as many as it was taken for, and its places ascend
        at = [min(plan[key]) for r in part if len(plan.get(key := (r.doc_id, len(r.text.split()), len(r.text.split())), ())) == 1]
        assert at == sorted(at)
