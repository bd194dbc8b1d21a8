"""What a task takes is bounded, however large the tables and whatever their row groups."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.plans import queries
from docsieve.sources import corrupt as CO
from docsieve.sources.seeds import TASK_RECORDS, seeds


def test_corpora_are_made_in_tasks_of_bounded_size(spark):
    assert CO.corpus(spark, [], 1_000, [0.0, 1.0], ["synonym"]).rdd.getNumPartitions() >= 24_000 / TASK_RECORDS
    assert seeds(spark, "invoice", 20_000).rdd.getNumPartitions() >= 20_000 / TASK_RECORDS


def test_grouped_words_match_as_plain_ones(spark):
    words = ["To:", "Total due:", "Total:", "T", "[x]", "é.", "]-"]
    plain = "|".join(rf"\Q{w}\E" for w in sorted(words, key=len, reverse=True))
    rows = spark.createDataFrame([("Total due: Total: To: é. é- T [x] x] ]-Total",), ("",), ("no",), (None,)], "t string")
    new, old = (F.regexp_extract_all("t", F.lit(p), F.lit(0)) for p in (CO.any_of(words), plain))
    assert rows.filter(~new.eqNullSafe(old)).count() == 0
    assert rows.select(F.size(new)).first()[0] == 8


@pytest.mark.parametrize("name", ["prepass_invoice", "line_items", "resolve_overlaps", "unresolved_fields", "list_partial_credit", "record_f1", "extract_money", "gate_steps"])
def test_queries_over_orders_have_tasks_of_bounded_size(spark, sf, name, monkeypatch):
    monkeypatch.setattr(queries, "TASK_ROWS", 20, raising=False)
    rows = spark.read.parquet(f"{sf}/orders.parquet").count()
    assert queries.QUERIES[name](spark, sf).rdd.getNumPartitions() >= rows / 100
