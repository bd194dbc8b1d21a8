"""Training rows of small languages in large tables."""

from __future__ import annotations

import random

import pyarrow as pa
import pytest

from docsieve.llm import langid


def test_a_small_language_is_learned_in_a_large_table(spark):
    rng = random.Random(4)
    make = {"xx": "abcd", "yy": "wxyz", "ru": "абвг"}
    text = lambda k: " ".join("".join(rng.choice(make[k]) for _ in range(5)) for _ in range(8))
    rows = [(i, text(k), k) for i, k in enumerate(["xx", "yy"] * 4000 + ["ru"] * 5)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), rows=40)
    assert langid.identify(model, pa.array([text("ru"), text("xx"), text("yy")]))[0] == ["ru", "xx", "yy"]


def test_rows_each_fills_the_sum():
    assert langid.rows_each([5, 100, 100], 45, 0) == 20 and langid.rows_each([5, 6], 100, 0) == 6
    assert langid.rows_each([10, 10, 10], 30, 0) == pytest.approx(10) and langid.rows_each([10**6], 12_000) == 12_000
    assert langid.rows_each([10**6] * 1000, 12_000) == langid.LEAST_ROWS
