"""Rows delivered twice."""

from __future__ import annotations

from docsieve.llm import linededup, neardocs, simhash

TEXT = "the first line of this text\n\nanother line that is quite different"


def test_rows_delivered_twice_leave_once(spark):
    rows = [(1, TEXT, "a"), (1, TEXT, "a"), (1, TEXT, "b"), (2, "only here, once and for all", "a"), (3, None, "a"), (3, None, "a")]
    rows += [(None, "of no id but in two rows of it", "a")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted((r.doc_id or 0, r.n_lines, r.removed) for r in linededup.line_report(df).collect())
    assert got == [(0, 1, ""), (0, 1, "0"), (1, 3, ""), (1, 3, "0,2"), (1, 3, "0,2"), (2, 1, ""), (3, 1, ""), (3, 1, "")]
    kept = linededup.without_repeated_lines(df)
    assert kept.columns == df.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, rows[-1][1]), (1, TEXT), (2, rows[3][1]), (3, ""), (3, "")]
    for one in (neardocs.one_of_each, simhash.one_of_each):
        assert sorted(r.doc_id or 0 for r in one(df).collect()) == [0, 1, 2, 3]
