from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from docsieve.functions import extract as X
from docsieve.functions import text as T
from docsieve.functions import values as V


def run(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("x")).first().x


def values(spark, text, column):
    return [e.value for e in run(spark, text, column)]


DOC = "😀 INV-7, 2026-04-10 a@b.com, +1 (415) 555-2671 $1,234.50 €1.234,50 (1,234.50) 8.5 % see http://x.io)."


@pytest.mark.parametrize("column", [X.dates, X.emails, X.urls, X.phones, X.money, X.percentages, lambda t: X.identifiers(t, (r"\bINV-?\d+\b",))])
def test_spans_are_the_text_between_their_ends(spark, column):
    found = run(spark, DOC, column)
    assert found
    for e in found:
        assert DOC[e.start : e.end] == e.raw
    assert [e.start for e in found] == sorted(e.start for e in found)


def test_dates(spark):
    text = "2026-04-10 2026/04/10 04/10/2026 25/04/2026 April 10, 2026 10 April 2026 Apr 10 2026 Aug 3rd, 2026 2026-13-40"
    assert values(spark, text, X.dates) == ["2026-04-10"] * 3 + ["2026-04-25"] + ["2026-04-10"] * 3 + ["2026-08-03"]
    assert [e.confidence for e in run(spark, "04/10/2026 04/25/2026 25/04/2026", X.dates)] == [0.7, 1.0, 1.0]
    assert values(spark, "04/10/2026", lambda t: X.dates(t, dayfirst=True)) == ["2026-10-04"]


def test_money(spark):
    assert values(spark, "$1,234.50 €1.234,50 (1,234.50) USD 1234.50 9 1,234.50 USD 1234,50", X.money) == ["1234.50", "1234.50", "-1234.50", "1234.50", "1234.50", "1234.50"]
    assert values(spark, "count 2026, id 1001, qty 4; 1,23.50 $1,2345.50 8.25%", X.money) == []


def test_emails_urls_phones_percentages(spark):
    text = "Contact a@b.com, or see http://x.io. Then a@b.com. and (http://x.io) Call (415) 555-2671 now 8% 8.5 % 8,5%"
    assert values(spark, text, X.emails) == ["a@b.com"] * 2
    assert values(spark, text, X.urls) == ["http://x.io"] * 2
    assert values(spark, text, X.phones) == ["+14155552671"]
    assert values(spark, text, X.percentages) == ["8", "8.5", "8.5"]
    with pytest.raises(ValueError):
        X.phones(F.lit(""), region="XX")


def test_identifiers_keep_document_order(spark):
    found = values(spark, "claim CLM-88 and policy POL-12 then claim CLM-90", lambda t: X.identifiers(t, (r"CLM-\d+", r"POL-\d+")))
    assert found == ["CLM-88", "POL-12", "CLM-90"]


def test_overlaps_keep_longest_then_surest_then_first(spark):
    rows = [("a", 0, 10, "", "x", 1.0), ("b", 2, 5, "", "x", 1.0), ("c", 10, 12, "", "x", 0.5), ("d", 11, 13, "", "x", 0.9), ("e", 20, 22, "", "x", 1.0), ("f", 21, 23, "", "x", 1.0)]
    df = spark.createDataFrame([(rows,)], f"e array<{X.EXTRACTION}>")
    assert [e.value for e in df.select(X.resolve_overlaps(F.col("e")).alias("x")).first().x] == ["a", "d", "e"]


def test_long_and_empty_texts_do_not_fail(spark):
    for text in ("", "1." * 20_000, "a@" + "b." * 10_000 + "c", "9" * 40_000, None):
        for column in (X.dates, X.emails, X.urls, X.phones, X.money, X.percentages):
            run(spark, text, column)


def test_tolerant_numbers(spark):
    cases = {"$1,234.50": 1234.5, "1.234,50": 1234.5, "1,23.50": None, "1.234": 1234, "1,234": 1234, "1.5": 1.5, "1234,50": 1234.5, "1,234,567": 1234567, "abc": None, "": None, "-12": -12, "1e3": 1000, "NaN": None}
    for text, expected in cases.items():
        got = run(spark, text, T.to_number)
        assert (None if got is None else float(got)) == expected, text


def test_tolerant_dates(spark):
    for text, expected in {"2026-04-10": "2026-04-10", "04/10/2026": "2026-04-10", "25/04/2026": "2026-04-25", "10 April 2026": "2026-04-10", "Apr 10, 2026": "2026-04-10", "summary": None, "may": None}.items():
        assert run(spark, text, lambda t: T.to_date(t).cast("string")) == expected


def test_words():
    assert [T.ordinal(n) for n in (0, 1, 10, 12, 20, 21, 42, 90)] == ["zeroth", "zero-first", "tenth", "twelfth", "twentieth", "twenty-first", "forty-second", "ninetieth"]
    assert [T.cardinal(n) for n in (0, 13, 40, 99)] == ["zero", "thirteen", "forty", "ninety-nine"]


def test_sentences_keep_their_digits(spark):
    assert run(spark, "0 of 10\n21 items. 2 x 2\n\n3", T.sentences) == ["0 of 10", "21 items.", "2 x 2", "3"]


def test_values_follow_the_rules_of_columns(spark):
    texts = ["$1,234.50", "1.234,50", "1,23.50", "1.234", "1,234", "1.5", "1234,50", "1,234,567", "abc", "", "-12", "+1.5", "1e3", "NaN", "€ 5", "1 000", " 7 ", ".5", "5.", "1,2,3", "12,345.6,7"]
    texts += ["2026-04-10", "04/10/2026", "25/04/2026", "10 April 2026", "Apr 10, 2026", "summary", "may", "2026-02-30", "1/2/2026", "3rd of May", "May 3rd, 2026", " 2026/4/1 ", "31-12-2025", "12-31-2025"]
    for t in texts:
        n, d = run(spark, t, T.to_number), run(spark, t, lambda c: T.to_date(c).cast("string"))
        assert V.number(t) == n, t
        assert (V.day(t).isoformat() if V.day(t) else None) == d, t
    for t in ["  A\tb\n C ", "ÉCOLE", ""]:
        assert V.norm(t) == run(spark, t, T.norm), t
