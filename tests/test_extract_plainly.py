"""Extractors that look for first characters against the patterns as they read."""

from __future__ import annotations

import random
import re

from docsieve.functions import extract, spans
from docsieve.functions.text import CODES, CURRENCY
from docsieve.operators.prepass import BINDINGS, _label_at

_CODE = rf"\b(?:{CODES})\b"
PLAIN = {
    "MONEY": rf"(?<![\w$€£¥₹])(?:{CURRENCY}|{_CODE}\s*)?\d++(?:[.,]\d++)*+(?:\s*{_CODE})?(?![\d%])",
    "PHONE": r"(?<![\w+])(?:(?:\+?1[-. ]?)?(?:\([2-9]\d{2}\)[-. ]?|[2-9]\d{2}[-. ]?)[2-9]\d{2}[-. ]?\d{4}|\+[2-9]\d{0,2}[-. ]?\d{2,4}(?:[-. ]?\d{2,4}){1,3}+)(?!\w)",
    "ISO_DATE": r"\b(\d{4})([-/.])(\d{1,2})\2(\d{1,2})\b",
    "NUMERIC_DATE": r"\b(\d{1,2})[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)",
}
BITS = [
    *"$€@.,%()-/+ \n_é٣1", "USD", "EUR ", "  KRW", "12", "345", "6789", "2024", "USDT", "a@b.com", "x.y@c.d.org", "(415)", "555-2671", "1995-01-03", "3.04.99",
    "total", "Total:", "DATE", "due:", "Vendor", "ſtart", "TAX", "from ", "$1.5", "1,234.50",
]


def test_patterns_and_labels():
    r = random.Random(3)
    labels = {b.label for fields in BINDINGS.values() for b in fields.values() if b.label}
    for _ in range(3_000):
        text = "".join(r.choice(BITS) for _ in range(r.randint(0, 30)))
        for name, plain in PLAIN.items():
            assert [m.span() for m in getattr(spans, name).finditer(text)] == [m.span() for m in re.finditer(plain, text)], (name, text)
        assert [(f.start, f.value) for f in spans.emails(text)] == [(m.start(), m[0]) for m in spans.EMAIL.finditer(text)], text
        for label in labels:
            m = re.search(label, text)
            assert _label_at(text, label) == (m.start() if m else -1), (label, text)


def test_lists_of_extractions_are_read_by_column():
    rows = [spans.money("$1.50 or (2.25) USD 3"), None, [], spans.dates("1/2/2003"), spans.emails("a@b.com")]
    array = extract.list_array(rows, extract.extraction_array)
    assert extract.found_rows(array) == rows
    assert extract.found_rows(array[1:4]) == rows[1:4]
    assert extract.found_rows(array[:0]) == []
