"""Multipart credential linking (operator 3).

Every document is scanned for the parts of credentials:

* assign, access, hex: the base patterns, reported wherever they match;
* secret: a run of 32 or more characters of either base-64 alphabet (+ / or - _) with letters
  of both cases and digits, which alone could be any identifier, so a weak candidate;
* user: a user, account, client or key name that is set to a value, a weak candidate too;
* endpoint: a URL, host with port, IPv4 address or a bucket or host that is set to a value.

Scopes are paragraphs (text between blank lines), whole for ``secret_scan``; ``find`` takes a
``reach`` that narrows them to so many code points around a part.  Parts are intervals; an interval join within the scope links each
weak candidate to the parts that complete it: a secret needs an access identifier or user
and an endpoint needs both sides of a credential, that is an identifier (access or user)
and a secret (assign, hex or secret).  The join is a sweep over parts sorted by start,
with two binary searches a part.  Weak candidates without complement are not reported.

Defined results: null and empty texts have no span; a text of any length is scanned whole;
equal texts and repeated rows have equal results; spans of equal start go by kind as
listed, then end; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from itertools import accumulate
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map, only, text_chunks

#: Fixed values of the contract, kinds in the order in which they are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
BASE = ("assign", "access", "hex")

SECRET = re.compile(r"(?<![A-Za-z0-9+/=_-])(?:[A-Za-z0-9+/]{32,}|[A-Za-z0-9_-]{32,})={0,2}(?![A-Za-z0-9+/=_-])")
USER = re.compile(r"""(?<![A-Za-z0-9])(?:user(?:name)?|account|login|client_?id|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._-]{3,}""", re.IGNORECASE | re.ASCII)
ENDPOINT = re.compile(
    r"""https?://[^\s"'<>]+|(?<![A-Za-z0-9.])\d{1,3}(?:\.\d{1,3}){3}(?![A-Za-z0-9.])|(?<![A-Za-z0-9])(?:host|endpoint|bucket|server)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._-]{3,}""",
    re.IGNORECASE | re.ASCII,
)
KINDS = (*BASE, "secret", "user", "endpoint")
IDENTIFIERS, PROOFS = frozenset({"access", "user"}), frozenset({"assign", "hex", "secret"})
REACH = 400
_BLANK = re.compile(r"\n[\x20\t\r]*\n")


class Span(NamedTuple):
    start: int
    kind: int
    end: int

    def text(self) -> str:
        return f"{KINDS[self.kind]}:{self.start}:{self.end}"


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns that pass their length tests, in order."""
    out = [Span(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    out += [Span(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    out += [Span(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def weak_spans(text: str, base: list[Span]) -> list[Span]:
    """Candidates of the other kinds that do not lie inside a stronger span."""
    out: list[Span] = []
    starts = [s.start for s in base]
    ends = list(accumulate((s.end for s in base), max))  # running maxima, so that they ascend
    for kind, pattern in ((3, SECRET), (4, USER), (5, ENDPOINT)):
        for m in pattern.finditer(text):
            a, b = m.span()
            if kind == 3 and not (re.search("[a-z]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[0-9]", m[0])):
                continue
            # of the base spans that begin before b, one overlaps if the farthest end is behind a
            before = bisect_left(starts, b)
            if not before or ends[before - 1] <= a:
                out.append(Span(a, kind, b))
    return sorted(out)


def linked(text: str, base: list[Span], weak: list[Span], reach: int | None = REACH) -> list[Span]:
    """The weak spans that complementary parts within their scope complete; without a reach that is the paragraph."""
    if not weak:
        return []
    borders = [m.start() for m in _BLANK.finditer(text)]
    everything = sorted([*base, *weak])
    ids = [s for s in everything if KINDS[s.kind] in IDENTIFIERS]
    proofs = [s for s in everything if KINDS[s.kind] in PROOFS]
    # ends as running maxima, so that they ascend as well; a part reaches into the scope if it ends at or behind its low end
    sides = [(x, [s.start for s in x], list(accumulate((s.end for s in x), max))) for x in (ids, proofs)]

    def has(side: int, s: Span) -> bool:
        spans, starts, ends = sides[side]
        at = bisect_right(borders, s.start)
        begin, end = borders[at - 1] if at else 0, borders[at] if at < len(borders) else len(text)
        low, high = (begin, end) if reach is None else (max(s.start - reach, begin), min(s.end + reach, end))
        # no part spans a border, so those from the paragraph's first on are inside of it
        a, b = max(bisect_left(ends, low), bisect_left(starts, begin)), bisect_right(starts, high)
        own = bisect_left(spans, s)
        return b - a > (a <= own < b and spans[own] == s)

    need = {"secret": (0,), "user": (1,), "endpoint": (0, 1)}
    return [s for s in weak if all(has(side, s) for side in need[KINDS[s.kind]])]


def find(text: str, reach: int | None = REACH) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans with the linked weak ones."""
    base = base_spans(text)
    return base, sorted([*base, *linked(text, base, weak_spans(text, base), reach)])


def _report(batch: pa.RecordBatch):
    for chunk in text_chunks(batch):
        rows = []
        for text in chunk["text"].to_pylist():
            base, every = find(text or "", None)
            kinds = [s.kind for s in base]
            digest = hashlib.sha256(",".join(s.text() for s in base).encode()).hexdigest()
            rows.append((*(kinds.count(i) for i in range(3)), digest, ",".join(s.text() for s in every)))
        columns = list(zip(*rows, strict=True))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2
        yield pa.RecordBatch.from_arrays(
            [chunk["doc_id"], *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
            ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
        )


def secret_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row of docs."""
    schema = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    return arrow_map(only(docs, "doc_id", "text"), schema, _report)
