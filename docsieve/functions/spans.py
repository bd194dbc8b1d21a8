"""Extractors over one text: typed spans in document order.

A found value is ``Found(value, start, end, raw, extractor, confidence)``; start and end are
code points from 0, end exclusive, and raw is the text between them.  ``extract`` has the
same as Column functions.  Patterns repeat groups possessively, so that no text makes a
matcher go back over what it has read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable, Iterable, Sequence
from datetime import date
from decimal import Decimal
from typing import NamedTuple

from .text import CODES, CURRENCY, MONTH, MONTHS
from .values import exact, make_day, month_number, separated


class Found(NamedTuple):
    value: str
    start: int
    end: int
    raw: str
    extractor: str
    confidence: float = 1.0


_LABEL = r"[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?"
EMAIL = re.compile(rf"(?<![A-Za-z0-9])[A-Za-z0-9](?:[A-Za-z0-9.!#$%&'*+/=?^_`{{|}}~-]*[A-Za-z0-9])?@{_LABEL}(?:\.{_LABEL})++")
_RUN = re.compile(r"[A-Za-z0-9.!#$%&'*+/=?^_`{|}~@-]++")
URL = re.compile(r"""\b(?:https?://|www\.)[^\s<>"']+""", re.IGNORECASE)
# A pattern begins with what its first character may be, and looks behind that: so a matcher runs over all others.
#: Groups are the mark, month and day behind a year of four digits.
ISO_DATE = re.compile(r"\d(?<!\w\d)\d{3}([-/.])(\d{1,2})\1(\d{1,2})\b")
#: Groups are the second and third number.
NUMERIC_DATE = re.compile(r"\d(?<!\w\d)\d?[-/.](\d{1,2})[-/.](\d{4}|\d{2})(?!\d)")
MONTH_FIRST = re.compile(rf"\b({MONTH})\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})(?!\d)", re.IGNORECASE)
DAY_FIRST = re.compile(rf"\b(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\s+(\d{{4}})(?!\d)", re.IGNORECASE)
_CODE = rf"\b(?:{CODES})\b"
_AMOUNT = rf"(?:{CURRENCY}|{_CODE}\s*)?\d++(?:[.,]\d++)*+(?:\s*{_CODE})?"
_FIRST = rf"$€£¥₹\d{''.join(sorted({c[0] for c in CODES.split('|')}))}"
_BY_CODE = "|".join(rf"(?<={c[0]}){c[1:]}" for c in CODES.split("|"))
#: An amount that no word, digit or sign stands before.
MONEY = re.compile(
    rf"[{_FIRST}](?<![\w$€£¥₹][{_FIRST}])(?:(?<=\d)\d*+|(?<={CURRENCY})\d++|(?:{_BY_CODE})\b\s*\d++)(?:[.,]\d++)*+(?:\s*{_CODE})?(?![\d%])"
)
PAREN_MONEY = re.compile(rf"\({_AMOUNT}\s*\)")
PERCENT = re.compile(r"(?<!\w)(\d++(?:[.,]\d++)?+)\s*%")
#: National ten-digit numbers, with or without +1, and international numbers after a plus.
_LINE = r"[2-9]\d{2}[-. ]?\d{4}"
PHONE = re.compile(
    rf"[+(1-9](?<![\w+][+(1-9])(?:(?:(?<=\+)1|(?<=1))[-. ]?(?:\([2-9]\d{{2}}\)|[2-9]\d{{2}})[-. ]?{_LINE}"
    rf"|(?:(?<=\()[2-9]\d{{2}}\)|(?<=[2-9])\d{{2}})[-. ]?{_LINE}|(?<=\+)[2-9]\d{{0,2}}[-. ]?\d{{2,4}}(?:[-. ]?\d{{2,4}}){{1,3}}+)(?!\w)"
)
REGIONS = ("US", "CA")
_MARK = re.compile(f"{CURRENCY}|{_CODE}")
_VALUE = re.compile(r"[0-9]+\.?[0-9]*")
_HAS_DIGIT = re.compile(r"\d")
#: Amounts that stand for themselves: decimals of one or two places, or whole with a sign.
_SIMPLE = re.compile(r"[$€£¥₹]?([0-9]+\.[0-9]{1,2})|[$€£¥₹]([0-9]+)")
_RUN_CHARACTERS = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789.!#$%&'*+/=?^_`{|}~@-")


def _found(name: str, matches: Iterable[re.Match], value: Callable[[re.Match], str | None]) -> list[Found]:
    """Matches that have a value."""
    return [Found(v, m.start(), m.end(), m[0], name) for m in matches if (v := value(m)) is not None]


def emails(text: str) -> list[Found]:
    out, done = [], 0
    # an address lies inside a run of its characters; only runs with the sign are read, each once
    while (at := text.find("@", done)) >= 0:
        begin = at
        while begin > done and text[begin - 1] in _RUN_CHARACTERS:
            begin -= 1
        done = _RUN.match(text, at).end()
        out += _found("emails", EMAIL.finditer(text, begin, done), lambda m: m[0])
    return out


def urls(text: str) -> list[Found]:
    """http, https and www addresses without sentence punctuation at the end."""
    out = []
    for m in URL.finditer(text):
        if raw := m[0].rstrip(".,;:!?)"):
            out.append(Found(raw, m.start(), m.start() + len(raw), raw, "urls"))
    return out


def phones(text: str, region: str = "US") -> list[Found]:
    """E.164 numbers: national form of the region +1, international ones after a plus."""
    if region not in REGIONS:
        raise ValueError(f"unsupported region {region!r} for phone numbers")

    def e164(m: re.Match) -> str:
        digits = re.sub(r"\D", "", m[0])
        return f"+{digits}" if m[0][0] == "+" or len(digits) == 11 else f"+1{digits}"

    return _found("phones", PHONE.finditer(text), e164)


def percentages(text: str) -> list[Found]:
    """The number before a percent sign, a decimal comma read as a point."""
    return _found("percentages", PERCENT.finditer(text), lambda m: m[1].replace(",", "."))


def amount(raw: str) -> str | None:
    """The plain decimal string of an amount, negative in parentheses; a bare integer is none."""
    if simple := _SIMPLE.fullmatch(raw):
        return simple[1] or simple[2]
    t = raw.strip(" ")
    negative = t.startswith("(") and t.endswith(")")
    t = t[1:-1].strip(" ") if negative else t
    bare = _MARK.sub("", t).strip()
    if not _MARK.search(t) and "." not in t and "," not in t:
        return None
    n = separated(bare)
    if n is None or not _VALUE.fullmatch(n):
        return None
    return f"-{n}" if negative else n


def money(text: str) -> list[Found]:
    """Amounts; one inside a parenthesised amount is not counted again."""
    if not _HAS_DIGIT.search(text):
        return []
    inner = _found("money", PAREN_MONEY.finditer(text), lambda m: amount(m[0])) if "(" in text else []
    plain = []
    for m in MONEY.finditer(text):
        raw = m[0]
        if not raw.isdigit() and (v := amount(raw)) is not None:
            begin = m.start()
            plain.append(Found(v, begin, begin + len(raw), raw, "money"))
    if not inner:
        return plain
    starts = [p.start for p in inner]
    # those in parentheses do not overlap, so the last one that begins before is the one to look at
    free = [f for f in plain if not (at := bisect_right(starts, f.start)) or f.end > inner[at - 1].end]
    return in_order([*inner, *free])


def _no_month(low: str) -> bool:
    for name in MONTHS:
        if name in low:
            return False
    return True


def dates(text: str, dayfirst: bool = False) -> list[Found]:
    """ISO dates.  A/B/Y is month first (or day first) if that is a date, else the other way.

    Where both A and B could be months, the confidence is 0.7.
    """
    if not _HAS_DIGIT.search(text):
        return []
    iso = lambda d: None if d is None else d.isoformat()
    out = _found("dates", ISO_DATE.finditer(text), lambda m: iso(make_day(m[0][:4], m[2], m[3])))
    for m in NUMERIC_DATE.finditer(text):
        first, second = m[0][: m.start(1) - m.start() - 1], m[1]
        ways = [make_day(m[2], first, second), make_day(m[2], second, first)]
        if d := ways[dayfirst] or ways[not dayfirst]:
            unsure = 1 <= int(first) <= 12 and 1 <= int(second) <= 12
            out.append(Found(d.isoformat(), m.start(), m.end(), m[0], "dates", 0.7 if unsure else 1.0))
    # without regard to case some letters beyond ASCII stand for ASCII ones, so only ASCII texts are passed over
    if text.isascii() and _no_month(text.lower()):
        return in_order(out) if len(out) > 1 else out
    out += _found("dates", MONTH_FIRST.finditer(text), lambda m: iso(make_day(m[3], month_number(m[1]), m[2])))
    out += _found("dates", DAY_FIRST.finditer(text), lambda m: iso(make_day(m[3], month_number(m[2]), m[1])))
    return in_order(out)


def identifiers(text: str, patterns: Sequence[re.Pattern | str]) -> list[Found]:
    """Matches of any of the patterns, as they stand."""
    return in_order([Found(m[0], m.start(), m.end(), m[0], "identifiers") for p in patterns for m in re.compile(p).finditer(text)])


def in_order(found: list[Found]) -> list[Found]:
    return sorted(found, key=lambda f: (f.start, f.end))


def without_overlaps(found: list[Found]) -> list[Found]:
    """Of overlapping values the longest; of equal ones the surer, then the earlier."""
    end = 0
    for f in found:
        if f.start < end:
            break
        end = f.end
    else:
        return found
    kept: list[Found] = []  # in order, and without overlaps
    for f in sorted(found, key=lambda f: (f.start - f.end, -f.confidence, f.start)):
        at = bisect_left(kept, f.start, key=lambda k: k.start)
        if (at == 0 or kept[at - 1].end <= f.start) and (at == len(kept) or f.end <= kept[at].start):
            kept.insert(at, f)
    return kept


def extremum(found: list[Found], largest: bool) -> Found | None:
    """The largest or smallest value, other values behind numbers and dates; the first of equal ones."""

    def size(f: Found) -> tuple[int, Decimal | str]:
        if (n := exact(f.value)) is not None:
            return (0, n)
        try:
            return (0, Decimal((date.fromisoformat(f.value) - date(1970, 1, 1)).days))
        except ValueError:
            return (1, f.value)

    if not found:
        return None
    return (max if largest else min)(found, key=size)
