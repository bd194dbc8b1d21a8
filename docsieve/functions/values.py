"""The rules of ``text`` for one value at a time, for kernels that see a whole record at once.

``text`` has the same rules as Column expressions; a test holds the two together.  Numbers
are exact decimals here, of any length.
"""

from __future__ import annotations

import re
from datetime import date
from decimal import Decimal, InvalidOperation
from functools import lru_cache

from .text import BLANKS, CURRENCY, DATE_FORMS, MONTH, MONTHS

#: Texts of more code points are read anew each time.
KEPT = 64
_CURRENCY = re.compile(CURRENCY)
_BLANKS = re.compile(BLANKS)
_SPACE = re.compile(r"\s+")
_PLAIN = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?", re.ASCII)
_LEAD = r"(?:[0-9]{1,3}|[+-][0-9]{1,2})"
#: Thousands between groups of three, with the other mark before the decimals or with none.
_GROUPED = {
    ",.": re.compile(_LEAD + r"(?:,[0-9]{3})+\.[0-9]*"), ".,": re.compile(_LEAD + r"(?:\.[0-9]{3})+,[0-9]*"),
    ",": re.compile(_LEAD + r"(?:,[0-9]{3})+"), ".": re.compile(_LEAD + r"(?:\.[0-9]{3})+"),
}
#: What any number and any date begin with; a date ends with a digit.
_NUMBER_BEGINS = frozenset("0123456789+-.,$€£¥₹\x20\u00a0\u2009")
_DAY_BEGINS = frozenset("0123456789" + "".join(m[0] + m[0].upper() for m in MONTHS))
_THOUSANDS = re.compile(r".{1,3}[,.][0-9]{3}", re.DOTALL)
_FORMS = [(re.compile(re.sub(r"\(\?<\w>", "(", form), re.ASCII), order) for form, order in DATE_FORMS]
_DAY_FIRST = re.compile(rf"(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?,?\s+(\d{{4}})", re.IGNORECASE | re.ASCII)
_MONTH_FIRST = re.compile(rf"({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})", re.IGNORECASE | re.ASCII)


def norm(text: str) -> str:
    """Case-folded, white space as single spaces, none at the ends."""
    return _SPACE.sub(" ", text.upper().lower()).strip(" ")


def make_day(year: str, month: str, day: str) -> date | None:
    y = int(year)
    if len(year) == 2:
        y += 2000 if y < 69 else 1900
    try:
        return date(y, int(month), int(day))
    except ValueError:
        return None


def month_number(name: str) -> str:
    return str(MONTHS.index(name[:3].lower()) + 1)


def separated(t: str) -> str | None:
    """A plain decimal string from digits with separators, or None."""
    commas, dots = t.count(","), t.count(".")
    if not commas and not dots:
        return t
    if commas and dots:
        if _GROUPED[",."].fullmatch(t):
            return t.replace(",", "")
        return t.replace(".", "").replace(",", ".") if _GROUPED[".,"].fullmatch(t) else None
    mark = "," if commas else "."
    if commas + dots > 1:
        return t.replace(mark, "") if _GROUPED[mark].fullmatch(t) else None
    return t.replace(mark, "") if _THOUSANDS.fullmatch(t) else t.replace(",", ".")


def exact(text: str) -> Decimal | None:
    """A decimal from digits as they stand."""
    if not _PLAIN.fullmatch(text):
        return None
    try:
        return Decimal(text)
    except InvalidOperation:
        return None


def number(text: str) -> Decimal | None:
    """A tolerant decimal: currency signs and spaces go, separators are read."""
    return _number(text) if len(text) <= KEPT else _number.__wrapped__(text)


def day(text: str) -> date | None:
    """A date from numeric forms in order, then from month-name forms; only a whole date counts."""
    return _day(text) if len(text) <= KEPT else _day.__wrapped__(text)


@lru_cache(maxsize=8_192)
def _number(text: str) -> Decimal | None:
    t = text.strip(" ")
    if not t or t[0] not in _NUMBER_BEGINS or not any("0" <= c <= "9" for c in t):
        return None
    clean = separated(_BLANKS.sub("", _CURRENCY.sub("", t)))
    return None if clean is None else exact(clean)


@lru_cache(maxsize=8_192)
def _day(text: str) -> date | None:
    t = text.strip(" ")
    if not t or t[0] not in _DAY_BEGINS or not "0" <= t[-1] <= "9":
        return None
    for form, order in _FORMS:
        if (m := form.fullmatch(t)) and (found := make_day(*(m[1 + order.index(part)] for part in "ymd"))):
            return found
    if m := _DAY_FIRST.fullmatch(t):
        return make_day(m[3], month_number(m[2]), m[1])
    if m := _MONTH_FIRST.fullmatch(t):
        return make_day(m[3], month_number(m[1]), m[2])
    return None
