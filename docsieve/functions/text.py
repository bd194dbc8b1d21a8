"""Normalisation of strings, numbers and dates, as Column expressions.

Numbers are DECIMAL(38,10); what that cannot hold, and forms such as ``NaN`` or ``1_000``,
are no numbers here.  Casts are the try_ forms, so no input raises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = "decimal(38,10)"
CURRENCY = "[$€£¥₹]"
#: Space, no-break space and thin space.
BLANKS = "[\x20\u00a0\u2009]"
#: ISO currency codes that mark an amount.
CODES = "USD|EUR|GBP|JPY|CNY|CHF|CAD|AUD|SEK|NOK|DKK|PLN|CZK|HUF|MXN|BRL|ZAR|INR|KRW"
#: Date forms in the order in which they are tried.
DATE_FORMS = (
    (r"(?<y>\d{4})-(?<m>\d{1,2})-(?<d>\d{1,2})", "ymd"), (r"(\d{4})/(\d{1,2})/(\d{1,2})", "ymd"),
    (r"(\d{1,2})/(\d{1,2})/(\d{4})", "mdy"), (r"(\d{1,2})/(\d{1,2})/(\d{4})", "dmy"),
    (r"(\d{1,2})-(\d{1,2})-(\d{4})", "mdy"), (r"(\d{1,2})-(\d{1,2})-(\d{4})", "dmy"),
)
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
#: A month's English name in full or its usual short forms.
MONTH = (
    r"jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; a Column used twice would be evaluated twice."""
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def norm(text: Column) -> Column:
    """Case-folded, with runs of Unicode white space as one space, and none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.upper(text)), r"(?U)\s+", " "))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A date from numbers given as strings; null where there is none such."""
    year = F.when(F.length(year) == 2, F.concat(F.when(year.try_cast("int") < 69, F.lit("20")).otherwise(F.lit("19")), year)).otherwise(year)
    return F.try_to_date(F.concat_ws("-", year, F.lpad(month, 2, "0"), F.lpad(day, 2, "0")), "yyyy-MM-dd")


def month_number(name: Column) -> Column:
    """1 to 12 as a string, by the name's first three letters."""
    table = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, str(i + 1))])
    return F.try_element_at(table, F.substring(F.lower(name), 1, 3))


def separated_number(t: Column) -> Column:
    """A plain decimal string from digits with thousands or decimal separators, or null.

    With both kinds the last is the decimal point and the others must stand between groups
    of three.  One separator before exactly three digits and after one to three marks
    thousands; any other single one is the decimal point.  The result keeps its zeros.
    """
    lead = r"^(?:\d{1,3}|[+-]\d{1,2})"
    commas, dots = F.length(t) - F.length(F.replace(t, F.lit(","))), F.length(t) - F.length(F.replace(t, F.lit(".")))
    no_commas, no_dots = F.replace(t, F.lit(","), F.lit("")), F.replace(t, F.lit("."), F.lit(""))
    return (
        F.when((commas == 0) & (dots == 0), t)
        .when((commas > 0) & (dots > 0), F.when(t.rlike(lead + r"(?:,\d{3})+\.\d*$"), no_commas).when(t.rlike(lead + r"(?:\.\d{3})+,\d*$"), F.replace(no_dots, F.lit(","), F.lit("."))))
        .when(commas > 1, F.when(t.rlike(lead + r"(?:,\d{3})+$"), no_commas))
        .when(dots > 1, F.when(t.rlike(lead + r"(?:\.\d{3})+$"), no_dots))
        .when(t.rlike(r"^.{1,3}[,.]\d{3}$"), F.replace(no_commas, F.lit("."), F.lit("")))
        .otherwise(F.replace(t, F.lit(","), F.lit(".")))
    )


def to_number(text: Column) -> Column:
    """A tolerant decimal: currency signs and spaces are dropped, separators read as above."""
    t = F.regexp_replace(F.regexp_replace(F.trim(text), CURRENCY, ""), BLANKS, "")
    plain = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
    return let(let(t, separated_number), lambda clean: F.when(clean.rlike(plain), clean.try_cast(NUMBER)))


def to_date(text: Column) -> Column:
    """A date from numeric forms in order, then month-name forms; only a whole date counts."""
    return let(F.trim(text), _first_date)


def _first_date(t: Column) -> Column:
    tries = []
    for form, order in DATE_FORMS:
        a, b, c = (F.regexp_extract(t, f"^{form}$", i) for i in (1, 2, 3))
        y, m, d = {"ymd": (a, b, c), "mdy": (c, a, b), "dmy": (c, b, a)}[order]
        tries.append(F.when(t.rlike(f"^{form}$"), make_date(y, m, d)))
    last = rf"(?i)^(\d{{1,2}})(?:st|nd|rd|th)?\s+({MONTH})\.?,?\s+(\d{{4}})$"
    first = rf"(?i)^({MONTH})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?\s*,?\s+(\d{{4}})$"
    tries.append(F.when(t.rlike(last), make_date(F.regexp_extract(t, last, 3), month_number(F.regexp_extract(t, last, 2)), F.regexp_extract(t, last, 1))))
    tries.append(F.when(t.rlike(first), make_date(F.regexp_extract(t, first, 3), month_number(F.regexp_extract(t, first, 1)), F.regexp_extract(t, first, 2))))
    return F.coalesce(*tries)


def ontology_lookup(table: dict[str, str], value: Column) -> Column:
    """The canonical form of a surface form, without regard to case or outer space; else the value."""
    first: dict[str, str] = {}
    for surface, canonical in table.items():
        first.setdefault(surface.strip().lower(), canonical)
    if not first:
        return value
    entries = F.create_map(*[F.lit(x) for kv in first.items() for x in kv])
    return F.coalesce(F.try_element_at(entries, F.lower(F.trim(value))), value)


def sentences(text: Column) -> Column:
    """Non-empty pieces between sentence ends or line breaks."""
    return F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n"), lambda x: F.trim(x)), lambda x: x != "")


#: English words of small numbers.
UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = "twenty thirty forty fifty sixty seventy eighty ninety".split()
#: What follows a hyphen is regular here: twenty-fiveth, as in the corpora this must match.
_AFTER_HYPHEN = {"one": "first", "two": "second", "three": "third"}


def cardinal(n: int) -> str:
    """0 to 99 in words."""
    return UNITS[n] if n < 20 else TENS[n // 10 - 2] + (f"-{UNITS[n % 10]}" if n % 10 else "")


def ordinal(n: int) -> str:
    head, _, tail = cardinal(n).rpartition("-")
    if head:
        return f"{head}-{_AFTER_HYPHEN.get(tail, tail + 'th')}"
    if 0 < n < 10:  # below ten the zero is spoken, too
        return f"zero-{_AFTER_HYPHEN.get(tail, tail + 'th')}"
    return "twelfth" if n == 12 else tail[:-1] + "ieth" if tail.endswith("ty") else tail + "th"


def ordinal_words(n: Column) -> Column:
    """The ordinal of a number from 0 to 99."""
    return F.element_at(F.array(*[F.lit(ordinal(i)) for i in range(100)]), n + 1)
