"""Extractors as Column functions: document text to an array of typed spans.

An extraction is struct<value, start, end, raw, extractor, confidence>.  The work is that of
``spans``, one Arrow batch at a time: a text is read once, and what crosses to Python is the
text alone.  (As nested Column lambdas the same took some twenty times as long.)  A null text
has no extractions, but null.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import spans

EXTRACTION = "struct<value:string,start:int,end:int,raw:string,extractor:string,confidence:double>"
_FIELDS = [("value", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("raw", pa.string()), ("extractor", pa.string()), ("confidence", pa.float64())]
ARROW_EXTRACTION = pa.struct(_FIELDS)


def extraction_array(found: Sequence[spans.Found | None]) -> pa.StructArray:
    """Extractions as Arrow structs; None is null."""
    if found and None not in found:
        return pa.StructArray.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*found, strict=True), _FIELDS, strict=True)], fields=[pa.field(*f) for f in _FIELDS])
    columns = [pa.array([None if f is None else f[i] for f in found], kind) for i, (_, kind) in enumerate(_FIELDS)]
    nulls = pa.array([f is None for f in found], pa.bool_())
    return pa.StructArray.from_arrays(columns, fields=[pa.field(*f) for f in _FIELDS], mask=nulls)


def list_array(rows: Sequence[Sequence | None], values: Callable[[list], pa.Array]) -> pa.ListArray:
    """An array of lists from the flat array that ``values`` makes of all their entries."""
    offsets, flat = [], []
    for row in rows:
        offsets.append(None if row is None else len(flat))
        flat += row or ()
    return pa.ListArray.from_arrays(pa.array([*offsets, len(flat)], pa.int32()), values(flat))


def _column(find: Callable[[str], list[spans.Found]], text: Column) -> Column:
    def run(texts: pa.Array) -> pa.Array:
        return list_array([None if t is None else find(t) for t in texts.to_pylist()], extraction_array)

    return F.arrow_udf(run, f"array<{EXTRACTION}>")(text)


def emails(text: Column) -> Column:
    return _column(spans.emails, text)


def urls(text: Column) -> Column:
    """http, https and www addresses without sentence punctuation at the end."""
    return _column(spans.urls, text)


def phones(text: Column, region: str = "US") -> Column:
    """E.164 numbers: national form of the region +1, international ones after a plus."""
    if region not in spans.REGIONS:
        raise ValueError(f"unsupported region {region!r} for phone numbers")
    return _column(lambda t: spans.phones(t, region), text)


def percentages(text: Column) -> Column:
    """The number before a percent sign, a decimal comma read as a point."""
    return _column(spans.percentages, text)


def money(text: Column) -> Column:
    """Amounts; one inside a parenthesised amount is not counted again."""
    return _column(spans.money, text)


def dates(text: Column, dayfirst: bool = False) -> Column:
    """ISO, numeric and month-name dates; the confidence is 0.7 where day and month could change places."""
    return _column(lambda t: spans.dates(t, dayfirst), text)


def identifiers(text: Column, patterns: Sequence[str]) -> Column:
    """Matches of any of the patterns, as they stand."""
    return _column(lambda t: spans.identifiers(t, patterns), text)


def as_found(rows: list[dict] | None) -> list[spans.Found]:
    return [spans.Found(**r) for r in rows or ()]


def found_rows(rows: pa.ListArray) -> list[list[spans.Found] | None]:
    """Lists of extractions, column by column; a null list is None."""
    flat = list(map(spans.Found._make, zip(*(rows.values.field(name).to_pylist() for name, _ in _FIELDS), strict=True)))
    at = rows.offsets.to_pylist()
    return [None if null else flat[a:b] for null, a, b in zip(rows.is_null().to_pylist(), at, at[1:], strict=False)]


def resolve_overlaps(found: Column) -> Column:
    """Of overlapping extractions the longest; of equal ones the surer, then the earlier."""

    def run(rows: pa.Array) -> pa.Array:
        return list_array([None if r is None else spans.without_overlaps(r) for r in found_rows(rows)], extraction_array)

    return F.arrow_udf(run, f"array<{EXTRACTION}>")(found)


def extremum(found: Column, largest: bool) -> Column:
    """The extraction with the largest or smallest value; the first of equal ones."""

    def run(rows: pa.Array) -> pa.Array:
        return extraction_array([spans.extremum(as_found(r), largest) for r in rows.to_pylist()])

    return F.arrow_udf(run, EXTRACTION)(found)
