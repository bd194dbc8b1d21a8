"""JSON in text: finding an object, parsing it, and going to and from leaf rows.

Parsed JSON is VARIANT.  ``try_parse_json`` gives null for what is no JSON, for repeated
keys and for NaN.  A leaf row is (…, path, listy, empty, v): paths join keys with dots and
``[]`` marks lists of objects; a listy path has one row an element.  An empty list or
object is one row marked ``empty``, which is no leaf but counts for validation.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import leaves
from ..functions.extract import list_array


def find_object(text: Column, tail: bool = False, fences: bool = True) -> Column:
    """The first balanced {...} of a text, or null (with ``tail``: the rest of the text)."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array([leaves.find_object(t, tail, fences) for t in texts.to_pylist()], pa.string())

    return F.arrow_udf(run, "string")(text)


def parse_object(text: Column) -> Column:
    """The first JSON object of a text as VARIANT, or null."""
    # an object's text begins with its brace, so what parses is an object
    return F.try_parse_json(find_object(text))


_LEAF = "struct<path:string,listy:boolean,scalar_list:boolean,empty:boolean,json:string>"
_ARROW_LEAF = [("path", pa.string()), ("listy", pa.bool_()), ("scalar_list", pa.bool_()), ("empty", pa.bool_()), ("json", pa.string())]


def _leaf_array(found: list[leaves.Leaf]) -> pa.StructArray:
    columns = zip(*((x.path, x.listy, x.in_list, x.empty, leaves.leaf_json(x)) for x in found), strict=True) if found else [[]] * 5
    return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, _ARROW_LEAF, strict=True)], fields=[pa.field(*f) for f in _ARROW_LEAF])


def objects_of(texts: pa.Array) -> list[dict | None]:
    """The objects of JSON texts; null and what is no object is None."""
    values = (None if t is None else leaves.parse(t) for t in texts.to_pylist())
    return [v if isinstance(v, dict) else None for v in values]


def _flattened(texts: pa.Array) -> pa.Array:
    return list_array([None if v is None else leaves.flatten(v) for v in objects_of(texts)], _leaf_array)


def flatten(df: DataFrame, value: str = "v") -> DataFrame:
    """df with ``value`` (an object as VARIANT) replaced by its leaf rows: path, listy, empty, v, scalar_list.

    Objects are taken apart to any depth in one Arrow pass.  Null objects have no row.
    """
    keep = [F.col(f"`{c}`") for c in df.columns if c != value]
    # the outer form, since for the other one the optimiser infers a filter on the leaves
    rows = df.select(*keep, F.explode_outer(F.arrow_udf(_flattened, f"array<{_LEAF}>")(F.to_json(value))).alias("_leaf")).filter("_leaf is not null")
    return rows.select(*keep, "_leaf.path", "_leaf.listy", "_leaf.empty", F.parse_json("_leaf.json").alias("v"), "_leaf.scalar_list")


def kind_of(v: Column) -> Column:
    """null, bool, num, str or other."""
    s = F.schema_of_variant(v)
    return (
        F.when(v.isNull() | (s == "VOID"), "null").when(s == "BOOLEAN", "bool").when(s == "STRING", "str")
        .when(s.rlike("^(BIGINT|INT|SMALLINT|TINYINT|DECIMAL|DOUBLE|FLOAT)"), "num").otherwise("other")
    )


def text_of(v: Column) -> Column:
    """A scalar as a plain string, anything else as JSON."""
    return F.coalesce(F.try_variant_get(v, "$", "string"), F.to_json(v))


def unflatten(rows: Column) -> Column:
    """A JSON object from an array ``rows`` of struct<path, values array<JSON text>, repeated>; null for null.

    Lists of objects are zipped by index; a short list leaves its leaf out of later items.
    """

    def run(cells: pa.Array) -> pa.Array:
        named = ([(r["path"], r["values"], r["repeated"]) for r in c] if c is not None else None for c in cells.to_pylist())
        return pa.array([None if c is None else leaves.unflatten(c) for c in named], pa.string())

    return F.arrow_udf(run, "string")(rows)
