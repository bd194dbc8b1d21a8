"""Merging what rules and a model produced, field by field.

A prediction's leaves are array<struct<path, values array<JSON text>, repeated>>.  Rules
win where they resolved a field; the model fills declared fields only, and its nulls are no
values.
"""

from __future__ import annotations

import json

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import get_schema, schemas
from ..functions.extract import list_array
from ..functions.leaves import flatten, leaf_json
from .jsonops import objects_of, unflatten

#: path, JSON values, repeated.
Row = tuple[str, list[str], bool]
LEAVES = "array<struct<path:string,values:array<string>,repeated:boolean>>"


def _rule_leaves(resolved: list[dict]) -> list[Row]:
    # list elements compare by type, so amounts in lists stay numbers
    return [(r["path"], r["values"] if r["repeated"] else [json.dumps(v, ensure_ascii=False) for v in r["values"]], r["repeated"]) for r in resolved]


def _row_arrays(cells: list[list[Row] | None]) -> pa.Array:
    def columns(flat: list[Row]) -> pa.Array:
        parts = zip(*flat, strict=True) if flat else [[]] * 3
        return pa.StructArray.from_arrays([pa.array(c, k) for c, (_, k) in zip(parts, _FIELDS, strict=True)], fields=[pa.field(*f) for f in _FIELDS])

    return list_array(cells, columns)


def rule_leaves(resolved: Column) -> Column:
    """A pre-pass result as leaves; values are JSON strings, which comparison reads leniently."""
    return F.arrow_udf(lambda cells: _row_arrays([None if c is None else _rule_leaves(c) for c in cells.to_pylist()]), LEAVES)(resolved)


_FIELDS = [("path", pa.string()), ("values", pa.list_(pa.string())), ("repeated", pa.bool_())]


def _given(value: dict) -> list[tuple[str, list[str], bool]]:
    """(path, values, repeated) of an object's leaves that are not null, by path."""
    found: dict[str, tuple[list[str], bool]] = {}
    for x in flatten(value):
        if not x.empty and (x.listy or x.kind != "null"):
            values, listy = found.get(x.path, ([], False))
            found[x.path] = ([*values, leaf_json(x)], listy or x.listy)
    return [(path, *v) for path, v in sorted(found.items())]


def _leaf_arrays(texts: pa.Array) -> pa.Array:
    return _row_arrays([None if v is None else _given(v) for v in objects_of(texts)])


def leaves_of(prediction: Column) -> Column:
    """The leaves of a parsed prediction (VARIANT) that are not null; null for no prediction."""
    return F.arrow_udf(_leaf_arrays, LEAVES)(F.to_json(prediction))


def model_leaves(df: DataFrame, key: str = "record_id", prediction: str = "prediction") -> DataFrame:
    """(key, leaves) of every record with a prediction."""
    return df.select(key, leaves_of(F.col(prediction)).alias("leaves")).filter("leaves is not null")


def _merged(known: dict[str, frozenset[str]], schema: str | None, rules: list[Row], model: list[Row]) -> list[Row]:
    taken, declared = {r[0] for r in rules}, known.get(schema, frozenset())
    return sorted([*rules, *(m for m in model if m[0] in declared and m[0] not in taken)])


def merge(rules: Column, model: Column, schema: str | Column) -> Column:
    """Leaves of both by ownership: rules first, then the model's declared leaves."""
    known = {s.name: frozenset(s.paths()) for s in schemas()}
    rows = lambda c: [(r["path"], r["values"], r["repeated"]) for r in c or ()]

    def run(rules: pa.Array, model: pa.Array, names: pa.Array) -> pa.Array:
        cells = zip(rules.to_pylist(), model.to_pylist(), names.to_pylist(), strict=True)
        return _row_arrays([_merged(known, name, rows(r), rows(m)) for r, m, name in cells])

    name = F.lit(get_schema(schema).name) if isinstance(schema, str) else schema
    return F.arrow_udf(run, LEAVES)(rules, model, name)


def merged_object(rules: Column, model: Column, schema: str | Column) -> Column:
    """The merged prediction as VARIANT."""
    return F.try_parse_json(unflatten(merge(rules, model, schema)))


def rules_only(resolved: Column) -> Column:
    """The pre-pass alone as VARIANT."""
    return F.try_parse_json(unflatten(rule_leaves(resolved)))
