"""Field-level evaluation: predictions against references, leaf by leaf.

A record holds both sides, so comparing them needs no other row: one Arrow function takes
prediction, reference and source of a record and gives its counts and lists, and nothing is
shuffled before metrics are pooled.  Metrics pool counts over records (micro averages), so
they combine map-side.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Schema, schemas
from ..functions import values as V
from ..functions.leaves import Leaf, flatten, parse
from .jsonops import parse_object

METRICS = ("exact_match", "schema_validity", "field_precision", "field_recall", "field_f1", "hallucination_rate", "missing_field_rate", "n_records")
EXCLUDED = ("ambiguate",)
_LAX_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*", re.ASCII)
_LAX_INT = re.compile(r"\s*[+-]?\d+(?:\.0+)?\s*", re.ASCII)
_MIDNIGHT = re.compile(r"(\d{4}-\d{2}-\d{2})(?:[T ]00:00(?::00(?:\.0+)?)?Z?)?", re.ASCII)
_TRUTH = frozenset("0 off f false n no 1 on t true y yes".split())
_NOT_FINITE = frozenset("nan inf -inf infinity -infinity".split())


class Rules(NamedTuple):
    """What a schema says about paths and strings; a name that is not registered has none of it."""

    types: dict[str, str] = {}
    model: frozenset[str] = frozenset()
    scalars: tuple[str, ...] = ()
    lists: tuple[str, ...] = ()
    ontology: dict[str, str] = {}
    #: By canonical form the surface forms that stand for it, all normalised.
    forms: dict[str, tuple[str, ...]] = {}


def _rules(s: Schema) -> Rules:
    surface: dict[str, str] = {}
    forms: dict[str, tuple[str, ...]] = {}
    for form, name in s.ontology.items():
        surface.setdefault(form.strip().lower(), name)
        forms[V.norm(name)] = (*forms.get(V.norm(name), ()), V.norm(form))
    scalars = tuple(f.path for f in s.fields if not f.repeated)
    lists = tuple(sorted({f.path.split("[]")[0] for f in s.fields if f.repeated}))
    return Rules({f.path: f.type for f in s.fields}, frozenset(s.paths("model")), scalars, lists, surface, forms)


def all_rules() -> dict[str, Rules]:
    """The rules of every schema that is registered with the driver, to be sent along."""
    return {s.name: _rules(s) for s in schemas()}


def canonical_of(rules: Rules, text: str) -> str:
    return rules.ontology.get(text.strip(" ").lower(), text)


def canonical(schema: Column, text: Column) -> Column:
    """A string after its schema's ontology; the first entry of a surface form counts."""
    table = {f"{named}|{form}": name for named, rules in all_rules().items() for form, name in rules.ontology.items()}
    found = F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), F.concat(schema, F.lit("|"), F.lower(F.trim(text))))
    return F.coalesce(found, text)


def fits(kind: str, text: str, type_: str) -> bool:
    """Whether a JSON scalar can be read as the declared type: numbers and booleans from strings, too."""
    if kind == "null":
        return True
    if type_ == "str":
        return kind == "str"
    if type_ in ("float", "decimal") and kind == "num":
        return True
    n = V.exact(text) if kind == "num" else None
    if type_ == "int":
        return kind == "bool" or (n is not None and n == n.to_integral_value()) or (kind == "str" and bool(_LAX_INT.fullmatch(text)))
    if type_ == "float":
        return kind in ("num", "bool") or (kind == "str" and (bool(_LAX_NUMBER.fullmatch(text)) or text.strip(" ").lower() in _NOT_FINITE))
    if type_ == "bool":
        return kind == "bool" or (n is not None and n in (0, 1)) or (kind == "str" and text.strip(" ").lower() in _TRUTH)
    if type_ == "decimal":
        return kind == "num" or (kind == "str" and bool(_LAX_NUMBER.fullmatch(text)))
    if kind == "num":
        return n is not None and abs(n) < 10**15 and n % 86_400 == 0
    day = _MIDNIGHT.fullmatch(text) if kind == "str" else None
    return day is not None and V.make_day(*day[1].split("-")) is not None


def breaks_schema(rules: Rules, leaf: Leaf) -> bool:
    """Whether a leaf shows that its record does not fit the schema; unknown keys do not."""
    path = leaf.path
    if (type_ := rules.types.get(path)) is not None:
        return leaf.in_list or leaf.empty or not fits(leaf.kind, leaf.text, type_)
    if any(path.startswith((f"{f}.", f"{f}[]")) for f in rules.scalars):
        return True
    for f in rules.lists:
        if path == f and (leaf.text != "[]" if leaf.empty else leaf.in_list or leaf.kind != "null"):
            return True
        if path.startswith(f"{f}.") or (path.startswith(f"{f}[]") and path.endswith("[]")):
            return True
    return False


class Value(NamedTuple):
    """A leaf's readings for comparison."""

    kind: str
    text: str
    name: str | None
    number: object
    day: object

    @property
    def key(self) -> tuple[str, object]:
        """What list elements match by: in lists a string is itself before it is a number or a date."""
        return self.kind, self.name if self.kind == "str" else self.text if self.number is None else self.number


def read(rules: Rules, leaf: Leaf) -> Value:
    if leaf.kind == "str":
        return Value("str", leaf.text, V.norm(canonical_of(rules, leaf.text)), V.number(leaf.text), V.day(leaf.text))
    return Value(leaf.kind, leaf.text, None, V.exact(leaf.text) if leaf.kind == "num" else None, None)


def scalars_equal(p: Value, r: Value) -> bool:
    """Equality of two leaves: nulls, booleans, numbers, dates, then strings."""
    if "null" in (p.kind, r.kind):
        return p.kind == r.kind
    if "bool" in (p.kind, r.kind):
        return p.kind == r.kind and p.text == r.text
    if p.number is not None and r.number is not None:
        return p.number == r.number
    if p.day is not None and r.day is not None:
        return p.day == r.day
    if p.kind == r.kind == "str":
        return p.name == r.name
    return p.kind == r.kind and p.text == r.text


class Side(NamedTuple):
    """The leaves of one side at one path."""

    listy: bool
    values: list[Value]

    @property
    def given(self) -> bool:
        return self.listy or self.values[0].kind != "null"


def _by_path(rules: Rules, leaves: Sequence[Leaf], known: dict[tuple[str, str], Value]) -> dict[str, Side]:
    """Sides by path; equal leaves of a record are read once and ``known`` then."""
    found: dict[str, list[Value]] = {}
    listy = set()
    for leaf in leaves:
        if leaf.empty:
            continue
        of = (leaf.kind, leaf.text)
        if (value := known.get(of)) is None:
            value = known[of] = read(rules, leaf)
        if (own := found.get(leaf.path)) is None:
            found[leaf.path] = [value]
        else:
            own.append(value)
        if leaf.listy:
            listy.add(leaf.path)
    return {path: Side(path in listy, own) for path, own in found.items()}


def _invented(rules: Rules, path: str, v: Value, source: str) -> bool:
    """Whether a predicted leaf is off the schema, or a string that the source does not have."""
    if path not in rules.types:
        return True
    return v.kind == "str" and v.text.strip(" ") != "" and v.number is None and v.day is None and v.name not in source


_ERROR = "struct<path:string,predicted:string,reference:string,p_kind:string,r_kind:string,listy:boolean>"
_COUNTS = "exact_match:boolean,schema_valid:boolean,n_correct:bigint,n_predicted:bigint,n_reference:bigint,n_missing:bigint,n_hallucinated:bigint"
COUNTS = f"struct<{_COUNTS}>"
RESULT = (
    f"struct<{_COUNTS},"
    f"missing:array<string>,hallucinated:array<string>,errors:array<{_ERROR}>,predicted:array<struct<path:string,texts:array<string>,listy:boolean>>>"
)
_STRINGS = pa.list_(pa.string())
ARROW_RESULT = pa.struct([
    *[(n, pa.bool_()) for n in ("exact_match", "schema_valid")],
    *[(n, pa.int64()) for n in ("n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated")],
    ("missing", _STRINGS), ("hallucinated", _STRINGS),
    ("errors", pa.list_(pa.struct([*[(n, pa.string()) for n in ("path", "predicted", "reference", "p_kind", "r_kind")], ("listy", pa.bool_())]))),
    ("predicted", pa.list_(pa.struct([("path", pa.string()), ("texts", _STRINGS), ("listy", pa.bool_())]))),
])
#: The flags and counts alone.
ARROW_COUNTS = pa.struct(list(ARROW_RESULT)[:7])


def _shown(side: Side) -> str:
    return json.dumps([v.text for v in side.values], ensure_ascii=False, separators=(",", ":")) if side.listy else side.values[0].text


def _common(a: Sequence[Value], b: Sequence[Value]) -> int:
    """How many values of a have a like one of their own in b."""
    left: dict[tuple[str, object], int] = {}
    for v in b:
        left[v.key] = left.get(v.key, 0) + 1
    n = 0
    for v in a:
        if left.get(v.key, 0):
            left[v.key] -= 1
            n += 1
    return n


def compare(rules: Rules, source: str | None, prediction: str | None, reference: str | None, lists: bool = True) -> dict:
    """The counts and lists of one record; both sides are JSON text of objects, or null.

    A null source leaves support unchecked.  Without ``lists`` errors and predicted values are left out.
    """
    predicted = [] if prediction is None else flatten(parse(prediction))
    known: dict[tuple[str, str], Value] = {}
    p_side = _by_path(rules, predicted, known)
    r_side = {} if reference is None else p_side if prediction == reference else _by_path(rules, flatten(parse(reference)), known)
    text = None if source is None else V.norm(source)
    out = {"n_correct": 0, "n_predicted": 0, "n_reference": 0, "n_missing": 0, "n_hallucinated": 0}
    missing, strays, errors, exact = [], [], [], True
    for path in sorted(p_side.keys() | r_side.keys()):
        p, r = p_side.get(path), r_side.get(path)
        n_p, n_r = len(p.values) if p else 0, len(r.values) if r else 0
        out["n_predicted"] += n_p
        out["n_reference"] += n_r
        if p and text is not None and (n := sum(_invented(rules, path, v, text) for v in p.values)):
            out["n_hallucinated"] += n
            strays.append(path)
        if r and r.given and not (p and p.given):
            missing.append(path)
            out["n_missing"] += n_r
        elif p and r and p.listy and r.listy:
            out["n_missing"] += max(n_r - n_p, 0)
        if not (p and r):
            exact = False
            continue
        if p.listy or r.listy:
            right = _common(p.values, r.values)
            same = right == n_p == n_r
            exact = exact and same and p.listy and r.listy
        else:
            same = scalars_equal(p.values[0], r.values[0])
            right = int(same)
            exact = exact and same
        out["n_correct"] += right
        if lists and not same:
            errors.append({"path": path, "predicted": _shown(p), "reference": _shown(r), "p_kind": p.values[0].kind, "r_kind": r.values[0].kind, "listy": p.listy or r.listy})
    valid = prediction is not None and not any(breaks_schema(rules, x) for x in predicted)
    if not lists:
        return out | {"exact_match": exact, "schema_valid": valid}
    given = [{"path": path, "texts": [v.text for v in s.values], "listy": s.listy} for path, s in sorted(p_side.items())]
    return out | {"exact_match": exact, "schema_valid": valid, "missing": missing, "hallucinated": strays, "errors": errors, "predicted": given}


def by_row(one: Callable[..., object], kind: pa.DataType) -> Callable[..., pa.Array]:
    """An Arrow function from a function of one row."""

    def run(*columns: pa.Array) -> pa.Array:
        return pa.array([one(*row) for row in zip(*(c.to_pylist() for c in columns), strict=True)], kind)

    return run


def evaluate_records(records: DataFrame, *keep: str, lists: bool = True) -> DataFrame:
    """One row a record: counts, flags, and the paths that are missing, hallucinated or wrong; ``keep`` are further columns.

    Without ``lists`` there are the counts and flags alone, which is all that metrics need.

    records: record_id, schema, source_text (null: support is not checked), tags,
    prediction and reference (VARIANT).  Rows are judged each by itself, also where they
    share a record_id.
    """
    rules, none = all_rules(), Rules()
    kind, arrow = (RESULT, ARROW_RESULT) if lists else (COUNTS, ARROW_COUNTS)
    judge = F.arrow_udf(by_row(lambda schema, *sides: compare(rules.get(schema, none), *sides, lists), arrow), kind)
    found = judge("schema", "source_text", F.to_json("prediction"), F.to_json("reference"))
    names = ("record_id", "schema", "tags", *keep)
    return records.select(*names, found.alias("_found")).select(*names, "_found.*")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


_COUNTED = ("exact_match", "schema_valid", "n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated")


def pooled(n: Column | None = None) -> list[Column]:
    """The eight metrics as aggregates over evaluated records; n is how many, if not the rows."""
    n = F.count(F.lit(1)) if n is None else n
    total = {k: F.sum(k) for k in ("n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated")}
    # 2PR / (P + R) in whole counts
    values = (
        ratio(F.count_if("exact_match"), n), ratio(F.count_if("schema_valid"), n), ratio(total["n_correct"], total["n_predicted"]),
        ratio(total["n_correct"], total["n_reference"]), ratio(2 * total["n_correct"], total["n_predicted"] + total["n_reference"]),
        ratio(total["n_hallucinated"], total["n_predicted"]), ratio(total["n_missing"], total["n_reference"]), n.cast("double"),
    )
    return [v.cast("double").alias(name) for name, v in zip(METRICS, values, strict=True)]


def field_f1() -> Column:
    """The F1 of one evaluated record."""
    return ratio(2 * F.col("n_correct"), F.col("n_predicted") + F.col("n_reference")).cast("double")


def aggregate(results: DataFrame) -> DataFrame:
    """The pooled metrics in one row; all zero for no records."""
    return results.agg(*pooled())


def sliced(results: DataFrame, exclude: Sequence[str] = EXCLUDED) -> DataFrame:
    """(slice_kind, slice, metrics): overall, schema, tag and excluded slices.

    Records with an excluded tag count in tag and excluded slices only.  Overall and excluded
    slices without records still have a row.  Every record is turned into its slices and
    there is one aggregation, whose sums combine before the only shuffle.
    """
    kind = "array<struct<slice_kind:string,slice:string>>"
    tags = F.coalesce("tags", F.expr("cast(array() as array<string>)"))
    out = F.array_intersect(tags, F.array(*[F.lit(t) for t in exclude]).cast("array<string>"))
    one = lambda k, v: F.struct(F.lit(k).alias("slice_kind"), v.alias("slice"))
    none = F.expr(f"cast(array() as {kind})")
    inside = F.when(F.size(out) == 0, F.array(one("overall", F.lit("")), one("schema", F.col("schema"))).cast(kind)).otherwise(none)
    of = lambda k, found: F.transform(found, lambda t: one(k, t)).cast(kind)
    rows = results.select(F.explode(F.concat(inside, of("tag", F.array_distinct(tags)), of("excluded", out))).alias("_s"), *_COUNTED, F.lit(1).cast("long").alias("_n"))
    always = F.array(one("overall", F.lit("")), *[one("excluded", F.lit(t)) for t in exclude]).cast(kind)
    null = lambda c: F.lit(None).cast("boolean" if c in _COUNTED[:2] else "long").alias(c)
    spine = results.sparkSession.range(1).select(F.explode(always).alias("_s"), *map(null, _COUNTED), F.lit(0).cast("long").alias("_n"))
    return rows.union(spine).groupBy("_s").agg(*pooled(F.sum("_n"))).select("_s.*", *METRICS)


def metric_table(slices: DataFrame, names: Sequence[str]) -> DataFrame:
    """Metrics by row and slices by column, for printing."""
    long = slices.unpivot(["slice"], list(METRICS), "metric", "value")
    return long.groupBy("metric").pivot("slice", list(names)).agg(F.first("value"))


def with_predictions(records: DataFrame, predictions: DataFrame) -> DataFrame:
    """records joined with predictions (record_id, raw) on the id; raw text is parsed leniently."""
    p = predictions.select("record_id", parse_object(F.col("raw")).alias("prediction"))
    return records.join(p, "record_id", "left")
