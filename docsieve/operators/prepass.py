"""The deterministic pre-pass: what patterns resolve of a document's fields.

One Arrow function reads a document once: each extractor runs once a document, and the
schema's bindings share its matches.  The plan has one node whatever the schema, and a table
may mix schemas.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..catalog import Schema, get_schema, schemas
from ..functions import extract as X
from ..functions import spans
from ..functions.spans import Found

#: Rules that pick one match; ``after`` takes the first at or after the label.
RULES = ("first", "last", "max", "min", "after")


@dataclass(frozen=True)
class Binding:
    """How a field is found: an extractor, the rule that picks a match, and what they need."""

    extractor: str
    rule: str = "first"
    label: str = ""
    patterns: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.rule not in RULES:
            raise ValueError(f"unknown selection rule {self.rule!r}")
        if self.rule == "after" and not self.label:
            raise ValueError("the rule 'after' needs a label")
        if self.extractor == "identifiers" and not self.patterns:
            raise ValueError("identifiers need patterns")


def _after(word: str, extractor: str) -> Binding:
    return Binding(extractor, "after", rf"(?i){word}\s*[:.]?")


_NOT_IN_WORD = "(?<![a-z0-9])"
#: Label patterns and identifier patterns by schema and field.
BINDINGS: dict[str, dict[str, Binding]] = {
    "invoice": {
        "invoice_number": Binding("identifiers", patterns=(r"\bINV-?\d+\b", r"\bINVOICE\s*#\s*\d+\b")),
        "invoice_date": _after("date", "dates"),
        "due_date": _after("due", "dates"),
        "vendor_email": _after("vendor", "emails"),
        "vendor_phone": _after("vendor", "phones"),
        "total_amount": _after(f"{_NOT_IN_WORD}total", "money"),
        "tax_amount": _after(f"{_NOT_IN_WORD}tax", "money"),
    },
    "contract": {"start_date": _after("start", "dates"), "end_date": _after("end", "dates"), "liability_cap": _after(r"liab\w*", "money")},
    "conversation": {"started_date": _after("start(?:ed)?", "dates")},
    "crm_record": {
        "email": Binding("emails"),
        "phone": Binding("phones"),
        "deal_value": _after(f"{_NOT_IN_WORD}value", "money"),
        "last_contact_date": _after(r"last\s+contact", "dates"),
    },
    "email": {
        "sender_email": _after(f"{_NOT_IN_WORD}from", "emails"),
        "recipient_email": _after(f"{_NOT_IN_WORD}to", "emails"),
        "sent_date": _after("sent", "dates"),
    },
    "form": {
        "form_id": Binding("identifiers", patterns=(r"\b(?:FORM|FRM)-?\d+\b",)),
        "submitted_date": _after("submitted", "dates"),
        "submitter_email": _after("submitter", "emails"),
    },
    "insurance_claim": {
        "claim_number": Binding("identifiers", patterns=(r"\b(?:CLM|CLAIM)-?\d+\b",)),
        "policy_number": Binding("identifiers", patterns=(r"\b(?:POLICY|POL)-?\d+\b",)),
        "incident_date": _after("incident", "dates"),
        "amount_requested": _after("amount", "money"),
    },
    "kg_triple": {"extracted_date": _after("extracted", "dates")},
    "medical_note": {"visit_date": _after("visit", "dates"), "follow_up_date": _after(r"follow\s*-?\s*up", "dates")},
    "receipt": {
        "receipt_number": Binding("identifiers", patterns=(r"\b(?:RECEIPT|REC)-?\d+\b",)),
        "receipt_date": _after("receipt", "dates"),
        "total_amount": _after(f"{_NOT_IN_WORD}total", "money"),
        "tax_amount": _after(f"{_NOT_IN_WORD}tax", "money"),
    },
    "resume": {"email": Binding("emails"), "phone": Binding("phones")},
    "support_ticket": {
        "ticket_id": Binding("identifiers", patterns=(r"\b(?:TKT|TCKT|TICKET)-?\d+\b",)),
        "created_date": _after("created", "dates"),
        "customer_email": _after("(?:customer|user)", "emails"),
    },
}


def check_bindings(bindings: dict[str, dict[str, Binding]] = BINDINGS) -> None:
    """Every binding names a scalar field that patterns own."""
    for name, fields in bindings.items():
        allowed = set(get_schema(name).paths("rule"))
        for path in fields:
            if path not in allowed or "[]" in path:
                raise ValueError(f"{name}.{path} is no scalar field that patterns own")


check_bindings()

SEGMENT = re.compile(r"[^\n]+?(?:[.!?]+(?=\s|$)|\n|$)")
QUANTITY = re.compile(r"\b(?:x\s*(\d+)|(\d+)\s*@)", re.IGNORECASE)
ITEM_LEAVES = ("quantity", "unit_price", "line_total")


@lru_cache(maxsize=256)
def _pattern(label: str) -> tuple[re.Pattern, re.Pattern | None]:
    """A label's pattern, and one that finds the same in an ASCII text in lower case, which is faster, if there is one.

    That is the pattern without ``(?i)``, if it has no capital and no escape but of classes, bounds and marks.
    """
    body = label.removeprefix("(?i)")
    low = body != label and body.isascii() and body == body.lower() and "(?i)" not in body and not re.search(r"\\[^wsdb\W]", body)
    return re.compile(label), re.compile(body) if low else None


def _label_at(text: str, label: str) -> int:
    """Where the label first is, or -1."""
    whole, low = _pattern(label)
    at = whole.search(text) if low is None or not text.isascii() else low.search(text.lower())
    return at.start() if at else -1


def pick(text: str, found: list[Found], binding: Binding) -> Found | None:
    """The extraction that the binding's rule picks.

    The earliest match at or after any place of a label is the earliest at or after its first.
    """
    if binding.rule in ("max", "min"):
        return spans.extremum(found, binding.rule == "max")
    if binding.rule == "after":
        at = _label_at(text, binding.label) if found else -1
        return next((f for f in found if f.start >= at), None) if at >= 0 else None
    return (found[-1] if binding.rule == "last" else found[0]) if found else None


def select_match(text: Column, found: Column, binding: Binding) -> Column:
    """The extraction that the binding's rule picks, or null."""

    def run(texts: pa.Array, rows: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), rows.to_pylist(), strict=True)
        return X.extraction_array([None if t is None else pick(t, X.as_found(r), binding) for t, r in pairs])

    return F.arrow_udf(run, X.EXTRACTION)(text, found)


def line_items(text: str) -> dict[str, list[Found]]:
    """By leaf the extractions of all line items, in order.

    A segment up to a line or sentence end is an item if it has a quantity (``x 4`` or
    ``4 @``) and an amount.  A single amount is the line's total; else the price is the first
    behind ``@`` and the total the first behind ``=``.
    """
    out: dict[str, list[Found]] = {leaf: [] for leaf in ITEM_LEAVES}
    for segment in SEGMENT.finditer(text):
        raw, begin = segment[0], segment.start()
        # a quantity has a digit and one of these; a look at the letters is less than a search
        quantity = QUANTITY.search(raw) if "@" in raw or "x" in raw or "X" in raw else None
        amounts = spans.without_overlaps(spans.money(raw)) if quantity else []
        if not amounts:
            continue

        out["quantity"].append(Found(quantity[1] or quantity[2], quantity.start() + begin, quantity.end() + begin, quantity[0], "line_items"))
        if len(amounts) == 1:
            _behind(out["line_total"], amounts, 0, begin)
        else:
            _behind(out["unit_price"], amounts, raw.find("@"), begin)
            _behind(out["line_total"], amounts, raw.find("="), begin)
    return out


def _behind(out: list[Found], amounts: list[Found], at: int, begin: int) -> None:
    """Adds the first amount from ``at`` on, if that is a place, moved by ``begin``."""
    if at >= 0:
        for value, start, end, raw, extractor, confidence in amounts:
            if start >= at:
                out.append(Found(value, start + begin, end + begin, raw, extractor, confidence))
                return


class Resolved(NamedTuple):
    """A field that patterns resolved: its values and the first extraction."""

    path: str
    values: list[str]
    repeated: bool
    first: Found


def _extract(b: Binding, text: str, region: str, dayfirst: bool) -> list[Found]:
    plain: dict[str, Callable[[str], list[Found]]] = {"emails": spans.emails, "urls": spans.urls, "money": spans.money, "percentages": spans.percentages}
    if b.extractor in plain:
        found = plain[b.extractor](text)
    elif b.extractor == "dates":
        found = spans.dates(text, dayfirst)
    elif b.extractor == "phones":
        found = spans.phones(text, region)
    else:
        found = spans.identifiers(text, b.patterns)
    return spans.without_overlaps(found)


def resolve(spec: Schema, text: str | None, region: str = "US", dayfirst: bool = False, bindings: dict[str, Binding] | None = None) -> list[Resolved]:
    """What patterns (without ``bindings`` the schema's own) resolve of one document, by path."""
    if text is None:
        return []
    out, found = [], {}
    for path, b in (BINDINGS.get(spec.name, {}) if bindings is None else bindings).items():
        of = (b.extractor, b.patterns)
        if of not in found:
            found[of] = _extract(b, text, region, dayfirst)
        if (f := pick(text, found[of], b)) is not None:
            out.append(Resolved(path, [f.value], False, f))
    owned = {f.path.rsplit(".", 1)[1]: f.path for f in spec.fields if f.repeated and f.owner == "rule"}
    if wanted := {leaf: path for leaf, path in owned.items() if leaf in ITEM_LEAVES}:
        items = line_items(text)
        out += [Resolved(path, [f.value for f in items[leaf]], True, items[leaf][0]) for leaf, path in wanted.items() if items[leaf]]
    return sorted(out, key=lambda r: r.path)


LEAF = "struct<path:string,values:array<string>,repeated:boolean,first:" + X.EXTRACTION + ">"
_DONE = f"struct<resolved:array<{LEAF}>,unresolved:array<string>>"
_FIELDS = [("path", pa.string()), ("values", pa.list_(pa.string())), ("repeated", pa.bool_()), ("first", X.ARROW_EXTRACTION)]


def _leaf_array(rows: list[Resolved]) -> pa.StructArray:
    columns = [pa.array([r[i] for r in rows], kind) for i, (_, kind) in enumerate(_FIELDS[:3])]
    return pa.StructArray.from_arrays([*columns, X.extraction_array([r.first for r in rows])], fields=[pa.field(*f) for f in _FIELDS])


def _prepass(specs: dict[str, tuple[Schema, dict[str, Binding]]], region: str, dayfirst: bool, texts: pa.Array, names: pa.Array) -> pa.Array:
    done, left = [], []
    for text, name in zip(texts.to_pylist(), names.to_pylist(), strict=True):
        spec, bindings = specs.get(name, (None, {}))
        found = [] if spec is None else resolve(spec, text, region, dayfirst, bindings)
        taken = {r.path for r in found}
        done.append(found)
        left.append([] if spec is None else [p for p in spec.paths() if p not in taken])
    return pa.StructArray.from_arrays([X.list_array(done, _leaf_array), pa.array(left, pa.list_(pa.string()))], names=["resolved", "unresolved"])


def prepass(docs: DataFrame, schema: str | Schema | None = None, text: str = "source_text", region: str = "US", dayfirst: bool = False) -> DataFrame:
    """docs with ``resolved`` (path, values, repeated, first extraction) and ``unresolved`` paths.

    Without a schema each row's own, in column ``schema``, is taken; rows of an unknown one
    have nothing resolved and nothing left.  ``resolved`` is sorted by path; paths that nothing
    matched are left to the model.
    """
    if schema is None:
        specs, name = {s.name: s for s in schemas()}, F.col("schema")
    else:
        spec = get_schema(schema) if isinstance(schema, str) else schema
        specs, name = {spec.name: spec}, F.lit(spec.name)
    if region not in spans.REGIONS:
        raise ValueError(f"unsupported region {region!r} for phone numbers")
    # what is registered with the driver goes along
    run = partial(_prepass, {k: (v, BINDINGS.get(k, {})) for k, v in specs.items()}, region, dayfirst)
    done = docs.withColumn("_done", F.arrow_udf(lambda texts, names: run(texts, names), _DONE)(F.col(text), name))
    return done.select(*[F.col(f"`{c}`") for c in docs.columns], "_done.resolved", "_done.unresolved")


def resolved_rows(done: DataFrame, key: str = "record_id") -> DataFrame:
    """(key, path, values, repeated, first): one row a resolved field.

    The outer form of inline, since the filter that the optimiser infers for the other one
    would evaluate every extractor again.
    """
    return done.select(key, F.inline_outer("resolved")).filter("path is not null")


def _request(fields: Column, text: Column) -> Column:
    return F.concat(
        F.lit("Return one JSON object with these fields of the document, and null where it does not say: "),
        F.array_join(F.array_sort(fields), ", "), F.lit("\n\nDocument:\n"), text, F.lit("\n\nJSON:"),
    )


def residual_prompt(fields: Column, text: Column) -> Column:
    """A request for the listed fields of a document."""
    return _request(fields, text)


def semantic_prompt(schema: Column, text: Column) -> Column:
    """A request for the fields of a document that its schema leaves to the model; null for an unknown schema."""
    owned = F.create_map(*[x for s in schemas() for x in (F.lit(s.name), F.array(*[F.lit(p) for p in s.paths("model")]))])
    return _request(F.try_element_at(owned, schema), text)
