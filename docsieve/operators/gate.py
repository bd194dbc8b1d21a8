"""The validation gate: parse, schema, support in the source, nothing beyond the schema.

Steps run in order and the first that fails gives the reason.  An output is judged by one
Arrow function of its own row, so nothing is shuffled; the fuzzy part of the third step
(difflib's ratio) only sees strings that the literal test did not support.  A null source
supports nothing.
"""

from __future__ import annotations

import difflib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.leaves import flatten, parse
from ..functions.values import norm
from .jsonops import parse_object
from .metrics import Rules, all_rules, breaks_schema, by_row

THRESHOLD = 0.85
#: What each step says; step 1 names no path.
REASONS = {
    1: "step1_json_parse: no JSON object in the output", 2: "step2_schema_validation: ",
    3: "step3_source_support: ", 4: "step4_no_overassertion: ",
}
_RESULT = "struct<accepted:boolean,step:int,reasons:array<string>,unsupported_fields:array<string>>"
_ARROW = pa.struct([("accepted", pa.bool_()), ("step", pa.int32()), ("reasons", pa.list_(pa.string())), ("unsupported_fields", pa.list_(pa.string()))])


def fuzzy_supported(value: str, source: str, threshold: float = THRESHOLD) -> bool:
    """Whether as many words of the source as the value has come close to it.

    Both are normalised already.  Length and letter counts bound the ratio from above, so
    most windows are passed over without aligning.
    """
    words, size = source.split(), len(value.split())
    if not size or len(words) < size:
        return False
    match = difflib.SequenceMatcher(None)
    match.set_seq1(value)
    for i in range(len(words) - size + 1):
        window = " ".join(words[i : i + size])
        match.set_seq2(window)
        if match.real_quick_ratio() >= threshold and match.quick_ratio() >= threshold and match.ratio() >= threshold:
            return True
    return False


def supported(rules: Rules, text: str, source: str, threshold: float | None) -> bool:
    """Whether the source has the string, a surface form that stands for it, or (with a threshold) something close."""
    value = norm(text)
    if value in source or any(form in source for form in rules.forms.get(value, ())):
        return True
    return threshold is not None and fuzzy_supported(value, source, threshold)


def judge(rules: Rules, source: str | None, output: str | None, threshold: float | None = None) -> dict:
    """The result for one output: the JSON text of the object in it, or None."""

    def rejected(step: int, paths: set[str]) -> dict:
        named = sorted(paths)
        return {"accepted": False, "step": step, "reasons": [REASONS[step] + ", ".join(named)], "unsupported_fields": named if step == 3 else []}

    if output is None:
        return rejected(1, set())
    leaves = flatten(parse(output))
    if broken := {x.path for x in leaves if breaks_schema(rules, x)}:
        return rejected(2, broken)
    text = norm(source or "")
    checked = (x for x in leaves if x.kind == "str" and x.text and x.path in rules.model)
    if stray := {x.path for x in checked if not supported(rules, x.text, text, threshold)}:
        return rejected(3, stray)
    if extra := {x.path for x in leaves if not x.empty and x.path not in rules.types}:
        return rejected(4, extra)
    return {"accepted": True, "step": None, "reasons": [], "unsupported_fields": []}


def gate(outputs: DataFrame, fuzzy: bool = False, threshold: float = THRESHOLD) -> DataFrame:
    """record_id, accepted, step (1 to 4, null if accepted), reasons, unsupported_fields.

    outputs: record_id, schema, source_text, raw.
    """
    limit = threshold if fuzzy else None
    rules, none = all_rules(), Rules()
    run = F.arrow_udf(by_row(lambda schema, source, output: judge(rules.get(schema, none), source, output, limit), _ARROW), _RESULT)
    found = run("schema", "source_text", F.to_json(parse_object(F.col("raw"))))
    return outputs.select("record_id", found.alias("_found")).select("record_id", "_found.*")


def rejection_rate(results: DataFrame) -> DataFrame:
    """The share of rejected outputs in one row; no outputs are an error."""
    n = F.count(F.lit(1))
    return results.agg(F.when(n > 0, F.count_if(~F.col("accepted")) / n).otherwise(F.raise_error(F.lit("no results to rate"))).alias("rejection_rate"))


def top_reasons(results: DataFrame, n: int = 10) -> DataFrame:
    """The most frequent rejection reasons (a report of n rows), ties by text."""
    return results.select(F.explode("reasons").alias("reason")).groupBy("reason").count().orderBy(F.desc("count"), "reason").limit(n)


def regate(outputs: DataFrame, earlier: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Earlier results, with those that were rejected judged again with fuzzy support."""
    rejected = outputs.join(earlier.filter(~F.col("accepted")).select("record_id"), "record_id", "left_semi")
    return earlier.filter("accepted").unionByName(gate(rejected, fuzzy=True, threshold=threshold))
