"""What corrupted documents have in common with their seeds, for Spark and as DuckDB SQL.

Draws by place are no matter of SQL, so the queries show what does not depend on them: a
text with everything replaced that an operator may replace, its words without their order,
or the text itself where severity 0 or 1 leaves no choice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources import corrupt as CO
from ..sources.seeds import SEEDS
from .seed_sql import seed_sql

SEED = 11
LEVELS = (0.0, 0.5, 1.0)
Shown = Callable[[Column, Column], Column]


def _sure(text: Column, severity: Column) -> Column:
    """The text of severities that leave no choice."""
    return F.when(severity.isin(0.0, 1.0), text)


def _words(text: Column, severity: Column) -> Column:
    """The words in order, without commas and fillers."""
    for filler in CO.FILLERS:
        text = F.replace(text, F.lit(filler), F.lit(" "))
    words = F.filter(F.split(F.replace(text, F.lit(","), F.lit(" ")), r"\s+"), lambda w: w != "")
    return F.array_join(F.array_sort(words), " ")


def _replaced(table: dict[str, str]) -> Shown:
    return lambda text, severity: CO.replace_each(text, CO.any_of(list(table)), lambda m, i: F.element_at(CO.as_map(table), m))


def _bare(text: Column, severity: Column) -> Column:
    """The text without labels, words for kinds of document, and white space."""
    pattern = rf"(?m)^\s*(?:{CO.any_of([f'{x}:' for x in CO.GLOSSARY])}|(?:{'|'.join(CO.KINDS)})\b)"
    return F.regexp_replace(F.regexp_replace(text, pattern, ""), r"\s+", "")


#: Every form of a label or word as one sign.
_FORMS = {f"{form}:": "#" for label, forms in CO.GLOSSARY.items() for form in (label, *forms[1:])}
_FORMS |= {word: "#" for table in CO.TRANSLATED for pair in table.items() for word in pair}
_SYNONYMS = {f"{x}:": f"{y[0]}:" for x, y in CO.GLOSSARY.items()} | CO.PHRASES

SHOWN: dict[str, Shown] = {
    "ocr_noise": lambda text, severity: F.when(severity == 0.0, text), "typo": lambda text, severity: F.when(severity == 0.0, text),
    "delabel": _bare, "reorder": _words, "abbreviate": _replaced(CO.SHORT), "synonym": _replaced(_SYNONYMS), "code_switch": _replaced(_FORMS),
    "nest": lambda text, severity: text, "implicit": _sure, "ambiguate": lambda text, severity: text,
}


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _literal(text: str) -> str:
    """A pattern for the text as it stands."""
    return "".join(f"\\{c}" if c in ".()[]{}*+?|^$\\-/" else c for c in text)


def _nested(table: dict[str, str], text: str = "text") -> str:
    for old in sorted(table, key=len, reverse=True):
        text = f"replace({text}, {_q(old)}, {_q(table[old])})"
    return text


def _marked(words: list[str], text: str = "text") -> str:
    """Any of the words, the longest first, as one sign."""
    pattern = "|".join(_literal(w) for w in sorted(words, key=len, reverse=True))
    return f"regexp_replace({text}, {_q(pattern)}, '#', 'g')"


_LABELLED = "|".join(_literal(f"{x}:") for x in sorted(CO.GLOSSARY, key=len, reverse=True))
_TEXTS = {
    "ocr_noise": "CASE WHEN level = 0 THEN text END",
    "typo": "CASE WHEN level = 0 THEN text END",
    "delabel": f"regexp_replace(regexp_replace(text, {_q(rf'(?m)^\s*(?:{_LABELLED}|(?:{"|".join(CO.KINDS)})\b)')}, '', 'g'), '\\s+', '', 'g')",
    "reorder": "array_to_string(list_sort(list_filter(string_split_regex(replace(text, ',', ' '), '\\s+'), lambda w: w <> '')), ' ')",
    "abbreviate": _nested(CO.SHORT),
    "synonym": _nested(_SYNONYMS),
    "code_switch": _marked(list(_FORMS)),
    "nest": """CASE WHEN level = 0 OR schema <> 'insurance_claim' THEN text ELSE
        regexp_replace(regexp_replace(text, '(?m)^Filed by: (.*)$', 'People concerned: first \\1 as Claimant'), '(?m)^Also involved: (.*)$', 'second \\1') END""",
}
_GOLD = {
    "nest": """CASE WHEN level = 0 OR schema <> 'insurance_claim' THEN reference ELSE replace(reference, '"involved_parties":[',
        '"involved_parties":[{"name":"' || json_extract_string(reference, '$.claimant_name') || '","role":"Claimant"},') END""",
}


def _once(text: str, old: str, new: str) -> str:
    return f"CASE WHEN strpos({text}, {old}) > 0 THEN left({text}, strpos({text}, {old}) - 1) || {new} || substring({text}, strpos({text}, {old}) + length({old})) ELSE {text} END"


def _ambiguate(base: str) -> str:
    confusable = "CASE v " + " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in CO.CONFUSABLE.items()) + " END"
    other = f"CASE WHEN regexp_matches(v, '^\\d[\\d,]*\\.\\d{{2}}$') THEN split_part(v, '.', 1) || '.' || reverse(split_part(v, '.', -1)) ELSE {confusable} END"
    return f"""SELECT b.*, CASE WHEN level = 0 OR v IS NULL THEN text ELSE {_once('text', 'v', "v || ', if not ' || o || ','")} END AS shown FROM ({base}) b
      LEFT JOIN (SELECT record_id AS r, v, o FROM (SELECT record_id, v, {other} AS o, text
        FROM (SELECT record_id, text, unnest(regexp_extract_all(reference, '[:\\[,]"([^"\\\\]+)"[,}}\\]]', 1)) AS v FROM ({base}))) WHERE o <> v AND contains(text, v)
        QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY v) = 1) ON r = record_id"""


def _implicit(base: str, ordinal: str) -> str:
    age = "regexp_extract(text, '\\b(\\d{1,2}) years of age\\b', 1)"
    told = f"CASE WHEN {age} = '' THEN text ELSE {_once('text', f"({age} || ' years of age')", f"('who has completed the ' || {ordinal} || ' year of life')")} END"
    days = "list_sort(list_distinct(list_filter(regexp_extract_all(reference, '[:\\[,]\"([^\"\\\\]+)\"[,}\\]]', 1), lambda x: regexp_matches(x, '^\\d{4}-\\d{2}-\\d{2}$') AND contains(t1, x))))"
    when = "CASE WHEN len(days) < 2 THEN 'not long ago' ELSE (days[2]::DATE - days[1]::DATE)::VARCHAR || ' days ahead of ' || days[2] END"
    sums = "[" + ", ".join(f"{{'v': json_extract_string(reference, '$.{k}'), 'p': {_q(p)}}}" for k, p in CO.TOTALS.items()) + "]"
    return f"""SELECT * EXCLUDE (n, t1, days, t2, found), CASE level WHEN 0 THEN text WHEN 2 THEN CASE WHEN len(found) = 0 THEN t2 ELSE {_once('t2', 'found[1].v', 'found[1].p')} END END AS shown FROM (
      SELECT *, list_filter({sums}, lambda x: coalesce(contains(t2, x.v), false)) AS found FROM (
      SELECT *, CASE WHEN len(days) = 0 THEN t1 ELSE {_once('t1', 'days[1]', when)} END AS t2 FROM (
      SELECT *, {days} AS days FROM (SELECT *, {told} AS t1 FROM (SELECT *, coalesce(try_cast({age} AS INT), 0) AS n FROM ({base}))))))"""


def base_sql(names: Sequence[str] = tuple(sorted(SEEDS)), seed: int = SEED) -> str:
    """record_id, schema, text, reference, level (0 to 2) of the seeds that the queries corrupt."""
    n = "(SELECT greatest(1, count(*) // 30) FROM customer)"
    blocks = [f"SELECT * FROM ({seed_sql(name, f'SELECT {i} * {len(LEVELS)} * {n} + range AS k FROM range({len(LEVELS)} * {n})', seed)})" for i, name in enumerate(names)]
    return f"SELECT record_id, schema, source_text AS text, reference, (record_id % ({len(LEVELS)} * {n})) // {n} AS level FROM ({' UNION ALL '.join(blocks)})"


def generate_sql() -> str:
    """What ``corpus_generate`` shows."""
    return f"""SELECT record_id, schema, reference, 'severity=' || ['0.0', '0.5', '1.0'][(level + 1)::INT] AS severity, level > 0 AS changed, CASE WHEN level = 0 THEN text END AS clean
FROM ({base_sql(("invoice", "medical_note"), 7)})"""


def corrupt_sql(operator: str, ordinal: str) -> str:
    """record_id, schema, reference, shown; ordinal is SQL for the words of ordinal n."""
    base = base_sql()
    if operator == "ambiguate":
        rows = _ambiguate(base)
    elif operator == "implicit":
        rows = _implicit(base, ordinal)
    else:
        rows = f"SELECT *, {_TEXTS[operator]} AS shown FROM ({base})"
    return f"SELECT record_id, schema, {_GOLD.get(operator, 'reference')} AS reference, shown FROM ({rows})"
