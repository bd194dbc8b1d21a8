"""DuckDB SQL for ``more_queries`` and for reports of several steps."""

from __future__ import annotations

from .. import catalog
from ..sources.corrupt import OPERATORS
from .corrupt_sql import corrupt_sql, generate_sql
from .oracle import _RECORDS, ORACLE

_TAGS = "CASE WHEN amb THEN 'typo,ambiguate,severity=0.5' ELSE 'typo,severity=0.5' END"
_NUMBER = "CASE schema WHEN 'invoice' THEN 'INV-' ELSE 'TKT-' END || k"
_SOURCE = f"{_NUMBER} || ' for V' || o_custkey || ' on ' || day"
_CLAMPED = "greatest(least(c, 1 - 1e-6), 1e-6)"


def _values(rows: list[tuple], names: str) -> str:
    one = lambda v: "NULL" if v is None else str(v).lower() if isinstance(v, bool) else repr(v)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(one, r)) + ')' for r in rows)}) t({names})"


def _calibrated(t: str) -> str:
    z = f"((ln({_CLAMPED}) - ln(1 - {_CLAMPED})) / {t})"
    return f"CASE WHEN {z} >= 0 THEN 1 / (1 + exp(-{z})) ELSE exp({z}) / (1 + exp({z})) END"


def _ece(rows: str, c: str) -> str:
    return f"(SELECT sum(abs(y - c)) / sum(n) FROM (SELECT least(floor(c * 10), 9) AS bin, sum(c) AS c, sum(y) AS y, count(*) AS n FROM (SELECT {c} AS c, y FROM {rows}) GROUP BY 1))"


#: Whether each of more_queries.LAX fits its schema.
_LAX = [True, True, False, True, False, False, True, False, True, True, False, True, False, False, False, True, True, False]
_ORDINALS = "['zeroth','zero-first','zero-second','zero-third','zero-fourth','zero-fiveth','zero-sixth','zero-seventh','zero-eightth','zero-nineth','tenth','eleventh','twelfth','thirteenth','fourteenth','fifteenth','sixteenth','seventeenth','eighteenth','nineteenth']"
_AFTER = "['first','second','third','fourth','fiveth','sixth','seventh','eightth','nineth']"
_TENS = "['twent','thirt','fort','fift','sixt','sevent','eight','ninet']"

_ORDINAL = f"CASE WHEN n < 20 THEN {_ORDINALS}[n + 1] WHEN n % 10 = 0 THEN {_TENS}[n // 10 - 1] || 'ieth' ELSE {_TENS}[n // 10 - 1] || 'y-' || {_AFTER}[n % 10] END"

ORACLE |= {f"corrupt_{name}": corrupt_sql(name, f"({_ORDINAL})") for name in OPERATORS}
ORACLE["corpus_generate"] = generate_sql()
ORACLE |= {
    "jsonl_scan": f"WITH {_RECORDS} SELECT schema, {_SOURCE} AS source_text, {_NUMBER} AS number, {_TAGS} AS tags FROM (SELECT *, k % 11 = 0 AS amb FROM r)",
    "jsonl_scan_errors": """SELECT [NULL, 'not a JSON object', 'schema must be a non-empty string', 'reference must be an object', 'tags must be a list of strings'][c_custkey % 5 + 1] AS error, count(*) AS n
        FROM customer GROUP BY 1""",
    "corpus_scan": f"""WITH {_RECORDS} SELECT schema, {_SOURCE} AS source_text, (CASE WHEN k % 11 = 0 THEN 3 ELSE 2 END)::INT AS n_tags,
        length('{{"' || names[2] || '":"' || {_NUMBER} || '","' || names[3] || '":"V' || o_custkey || '","' || names[1] || '":"' || day || '"}}')::INT AS reference_length FROM r""",
    "json_array_scan": "SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation",
    "report_fields": "SELECT count(*)::VARCHAR AS n, max(c_custkey)::VARCHAR AS last, NULL::VARCHAR AS absent FROM customer",
    "split_admitted": f"WITH {_RECORDS} SELECT k AS record_id, CASE WHEN m IN (2, 4, 5) THEN 'false' ELSE 'true' END AS folder FROM r",
    "state_log": "SELECT r_regionkey::VARCHAR AS step, CASE WHEN r_regionkey % 2 = 1 THEN r_name END AS name FROM region",
    "corpus_command": "SELECT s AS schema, t AS tags, (SELECT count(*) FROM nation) AS n FROM (VALUES ('email'), ('form')) a(s), (VALUES ('severity=0.0'), ('synonym,severity=1.0')) b(t)",
    "file_digests": "SELECT sha256(string_agg(n_name, chr(10) ORDER BY n_nationkey) || chr(10)) AS sha256 FROM nation",
    "generation_summary": f"WITH {_RECORDS} SELECT round(sum(k % 17) / sum((k % 9 + 1) / 10), 6) AS tokens_per_second, round(avg((m <> 5)::INT), 6) AS valid_json FROM r",
    "semantic_prompt": f"""WITH {_RECORDS} SELECT k AS record_id, 'Return one JSON object with these fields of the document, and null where it does not say: '
        || CASE schema WHEN 'invoice' THEN 'line_items[].description, vendor_name' ELSE 'intent, issue_category, product, resolution_status, sentiment, urgency' END
        || chr(10) || chr(10) || 'Document:' || chr(10) || {_SOURCE} || chr(10) || chr(10) || 'JSON:' AS prompt FROM r""",
    "registry_lookup": _values(
        [("contract", True, 8), ("conversation", True, 7), ("crm_record", True, 9), ("email", True, 8), ("form", True, 8), ("insurance_claim", True, 9), ("invoice", True, 12),
         ("kg_triple", True, 8), ("medical_note", True, 8), ("receipt", True, 12), ("resume", True, 8), ("support_ticket", True, 9), ("poem", False, 0)], "name, known, fields"),
    "split_guard": _values([("train", 9, False), ("eval", 3, True), ("any", 12, True)], "split, schemas, lets_held_out"),
    "list_argument": "SELECT (row_number() OVER (ORDER BY n_nationkey) - 1)::INT AS place, n_name AS name FROM nation",
    "struct_leaf_paths": _values([(s.name, f.path) for s in catalog.schemas() for f in s.fields], "schema, path"),
    "json_tail": "SELECT event_id, left(props, length(props) - 1) AS rest, NULL::VARCHAR AS whole FROM events",
    "text_sentences": "SELECT p_partkey, i::INT AS place, [p_name || '.', p_brand || '!', p_type || ' end'][i + 1] AS sentence FROM part, range(3) r(i)",
    "text_halves": """WITH t AS (SELECT p_partkey, p_name || ' ' || p_type AS t, length(p_name || ' ' || p_type) // 2 AS h FROM part),
        a AS (SELECT *, CASE WHEN contains(left(t, h), ' ') THEN h - length(string_split(left(t, h), ' ')[-1]) ELSE strpos(t, ' ') END AS cut FROM t)
        SELECT p_partkey, left(t, cut - 1) AS head, substring(t, cut + 1) AS rest FROM a""",
    "number_words": f"SELECT c_custkey, {_ORDINAL} AS word FROM (SELECT c_custkey, c_custkey % 100 AS n FROM customer)",
    "prediction_join": f"WITH {_RECORDS} SELECT k AS record_id, k % 2 = 0 AND m <> 5 AS found, CASE WHEN k % 2 = 0 AND m NOT IN (5, 6) THEN {_NUMBER} END AS number FROM r",
    "lax_validation": f"SELECT c_custkey AS record_id, {_LAX}[c_custkey % {len(_LAX)} + 1] AS schema_valid FROM customer",
    "mismatch_kinds": """SELECT c_custkey AS record_id, category, path FROM customer, (VALUES (0, 'incorrect_normalization', 'diagnosis'), (1, 'incorrect_nesting', 'patient_name'),
        (2, 'wrong_entity_boundary', 'patient_name'), (3, 'wrong_inferred_value', 'physician_name'), (4, 'missing_field', 'patient_name'), (5, 'unclassified_mismatch', 'patient_name')) t(i, category, path)
        WHERE c_custkey % 8 = i""",
    "typed_values": """SELECT o_orderkey AS record_id, i = 0 AS exact_match, i IN (1, 3) AS schema_valid, c::BIGINT AS n_correct, p::BIGINT AS n_predicted, 5::BIGINT AS n_reference, m::BIGINT AS n_missing, missing
        FROM orders, (VALUES (0, 5, 5, 0, ''), (1, 3, 3, 2, ''), (2, 1, 6, 1, 'total_amount'), (3, 0, 1, 5, 'invoice_date,line_items[].quantity,total_amount')) t(i, c, p, m, missing) WHERE o_orderkey % 4 = i""",
    "gate_ontology": """SELECT c_custkey AS record_id, c_custkey % 3 = 0 AS accepted, (CASE WHEN c_custkey % 3 > 0 THEN 3 END)::INT AS step, CASE WHEN c_custkey % 3 > 0 THEN 'diagnosis' ELSE '' END AS unsupported FROM customer""",
    "gate_fuzzy": """SELECT p_partkey AS record_id, ok AS accepted, (CASE WHEN NOT ok THEN 3 END)::INT AS step
        FROM (SELECT p_partkey, p_partkey % 3 = 0 OR (p_partkey % 3 = 1 AND (length(p_name) - 1) / length(p_name) >= 0.85) AS ok FROM part)""",
    # a vendor with a letter too much in the source is forgiven from four letters on, and then the key beyond the schema counts
    "gate_regate": f"""WITH {_RECORDS}, t AS (SELECT m, k % 5 = 0 AND m <> 5 AS typo, length('V' || o_custkey) AS n FROM r),
        s AS (SELECT CASE WHEN m = 5 THEN 1 WHEN m = 2 OR (typo AND 2 * n / (2 * n + 1) < 0.85) THEN 3 WHEN m = 4 THEN 4 END AS step FROM t)
        SELECT step IS NULL AS accepted, step::INT AS step, count(*) AS count FROM s GROUP BY 1, 2""",
    "confidence_eval": f"""WITH {_RECORDS}, s AS (SELECT k, ((k * 37) % 101) / 100.0::DOUBLE AS c, (2 * n_correct / (n_predicted + n_reference) >= 0.5)::INT AS y, (row_number() OVER (ORDER BY k) - 1) % 2 AS odd FROM e),
        g AS (SELECT 0.05::DOUBLE + 49.95::DOUBLE * i / 499 AS t FROM range(500) r(i)),
        d AS (SELECT c, sum(y) AS y, count(*) AS n FROM s WHERE odd = 0 GROUP BY c), z AS (SELECT t, y, n, {_calibrated('t')} AS c FROM d, g),
        b AS (SELECT t, least(floor(c * 10), 9) AS bin, sum(c * n) AS c, sum(y) AS y, sum(n) AS n FROM z GROUP BY 1, 2),
        f AS (SELECT t, round(sum(abs(y - c)) / sum(n), 12) AS ece FROM b GROUP BY t ORDER BY 2, 1 LIMIT 1),
        v AS (SELECT c, count(*) AS n, sum(y) AS y FROM s GROUP BY c), p AS (SELECT sum(n) OVER w / sum(n) OVER () AS coverage, 1 - sum(y) OVER w / sum(n) OVER w AS risk FROM v WINDOW w AS (ORDER BY c DESC)),
        h AS (SELECT c, y FROM s WHERE odd = 1)
        SELECT round(t, 6) AS temperature, round(ece, 6) AS ece_fit, round({_ece('h', 'c')}, 6) AS ece_holdout_raw, round({_ece('h, f', _calibrated('t'))}, 6) AS ece_holdout,
          {', '.join(f"(SELECT round(coalesce(max(coverage) FILTER (risk <= {r / 100}), 0), 6) FROM p) AS coverage_at_{r}" for r in (10, 20, 30))} FROM f""",
}
