"""DuckDB SQL for the queries that SQL can express, from the tables alone."""

from __future__ import annotations

from ..sources.seeds import SEEDS
from .seed_sql import seed_sql

_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_PRICE = "cast(o_totalprice AS DECIMAL(12,2))"
_EMAIL = r"[A-Za-z0-9](?:[A-Za-z0-9.!#$%&''*+/=?^_`{|}~-]*[A-Za-z0-9])?@[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}[A-Za-z0-9])?)+"

#: Orders as records, and what each output scores, by key modulo 7 (see queries.records).
_RECORDS = f"""
r AS (SELECT o_orderkey AS k, o_orderkey % 7 AS m, o_orderkey % 11 = 0 AS amb, CASE WHEN o_orderkey % 3 = 0 THEN 'invoice' ELSE 'support_ticket' END AS schema,
             CASE WHEN o_orderkey % 3 = 0 THEN ['invoice_date', 'invoice_number', 'vendor_name'] ELSE ['created_date', 'ticket_id', 'urgency'] END AS names,
             o_custkey, {_DAY} AS day FROM orders),
e AS (SELECT k, m, amb, schema, names, m IN (0, 3) AS exact_match, m <> 5 AS schema_valid,
             CASE WHEN m IN (0, 3, 4) THEN 3 WHEN m = 5 THEN 0 ELSE 2 END::BIGINT AS n_correct,
             CASE WHEN m = 1 THEN 2 WHEN m = 4 THEN 4 WHEN m = 5 THEN 0 ELSE 3 END::BIGINT AS n_predicted, 3::BIGINT AS n_reference,
             CASE WHEN m = 5 THEN 3 WHEN m IN (1, 6) THEN 1 ELSE 0 END::BIGINT AS n_missing, CASE WHEN m IN (2, 4) THEN 1 ELSE 0 END::BIGINT AS n_hallucinated,
             CASE WHEN m = 5 THEN array_to_string(names, ',') WHEN m = 1 THEN names[1] WHEN m = 6 THEN names[2] ELSE '' END AS missing,
             CASE WHEN m = 2 THEN names[3] WHEN m = 4 THEN 'zz' ELSE '' END AS hallucinated, CASE WHEN m IN (2, 6) THEN 1 ELSE 0 END::INT AS n_errors FROM r)"""
_METRICS = """round(avg(exact_match::INT), 6) AS exact_match, round(avg(schema_valid::INT), 6) AS schema_validity,
    round(sum(n_correct) / sum(n_predicted), 6) AS field_precision, round(sum(n_correct) / sum(n_reference), 6) AS field_recall,
    round(2 * sum(n_correct) / (sum(n_predicted) + sum(n_reference)), 6) AS field_f1, round(sum(n_hallucinated) / sum(n_predicted), 6) AS hallucination_rate,
    round(sum(n_missing) / sum(n_reference), 6) AS missing_field_rate, count(*)::DOUBLE AS n_records"""
#: Every failure of every record.
_FAILURES = """
f AS (SELECT k, schema, amb, unnest(CASE WHEN amb THEN ['ambiguous_input'] WHEN m = 1 OR m = 6 THEN ['missing_field'] WHEN m = 2 THEN ['hallucinated_field', 'unclassified_mismatch']
                                      WHEN m = 4 THEN ['hallucinated_field'] WHEN m = 5 THEN ['schema_violation', 'missing_field', 'missing_field', 'missing_field'] ELSE [] END) AS category FROM e)"""
_CATEGORIES = (
    "missing_field incorrect_normalization wrong_entity_boundary wrong_inferred_value hallucinated_field schema_violation incorrect_nesting ambiguous_input unclassified_mismatch"
).split()
_SCORED = "s AS (SELECT event_id, ((event_id * 37) % 101) / 100.0::DOUBLE AS c, (event_id * 13) % 10 < 6 AS y FROM events)"
_REASON = """CASE WHEN m = 5 THEN 'step1_json_parse: no JSON object in the output' WHEN m = 2 THEN 'step3_source_support: ' || names[3]
    WHEN m = 4 THEN 'step4_no_overassertion: zz' ELSE '' END"""


def _spans(table: str, key: str, text: str, pattern: str) -> str:
    """Matches with their order and place, from the gaps between them."""
    return f"""
    WITH t AS (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS m, string_split_regex({text}, '{pattern}') AS g FROM {table}),
    x AS (SELECT {key}, unnest(range(1, len(m) + 1)) AS i, m, g FROM t)
    SELECT {key}, (i - 1)::INT AS ord, m[i] AS value,
           (list_sum(list_transform(g[1:i], lambda s: length(s))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda s: length(s))), 0))::INT AS start_,
           (list_sum(list_transform(g[1:i], lambda s: length(s))) + list_sum(list_transform(m[1:i], lambda s: length(s))))::INT AS end_ FROM x"""


def _fmt(x: str) -> str:
    """A decimal with thousands separators and two places."""
    return f"format('{{:,.2f}}', {x}::DOUBLE)"


ORACLE: dict[str, str] = {
    "extract_emails": _spans("documents", "doc_id", "text", _EMAIL),
    "extract_phones": """SELECT c_custkey, 0::INT AS ord, '+1' || (c_custkey % 700 + 200) || (c_nationkey + 300) || lpad((c_custkey % 10000)::VARCHAR, 4, '0') AS value, 5::INT AS start_, 22::INT AS end_ FROM customer""",
    "extract_urls": """SELECT page_id, i::INT AS ord, rtrim(url, '.,;:!?)') AS value, (CASE i WHEN 0 THEN 4 ELSE 12 + length(url) END)::INT AS start_ FROM pages, range(2) r(i)""",
    "extract_money": f"""SELECT o_orderkey, i::INT AS ord, CASE i WHEN 0 THEN '' ELSE '-' END || {_PRICE} AS value, (CASE i WHEN 0 THEN 15 ELSE 20 + length({_fmt(_PRICE)}) END)::INT AS start_ FROM orders, range(2) r(i)""",
    "extract_percentages": """WITH t AS (SELECT l_orderkey * 10 + l_linenumber AS key, cast(l_discount * 100 AS DECIMAL(5,1))::VARCHAR AS p FROM lineitem)
        SELECT key, 0::INT AS ord, p AS value, 5::INT AS start_, (7 + length(p))::INT AS end_ FROM t""",
    "extract_dates_iso": f"SELECT o_orderkey, 0::INT AS ord, {_DAY} AS value, 3::INT AS start_ FROM orders",
    "extract_dates_named": f"SELECT o_orderkey, 0::INT AS ord, {_DAY} AS value, 3::INT AS start_ FROM orders",
    "extract_dates_numeric": f"SELECT o_orderkey, 0::INT AS ord, {_DAY} AS value, CASE WHEN day(o_orderdate) <= 12 THEN 0.7::DOUBLE ELSE 1.0::DOUBLE END AS confidence FROM orders",
    "extract_identifiers": """SELECT o_orderkey, i::INT AS ord, CASE i WHEN 0 THEN 'CLM-' || o_orderkey ELSE 'POL' || o_custkey END AS value,
        (CASE i WHEN 0 THEN 6 ELSE 15 + length(o_orderkey::VARCHAR) END)::INT AS start_ FROM orders, range(2) r(i)""",
    "resolve_overlaps": f"""SELECT o_orderkey, i::INT AS ord, CASE i WHEN 1 THEN {_PRICE}::VARCHAR ELSE CASE WHEN i = 2 AND day(o_orderdate) <= 12
        THEN strftime(make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate)), '%Y-%m-%d') ELSE {_DAY} END END AS value, CASE i WHEN 1 THEN 'money' ELSE 'dates' END AS extractor FROM orders, range(3) r(i)""",
    "prepass_invoice": f"""WITH o AS (SELECT * FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem))
        SELECT o_orderkey AS record_id, path, value FROM (
          SELECT o_orderkey, 'invoice_number' AS path, 'INV-' || o_orderkey AS value FROM o UNION ALL SELECT o_orderkey, 'invoice_date', {_DAY} FROM o
          UNION ALL SELECT o_orderkey, 'due_date', strftime(o_orderdate::DATE + 30, '%Y-%m-%d') FROM o UNION ALL SELECT o_orderkey, 'vendor_email', 'v' || o_custkey || '@shop.com' FROM o
          UNION ALL SELECT o_orderkey, 'vendor_phone', '+14155552671' FROM o UNION ALL SELECT o_orderkey, 'total_amount', {_PRICE}::VARCHAR FROM o
          UNION ALL SELECT o_orderkey, 'tax_amount', cast({_PRICE} * 0.08 AS DECIMAL(12,2))::VARCHAR FROM o)""",
    "line_items": """WITH l AS (SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_quantity, l_extendedprice) - 1 AS item, l_quantity::INT AS q, cast(l_extendedprice AS DECIMAL(12,2)) AS t FROM lineitem JOIN orders ON o_orderkey = l_orderkey)
        SELECT l_orderkey AS record_id, 'line_items[].' || n AS path, item::INT AS item, CASE n WHEN 'quantity' THEN q::DECIMAL(12,2) WHEN 'unit_price' THEN cast(((t * 100)::BIGINT * 2 + q) // (2 * q) / 100.0 AS DECIMAL(12,2)) ELSE t END AS value
        FROM l, (VALUES ('quantity'), ('unit_price'), ('line_total')) v(n)""",
    "unresolved_fields": """SELECT o_orderkey AS record_id, CASE WHEN o_orderkey % 2 = 0 THEN 'customer_email,intent,issue_category,product,resolution_status,sentiment,urgency'
        ELSE 'created_date,customer_email,intent,issue_category,product,resolution_status,sentiment,ticket_id,urgency' END AS unresolved FROM orders""",
    "residual_prompt": f"""SELECT o_orderkey AS record_id, 'Return one JSON object with these fields of the document, and null where it does not say: candidate_name, current_employer, highest_degree, job_title, location, phone, years_experience'
        || chr(10) || chr(10) || 'Document:' || chr(10) || 'a@b.com owes ' || {_PRICE} || chr(10) || chr(10) || 'JSON:' AS prompt FROM orders""",
    "selection_rules": f"""SELECT o_orderkey, p AS first, (p + 5)::DECIMAL(12,2) AS last, (p + 10)::DECIMAL(12,2) AS max, p AS min FROM (SELECT o_orderkey, {_PRICE} AS p FROM orders)""",
    "json_parse": "SELECT event_id, json_extract(props, '$.k')::BIGINT AS k FROM events",
    "json_find_object": """SELECT event_id, CASE event_id % 4 WHEN 2 THEN '{"a": "}{", "b": [' || event_id || ']}' WHEN 3 THEN NULL ELSE props END AS found FROM events""",
    "json_flatten": """WITH l AS (SELECT l_orderkey, l_quantity::INT AS q FROM lineitem)
        SELECT 'id' AS path, false AS listy, count(*) AS n, 0::BIGINT AS nulls, sum(k)::BIGINT AS total FROM (SELECT DISTINCT l_orderkey AS k FROM l)
        UNION ALL SELECT 'meta.none', false, count(DISTINCT l_orderkey), count(DISTINCT l_orderkey), NULL FROM l
        UNION ALL SELECT 'lines[].q', true, count(*), 0, sum(q)::BIGINT FROM l UNION ALL SELECT 'lines[].flag', true, count(*), 0, NULL FROM l""",
    "json_unflatten": """SELECT l_orderkey AS record_id, count(*)::INT AS n, l_orderkey AS id, arg_min(l_quantity::BIGINT, (l_linenumber, '{"q":' || l_quantity::INT)) AS q0 FROM lineitem GROUP BY l_orderkey""",
    "normalize_ontology": """SELECT CASE c_custkey % 4 WHEN 0 THEN 'Hypertension' WHEN 1 THEN 'Type 2 Diabetes Mellitus' WHEN 2 THEN 'Stroke' ELSE 'Chronic Obstructive Pulmonary Disease' END AS f, count(*) AS n FROM customer GROUP BY 1""",
    "tolerant_numbers": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN {_PRICE} END AS n FROM orders",
    "tolerant_dates": f"SELECT o_orderkey, CASE WHEN o_orderkey % 4 < 3 THEN {_DAY} END AS d FROM orders",
    "normalized_text": "SELECT p_partkey, lower(p_name) || ' ' || lower(p_brand) AS t FROM part",
    "eval_records": f"WITH {_RECORDS} SELECT k AS record_id, exact_match, schema_valid, n_correct, n_predicted, n_reference, n_missing, n_hallucinated, missing, hallucinated, n_errors FROM e",
    "eval_overall": f"WITH {_RECORDS} SELECT '' AS slice, {_METRICS} FROM e WHERE NOT amb",
    "eval_by_schema": f"WITH {_RECORDS} SELECT schema AS slice, {_METRICS} FROM e WHERE NOT amb GROUP BY schema",
    "eval_by_tag": f"WITH {_RECORDS} SELECT tag AS slice, {_METRICS} FROM e, (VALUES ('typo'), ('severity=0.5'), ('ambiguate')) t(tag) WHERE tag <> 'ambiguate' OR amb GROUP BY tag",
    "eval_excluded": f"WITH {_RECORDS} SELECT 'ambiguate' AS slice, {_METRICS} FROM e WHERE amb",
    "eval_table": f"""WITH {_RECORDS}, m AS (SELECT schema, {_METRICS} FROM e WHERE NOT amb GROUP BY schema), u AS (UNPIVOT m ON COLUMNS(* EXCLUDE schema) INTO NAME metric VALUE v)
        SELECT metric, max(v) FILTER (schema = 'invoice') AS invoice, max(v) FILTER (schema = 'support_ticket') AS support_ticket FROM u GROUP BY metric""",
    "list_partial_credit": """SELECT l_orderkey AS record_id, count(*) FILTER (l_linenumber <= 3 AND l_linenumber <> 2) AS n_correct, count(*) FILTER (l_linenumber <= 3) AS n_predicted,
        count(*) AS n_reference, CASE WHEN count(*) FILTER (l_linenumber <= 3) = 0 THEN count(*) ELSE count(*) FILTER (l_linenumber > 3) END AS n_missing,
        count(*) FILTER (l_linenumber > 3 OR l_linenumber = 2) = 0 AS exact_match, true AS schema_valid FROM lineitem GROUP BY l_orderkey""",
    "hybrid_merge": f"""WITH {_RECORDS} SELECT k AS record_id, 'INV-' || k AS invoice_number, CASE WHEN m = 2 THEN 'Ghost' WHEN m = 5 THEN NULL ELSE 'V' || o_custkey END AS vendor_name,
        CASE WHEN m IN (1, 5) THEN NULL ELSE day END AS invoice_date FROM r WHERE schema = 'invoice'""",
    "hybrid_compare": f"""WITH {_RECORDS}, x AS (
          SELECT 'model' AS system, exact_match, schema_valid, n_correct, n_predicted, n_reference, n_missing, n_hallucinated FROM e WHERE schema = 'invoice'
          UNION ALL SELECT 'rules', false, true, 1, 1, 3, 2, 0 FROM e WHERE schema = 'invoice'
          UNION ALL SELECT 'hybrid', m IN (0, 3, 4, 6), true, CASE WHEN m = 5 THEN 1 WHEN m IN (1, 2) THEN 2 ELSE 3 END, CASE WHEN m = 5 THEN 1 WHEN m = 1 THEN 2 ELSE 3 END, 3,
                 CASE WHEN m = 5 THEN 2 WHEN m = 1 THEN 1 ELSE 0 END, CASE WHEN m = 2 THEN 1 ELSE 0 END FROM e WHERE schema = 'invoice')
        SELECT system, {_METRICS} FROM x GROUP BY system""",
    "gate_steps": f"""WITH {_RECORDS} SELECT k AS record_id, m NOT IN (2, 4, 5) AS accepted, (CASE WHEN m = 5 THEN 1 WHEN m = 2 THEN 3 WHEN m = 4 THEN 4 END)::INT AS step, {_REASON} AS reason,
        CASE WHEN m = 2 THEN names[3] ELSE '' END AS unsupported FROM e""",
    "gate_rejection_rate": f"WITH {_RECORDS} SELECT round(avg((m IN (2, 4, 5))::INT), 6) AS rejection_rate FROM e",
    "gate_top_reasons": f"WITH {_RECORDS} SELECT {_REASON} AS reason, count(*) AS count FROM e WHERE m IN (2, 4, 5) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10",
    "reliability_bins": f"""WITH {_SCORED}, b AS (SELECT least(floor(c * 10), 9)::INT AS bin, avg(c) AS c, avg(y::INT) AS y, count(*) AS n FROM s GROUP BY 1)
        SELECT i::INT AS bin, round(i / 10, 6) AS lo, round((i + 1) / 10, 6) AS hi, round(coalesce(c, 0), 6) AS confidence, round(coalesce(y, 0), 6) AS accuracy, coalesce(n, 0) AS count FROM range(10) r(i) LEFT JOIN b ON b.bin = i""",
    "calibration_error": f"""WITH {_SCORED}, b AS (SELECT least(floor(c * 10), 9) AS bin, avg(c) AS c, avg(y::INT) AS y, count(*) AS n FROM s GROUP BY 1) SELECT round(sum(n * abs(y - c)) / sum(n), 6) AS ece FROM b""",
    "temperature_fit": f"""WITH {_SCORED}, g AS (SELECT 0.05::DOUBLE + 49.95::DOUBLE * i / 499 AS t FROM range(500) r(i)),
        d AS (SELECT c, sum(y::INT) AS y, count(*) AS n FROM s GROUP BY c),
        z AS (SELECT t, y, n, (ln(greatest(least(c, 1 - 1e-6), 1e-6)) - ln(1 - greatest(least(c, 1 - 1e-6), 1e-6))) / t AS z FROM d, g),
        c AS (SELECT t, y, n, CASE WHEN z >= 0 THEN 1 / (1 + exp(-z)) ELSE exp(z) / (1 + exp(z)) END AS c FROM z),
        b AS (SELECT t, least(floor(c * 10), 9) AS bin, sum(c * n) AS c, sum(y) AS y, sum(n) AS n FROM c GROUP BY 1, 2),
        e AS (SELECT t, round(sum(abs(y - c)) / sum(n), 12) AS ece FROM b GROUP BY t) SELECT round(t, 6) AS temperature, round(ece, 6) AS ece FROM e ORDER BY e.ece, t LIMIT 1""",
    "temperature_scaled": f"""WITH {_SCORED}, z AS (SELECT event_id, (ln(greatest(least(c, 1 - 1e-6), 1e-6)) - ln(1 - greatest(least(c, 1 - 1e-6), 1e-6))) / 2.5 AS z FROM s)
        SELECT event_id, round(1 / (1 + exp(-z)), 6) AS c FROM z""",
    "risk_coverage": f"""WITH {_SCORED}, t AS (SELECT c, count(*) AS n, sum(y::INT) AS y FROM s GROUP BY c)
        SELECT round(c, 6) AS threshold, round(sum(n) OVER w / sum(n) OVER (), 6) AS coverage, round(1 - sum(y) OVER w / sum(n) OVER w, 6) AS risk FROM t WINDOW w AS (ORDER BY c DESC)""",
    "coverage_at_risk": f"""WITH {_SCORED}, t AS (SELECT c, count(*) AS n, sum(y::INT) AS y FROM s GROUP BY c),
        p AS (SELECT sum(n) OVER w / sum(n) OVER () AS coverage, 1 - sum(y) OVER w / sum(n) OVER w AS risk FROM t WINDOW w AS (ORDER BY c DESC)) SELECT round(coalesce(max(coverage) FILTER (risk <= 0.4), 0), 6) AS coverage FROM p""",
    "fit_holdout_split": f"""WITH {_SCORED}, t AS (SELECT y, (row_number() OVER (ORDER BY event_id) - 1) % 2 AS odd FROM s) SELECT CASE odd WHEN 0 THEN 'fit' ELSE 'holdout' END AS part, count(*) AS n, count(*) FILTER (y) AS y FROM t GROUP BY odd""",
    "sequence_confidence": """WITH x AS (SELECT event_id, CASE WHEN event_id % 3 = 2 THEN 0 WHEN (event_id + 1) % 3 = 2 THEN 1 ELSE 2 END AS n FROM events)
        SELECT event_id, round(CASE n WHEN 0 THEN 0 WHEN 1 THEN exp(-(event_id % 5) / 10.0) ELSE exp(-((event_id % 5) + (event_id + 1) % 5) / 20.0) END, 6) AS c FROM x""",
    "record_f1": f"WITH {_RECORDS} SELECT k AS record_id, round(2 * n_correct / (n_predicted + n_reference), 6) AS f1 FROM e",
    "public_text": "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN substring(text, 1, 500) ELSE source END AS t FROM documents",
    "failure_categories": f"""WITH {_RECORDS}, {_FAILURES} SELECT c AS category, count(category) AS n FROM (SELECT unnest({_CATEGORIES!r}) AS c) LEFT JOIN f ON category = c GROUP BY c""",
    "failure_by_schema": f"WITH {_RECORDS}, {_FAILURES} SELECT category, schema, count(*) AS n FROM f GROUP BY 1, 2",
    "failure_by_operator": f"""WITH {_RECORDS}, {_FAILURES} SELECT category, operator, count(*) AS n FROM f, (VALUES ('typo'), ('ambiguate')) t(operator) WHERE operator = 'typo' OR amb GROUP BY 1, 2""",
    "failure_examples": f"""WITH {_RECORDS}, {_FAILURES}, p AS (SELECT category, k, row_number() OVER (PARTITION BY category ORDER BY k) AS place FROM f) SELECT category, place::INT AS place, k AS record_id FROM p WHERE place <= 5""",
    "failure_top": f"WITH {_RECORDS}, {_FAILURES} SELECT category, count(*) AS n FROM f WHERE category <> 'ambiguous_input' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1",
    "failure_top_schemas": f"""WITH {_RECORDS}, {_FAILURES}, c AS (SELECT category, schema, count(*) AS n FROM f GROUP BY 1, 2) SELECT category, schema, n FROM c QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, schema) = 1""",
    "failure_missing_share": f"WITH {_RECORDS}, {_FAILURES} SELECT round(avg((category = 'missing_field')::INT), 6) AS share FROM f",
    "schema_fields": """SELECT * FROM (VALUES ('contract', 3::BIGINT, 5::BIGINT), ('crm_record', 4, 5), ('email', 3, 5), ('form', 3, 5), ('invoice', 10, 2), ('medical_note', 2, 6), ('receipt', 7, 5), ('resume', 2, 6), ('support_ticket', 3, 6)) t(schema, rule, model)""",
    "jsonl_records": f"""WITH {_RECORDS}, v AS (SELECT *, CASE schema WHEN 'invoice' THEN 'INV-' ELSE 'TKT-' END || k AS a, 'V' || o_custkey AS b FROM r)
        SELECT k AS record_id, '{{"reference": {{"' || names[2] || '":"' || a || '","' || names[3] || '":"' || b || '","' || names[1] || '":"' || day || '"}}, "schema": "' || schema || '", "source_text": "' || a || ' for ' || b || ' on ' || day
          || '", "tags": ["typo",' || CASE WHEN amb THEN '"ambiguate",' ELSE '' END || '"severity=0.5"]}}' AS line FROM v""",
    "log_scrape": "SELECT o_orderkey, o_orderkey AS written, 3::BIGINT AS admitted, o_custkey AS judged, 12.5::DOUBLE AS percent FROM orders",
    "manifest_fallback": f"SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN {_PRICE}::DOUBLE ELSE -1.0::DOUBLE END AS f1 FROM orders",
}

ORACLE |= {f"seed_{name}": seed_sql(name, "SELECT range AS k FROM range((SELECT count(*) FROM customer))") for name in SEEDS}
