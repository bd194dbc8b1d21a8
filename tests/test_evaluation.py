from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docsieve.operators import calibration as C
from docsieve.operators import failures as FA
from docsieve.operators import gate as G
from docsieve.operators import jsonops as J
from docsieve.operators import merge as MG
from docsieve.operators import metrics as M
from docsieve.operators import prepass as P

NOTE = {
    "patient_name": "Jane Doe", "patient_age": 42, "visit_date": "2026-04-10", "diagnosis": "Hypertension", "physician_name": "Dr. Smith",
    "medications": [{"name": "lisinopril", "dosage": "10 mg"}], "follow_up_date": "2026-05-10",
}
SOURCE = "Jane Doe, age 42, seen 2026-04-10 for HTN / Hypertension. lisinopril 10 mg. Dr. Smith. Follow-up 2026-05-10."


def records(spark, pairs, schema="medical_note", source=SOURCE, tags=("a",)):
    rows = [(i, schema, source, list(tags), None if p is None else p if isinstance(p, str) else json.dumps(p), json.dumps(r)) for i, (p, r) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "record_id long, schema string, source_text string, tags array<string>, raw string, gold string")
    return df.withColumns({"prediction": J.parse_object(F.col("raw")), "reference": F.parse_json("gold")})


def evaluate(spark, pairs, **how):
    return {r.record_id: r for r in M.evaluate_records(records(spark, pairs, **how)).collect()}


def test_perfect_none_and_empty(spark):
    r = evaluate(spark, [(NOTE, NOTE), (None, NOTE), ("none", NOTE), ({}, {})])
    assert (r[0].exact_match, r[0].schema_valid, r[0].n_correct, r[0].n_predicted, r[0].n_hallucinated) == (True, True, 8, 8, 0)
    for i in (1, 2):
        assert (r[i].exact_match, r[i].schema_valid, r[i].n_predicted, r[i].n_missing, len(r[i].missing)) == (False, False, 0, 8, 8)
    assert (r[3].exact_match, r[3].schema_valid, r[3].n_reference) == (True, True, 0)


def test_values_compare_leniently(spark):
    other = NOTE | {"patient_name": " jane  DOE", "patient_age": "42", "visit_date": "04/10/2026", "diagnosis": "htn", "follow_up_date": "May 10, 2026"}
    r = evaluate(spark, [(other, NOTE)])[0]
    assert r.n_correct == 8 and r.exact_match and r.errors == []


def test_lists_earn_partial_credit(spark):
    gold = NOTE | {"medications": [{"name": "a"}, {"name": "b"}, {"name": "b"}]}
    pred = NOTE | {"medications": [{"name": "b"}, {"name": "x"}]}
    r = evaluate(spark, [(pred, gold)], source=None)[0]
    assert (r.n_predicted, r.n_reference, r.n_correct, r.n_missing) == (8, 9, 7, 1)
    assert [e.path for e in r.errors] == ["medications[].name"] and r.missing == []


def test_strings_in_lists_are_no_numbers(spark):
    gold = {"line_items": [{"quantity": 2, "unit_price": "12.50"}]}
    r = evaluate(spark, [({"line_items": [{"quantity": 2.0, "unit_price": 12.5}]}, gold)], schema="invoice", source=None)[0]
    assert (r.n_correct, r.n_predicted) == (1, 2)


def test_hallucination(spark):
    pred = {"vendor_name": "Ghost Corporation", "total_amount": "$1,234.50", "zz": [1, 2], "line_items": [{"description": "Widget"}, {"description": "Ghost"}]}
    r = evaluate(spark, [(pred, {"vendor_name": "Acme"})], schema="invoice", source="Acme sold a widget")[0]
    assert r.hallucinated == ["line_items[].description", "vendor_name", "zz"] and r.n_hallucinated == 4


@pytest.mark.parametrize(
    ("pred", "valid"),
    [
        ({"patient_age": "42"}, True), ({"patient_age": 42.0}, True), ({"patient_age": 42.5}, False), ({"patient_age": True}, True), ({"patient_name": 5}, False),
        ({"visit_date": "2026-04-10"}, True), ({"visit_date": "04/10/2026"}, False), ({"visit_date": None}, True), ({"medications": {"name": "a"}}, False),
        ({"medications": []}, True), ({"medications": "a"}, False), ({"medications": [{"name": 1}]}, False), ({"patient_name": {"a": 1}}, False),
        ({"patient_name": []}, False), ({"extra": {"a": [1]}}, True), ({"medications": None}, True),
    ],
)
def test_lax_validation(spark, pred, valid):
    assert evaluate(spark, [(pred, {})])[0].schema_valid is valid


def test_lax_validation_agrees_with_pydantic(spark):
    pydantic = pytest.importorskip("pydantic")
    from datetime import date
    from decimal import Decimal

    model = pydantic.create_model("m", patient_age=(int | None, None), visit_date=(date | None, None), patient_name=(str | None, None))
    invoice = pydantic.create_model("i", total_amount=(Decimal | None, None))
    values = [1, 1.0, 1.5, "1", "1.0", "x", True, None, "2026-01-02", "20260102", 86400, "NaN", "1,000", ""]
    pairs = [{f: v} for f in ("patient_age", "visit_date", "patient_name") for v in values]
    got = evaluate(spark, [(p, {}) for p in pairs])

    def ok(m, p):
        try:
            m.model_validate(p)
        except pydantic.ValidationError:
            return False
        return True

    assert [got[i].schema_valid for i in range(len(pairs))] == [ok(model, p) for p in pairs]
    pairs = [{"total_amount": v} for v in (1, 1.5, "1.5", "$1", "1,000.5", True, None, "x")]
    got = evaluate(spark, [(p, {}) for p in pairs], schema="invoice")
    assert [got[i].schema_valid for i in range(len(pairs))] == [ok(invoice, p) for p in pairs]


def test_metrics_are_pooled(spark):
    r = M.evaluate_records(records(spark, [({"patient_name": "Jane Doe"}, {"patient_name": "Jane Doe"}), ({"patient_name": "x", "diagnosis": "Hypertension"}, {"patient_name": "Jane Doe", "diagnosis": "Hypertension"})]))
    m = M.aggregate(r).first()
    assert m.field_precision == pytest.approx(2 / 3) and m.n_records == 2
    assert M.aggregate(r.limit(0)).first().field_f1 == 0


def test_slices(spark):
    a = M.evaluate_records(records(spark, [(NOTE, NOTE)]))
    b = M.evaluate_records(records(spark, [(None, NOTE)], tags=("a", "ambiguate")))
    s = {(r.slice_kind, r.slice): r for r in M.sliced(a.union(b)).collect()}
    assert s["overall", ""].n_records == 1 and s["tag", "a"].n_records == 2 and s["excluded", "ambiguate"].schema_validity == 0
    assert M.sliced(a).filter("slice_kind = 'excluded'").first().n_records == 0


def test_result_does_not_depend_on_partitions(spark):
    r = records(spark, [(NOTE, NOTE), (None, NOTE), ({"patient_name": "x"}, NOTE)])
    assert sorted(map(str, M.evaluate_records(r.repartition(1)).collect())) == sorted(map(str, M.evaluate_records(r.repartition(8)).collect()))


def test_json_scan(spark):
    cases = {
        'a {"x": {"y": 1}} b {"z": 2}': '{"x": {"y": 1}}', '{"a": "}\\"{"} t': '{"a": "}\\"{"}', "```json\n{\"a\": 1}\n```\n{}": '{"a": 1}',
        '{"a": [1, 2}': None, "no": None, '{"a": 1': None, "": None,
    }
    df = spark.createDataFrame([(k, v) for k, v in cases.items()], "t string, e string")
    for row in df.select("t", "e", J.find_object(F.col("t")).alias("g")).collect():
        assert row.g == row.e, row.t
    assert df.limit(1).select(J.find_object(F.lit('x {"a": [1'), tail=True).alias("g")).first().g == '{"a": [1'


def test_flatten(spark):
    text = '{"a":{"b":1,"n":null,"e":{}},"l":[{"q":1},{"q":2,"t":["x"]}],"s":["x","y"],"one":[{"k":1}],"empty":[]}'
    df = spark.createDataFrame([(1, text)], "id long, t string").select("id", F.parse_json("t").alias("v"))
    rows = [(r.path, r.listy, r.x) for r in J.flatten(df).filter("not empty").select("path", "listy", F.to_json("v").alias("x")).collect()]
    assert sorted(rows) == sorted([("a.b", False, "1"), ("a.n", False, "null"), ("l[].q", True, "1"), ("l[].q", True, "2"), ("l[].t", True, '"x"'), ("s", True, '"x"'), ("s", True, '"y"'), ("one[].k", True, "1")])


def test_prepass_two_items(spark):
    text = "Invoice INV-9 date: 2026-04-10. Office Chairs x 4 @ $120.00 = $480.00. Desks x 2 @ $800.00 = $1,600.00. Subtotal: $2,080.00. Tax (8%): $166.40. Total: $2,246.40."
    p = P.prepass(spark.createDataFrame([(1, text)], "record_id long, source_text string"), "invoice").first()
    got = {r.path: r["values"] for r in p.resolved}
    assert got["line_items[].quantity"] == ["4", "2"] and got["line_items[].unit_price"] == ["120.00", "800.00"] and got["line_items[].line_total"] == ["480.00", "1600.00"]
    assert got["total_amount"] == ["2246.40"] and got["tax_amount"] == ["166.40"] and "due_date" in p.unresolved
    for r in p.resolved:
        assert text[r.first.start : r.first.end] == r.first.raw


def test_merge_gives_rules_their_fields(spark):
    df = spark.createDataFrame([(1, 'INV-7 Total: $5.00', '{"invoice_number":"X","vendor_name":"Acme","due_date":null,"zz":1,"line_items":[{"description":"a"}]}')], "record_id long, source_text string, raw string")
    p = P.prepass(df, "invoice").withColumn("prediction", J.parse_object(F.col("raw")))
    leaves = MG.model_leaves(p)
    v = p.drop("prediction").join(leaves, "record_id").select(F.to_json(MG.merged_object(MG.rule_leaves(F.col("resolved")), F.col("leaves"), "invoice")).alias("v")).first().v
    assert json.loads(v) == {"invoice_number": "INV-7", "total_amount": "5.00", "vendor_name": "Acme", "line_items": [{"description": "a"}]}


def test_gate(spark):
    good = {"vendor_name": "Acme Corporation", "total_amount": "5.00"}
    rows = [("none",), (json.dumps({"vendor_name": 5}),), (json.dumps({"vendor_name": "Ghost"}),), (json.dumps(good | {"zz": 1}),), (json.dumps(good),), (json.dumps({"vendor_name": "Incorporated"}),)]
    df = spark.createDataFrame([(i, "invoice", "Acme Corporation and Inc. owe 5", r[0]) for i, r in enumerate(rows)], "record_id long, schema string, source_text string, raw string")
    assert [r.step for r in G.gate(df).orderBy("record_id").collect()] == [1, 2, 3, 4, None, None]
    typo = df.filter("record_id = 4").withColumn("source_text", F.lit("Acme Crporation"))
    assert G.gate(typo).first().step == 3 and G.gate(typo, fuzzy=True).first().accepted
    assert G.regate(typo, G.gate(typo)).first().accepted
    with pytest.raises(Exception, match="no results"):
        G.rejection_rate(G.gate(df).limit(0)).collect()


def test_calibration(spark):
    rows = [(c, y) for c, y in zip([0.9, 0.8, 0.7, 0.6, 0.5], [True, True, False, True, False], strict=True)]
    df = spark.createDataFrame(rows, "confidence double, correct boolean")
    points = C.risk_coverage(df)
    assert [(p.coverage, round(p.risk, 4)) for p in points.orderBy(F.desc("threshold")).collect()] == [(0.2, 0), (0.4, 0), (0.6, 0.3333), (0.8, 0.25), (1.0, 0.4)]
    assert C.coverage_at_risk(points, 0.3).first().coverage == 0.8 and C.coverage_at_risk(points, 0.0).first().coverage == 0.4
    one = spark.createDataFrame([(1.0, True)], df.schema)
    assert [b["count"] for b in C.reliability_bins(one).orderBy("bin").collect()] == [0] * 9 + [1]
    assert C.expected_calibration_error(one).first().ece == 0
    over = spark.createDataFrame([(0.99, i % 2 == 0) for i in range(100)], df.schema)
    assert C.fit_temperature(over).first().temperature > 10
    with pytest.raises(ValueError):
        C.coverage_at_risk(points, -1)
    with pytest.raises(ValueError):
        C.fit_temperature(df, lo=0)
    with pytest.raises(Exception, match="not in 0..1"):
        C.reliability_bins(spark.createDataFrame([(1.5, True)], df.schema)).collect()


def test_failures(spark):
    pairs = [
        ({"diagnosis": "T2DM"}, {"diagnosis": "Hypertension"}), ({"patient_name": "Smith", "physician_name": "Jane Doe"}, {"patient_name": "Jane Doe", "physician_name": "Jane Doe"}),
        ({"patient_name": "Jane"}, {"patient_name": "Jane Doe"}), ({"patient_name": "Xx"}, {"patient_name": "Yy"}), ({"patient_name": None}, {"patient_name": "Jane Doe"}),
    ]
    r = records(spark, pairs)
    f = FA.classify(M.evaluate_records(r), r)
    got = {}
    for x in f.collect():
        got.setdefault(x.record_id, set()).add(x.category)
    assert "incorrect_normalization" in got[0] and "incorrect_nesting" in got[1] and "wrong_entity_boundary" in got[2] and "wrong_inferred_value" in got[3] and got[4] == {"missing_field"}
    assert FA.by_category(f).count() == 9
    amb = records(spark, pairs[:1], tags=("ambiguate", "severity=0.5"))
    f = FA.classify(M.evaluate_records(amb), amb)
    assert [x.category for x in f.collect()] == ["ambiguous_input"]
    assert [x.operator for x in FA.by_category_and_operator(f).collect()] == ["ambiguate"]


def test_counts_without_lists_are_the_same_and_records_are_evaluated_once(spark, sf, monkeypatch):
    from docsieve.plans import queries as Q

    names = ["record_id", "exact_match", "schema_valid", "n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated"]
    whole, counts = (Q.evaluated(spark, sf, lists=x) for x in (True, False))
    assert counts.columns == ["record_id", "schema", "tags", *names[1:]]
    assert sorted(whole.select(names).collect()) == sorted(counts.select(names).collect())
    judged = spark.sparkContext.accumulator(0)
    results = whole.withColumn("n_correct", F.udf(lambda n: (judged.add(1), n)[1], "bigint")("n_correct")).withColumn("c", F.lit(0.5))
    Q.confidence_report(results, "c").collect()
    assert judged.value == whole.count()
