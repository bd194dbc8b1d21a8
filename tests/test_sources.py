from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from docsieve.sources import corrupt as CO
from docsieve.sources import jsonl
from docsieve.sources.seeds import seeds
from docsieve import catalog, streaming
from docsieve.operators import jsonops as J
from docsieve.operators import metrics as M


@pytest.mark.parametrize("schema", [s.name for s in catalog.schemas()])
def test_seed_gold_is_in_the_text_and_valid(spark, schema):
    s = seeds(spark, schema, 20, seed=3)
    paths = set(catalog.get_schema(schema).paths())
    for r in s.collect():
        gold = json.loads(r.reference)
        strings = [v for v in gold.values() if isinstance(v, str)] + [x for v in gold.values() if isinstance(v, list) for i in v for x in i.values() if isinstance(x, str)]
        assert all(x in r.source_text for x in strings), r
        assert {p.split("[]")[0] for p in paths} == set(gold)
    ready = s.select("record_id", "schema", "source_text", F.expr("cast(array() as array<string>)").alias("tags"), F.parse_json("reference").alias("prediction"), F.parse_json("reference").alias("reference"))
    m = M.aggregate(M.evaluate_records(ready)).first()
    assert (m.exact_match, m.schema_validity, m.field_f1, m.hallucination_rate) == (1, 1, 1, 0)


def test_same_seed_same_bytes_whatever_the_partitions(spark, tmp_path):
    make = lambda: CO.corpus(spark, ["invoice", "medical_note"], 3, [0.0, 0.5, 1.0], ["ocr_noise", "typo"], seed=7)
    for name, df in (("a", make()), ("b", make().repartition(5))):
        jsonl.write_records(df, str(tmp_path / name), one_file=True)
    read = lambda n: next((tmp_path / n).glob("part-*")).read_bytes()
    assert read("a") == read("b") and len(read("a").splitlines()) == 18
    assert make().exceptAll(CO.corpus(spark, ["invoice", "medical_note"], 3, [0.0, 0.5, 1.0], ["ocr_noise", "typo"], seed=8)).count() > 0


@pytest.mark.parametrize("op", list(CO.OPERATORS))
def test_operators(spark, op):
    clean = CO.corpus(spark, [], 6, [1.0], [], seed=2)
    for severity in (0.0, 1.0):
        done = CO.corpus(spark, [], 6, [severity], [op], seed=2)
        pairs = clean.alias("c").join(done.alias("d"), "record_id").select("c.source_text", "c.reference", F.col("d.source_text").alias("t"), F.col("d.reference").alias("g"), "d.tags").collect()
        changed = [p for p in pairs if p.source_text != p.t]
        if severity == 0:
            assert not changed and all(p.reference == p.g and p.tags == ["severity=0.0"] for p in pairs)
        else:
            assert changed and all(op in p.tags for p in changed)
            assert all((p.reference == p.g) or op == "nest" for p in pairs) and all(json.loads(p.g) for p in pairs)


def test_clean_corpora_and_splits(spark):
    assert CO.corpus(spark, [], 1, [0.5], [], split="eval").select("tags").distinct().collect()[0].tags == ["clean", "severity=0.0"]
    with pytest.raises(ValueError):
        CO.corpus(spark, ["kg_triple"], 1, [0.0], [], split="train")
    with pytest.raises(ValueError, match="known"):
        CO.corpus(spark, ["email"], 1, [0.0], ["nope"])


def test_jsonl_reading(spark, tmp_path):
    good = {"schema": "email", "reference": {"subject": "x"}, "tags": ["a"], "source_text": "t"}
    lines = [json.dumps(good), "", json.dumps({"schema": "email", "reference": {}}), "oops", json.dumps({"schema": "", "reference": {}}), json.dumps({"schema": "a", "reference": []}), json.dumps(good | {"tags": [1]})]
    (tmp_path / "x.jsonl").write_text("\n".join(lines) + "\n")
    rows = jsonl.read_records(spark, str(tmp_path / "x.jsonl"), strict=False).orderBy("record_id").collect()
    assert [r.error is None for r in rows] == [True, True, False, False, False, False] and rows[1].tags == [] and rows[1].source_text == ""
    with pytest.raises(Exception, match="line 4"):
        jsonl.read_records(spark, str(tmp_path / "x.jsonl")).select("schema").collect()


def test_state_log_and_digest(spark, tmp_path):
    log = str(tmp_path / "log")
    jsonl.append_state(spark, log, iteration=1, f1=0.5)
    jsonl.append_state(spark, log, iteration=2)
    assert sorted((r.iteration, r.f1) for r in jsonl.read_state(spark, log, ["iteration", "f1"]).collect()) == [("1", "0.5"), ("2", None)]
    (tmp_path / "f").write_bytes(b"abc")
    assert jsonl.file_digest(spark, str(tmp_path / "f")).first().sha256.startswith("ba7816bf")


def test_streams(spark, tmp_path):
    seeds(spark, "form", 30).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = streaming.prepass_stream(stream, "form").select("record_id", F.size("resolved").alias("n")).writeStream.format("memory").queryName("forms").start()
    q.processAllAvailable()
    q.stop()
    assert spark.sql("select count(*) from forms where n >= 2").first()[0] == 30
    with pytest.raises(ValueError):
        streaming.prepass_stream(seeds(spark, "form", 1), "form")


def test_fences_and_tail(spark):
    df = spark.createDataFrame([("```\n{\"a\": [1]}",)], "t string")
    assert df.select(J.find_object(F.col("t")).alias("x")).first().x == '{"a": [1]}'


def test_command_line(spark, tmp_path):
    from docsieve.sources.generate import main, split_names

    out = str(tmp_path / "c.jsonl")
    assert main(["--schemas", "email,form", "--n", "2", "--severities", "0,1.0", "--operators", "typo", "--out", out], spark) == 8
    assert jsonl.read_corpus(spark, out).filter("schema = 'form'").count() == 4 and jsonl.read_records(spark, out).count() == 8
    assert split_names(["a, b", "c", ",", ""]) == ["a", "b", "c"] and split_names(None) == []


def test_report_fields(spark):
    df = spark.createDataFrame([('{"f1": 0.5}',), ("no",), (None,)], "r string")
    assert [r.x for r in df.select(jsonl.report_field(F.col("r"), "f1").alias("x")).collect()] == ["0.5", None, None]


def test_every_label_has_other_wordings():
    from docsieve.sources.seeds import LABELS, SEEDS, missing_seeds

    assert sorted(CO.GLOSSARY) == LABELS and not missing_seeds() and len(SEEDS) == 12
