"""Queries for scans, sinks, registries and rules that ``queries`` does not reach."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions.text import ordinal_words, sentences
from ..operators import failures as FA
from ..operators import gate as G
from ..operators import jsonops as J
from ..operators import metrics as M
from ..operators import prepass as P
from ..sources import corrupt as CO
from ..sources import jsonl
from ..sources.generate import main as generate
from ..sources.generate import split_names
from ..sources.scratch import shared_dir
from . import reports
from .queries import query, records, rounded, spread, table, text_of

# scans and sinks ------------------------------------------------------------


def _written(spark: SparkSession, sf_dir: str) -> str:
    """The records as JSON lines in a shared folder."""
    path = f"{shared_dir(spark)}/records"
    jsonl.write_records(records(spark, sf_dir).withColumn("reference", F.col("gold")), path)
    return path


@query
def jsonl_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records that were written, read strictly."""
    r = jsonl.read_records(spark, _written(spark, sf_dir))
    number = F.coalesce(F.try_variant_get("reference", "$.invoice_number", "string"), F.try_variant_get("reference", "$.ticket_id", "string"))
    return r.select("schema", "source_text", number.alias("number"), F.array_join("tags", ",").alias("tags"))


@query
def jsonl_scan_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are no records, by what is wrong with them."""
    c = table(spark, sf_dir, "customer")
    line = (
        F.when(F.col("c_custkey") % 5 == 0, F.lit('{"schema":"email","reference":{},"tags":["a"]}')).when(F.col("c_custkey") % 5 == 1, F.lit("oops"))
        .when(F.col("c_custkey") % 5 == 2, F.lit('{"schema":"","reference":{}}')).when(F.col("c_custkey") % 5 == 3, F.lit('{"schema":"a","reference":[]}'))
        .otherwise(F.lit('{"schema":"a","reference":{},"tags":[1]}'))
    )
    path = f"{shared_dir(spark)}/lines"
    c.select(line.alias("value")).write.text(path)
    return jsonl.read_records(spark, path, strict=False).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


@query
def corpus_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same lines as a training corpus, not validated."""
    r = jsonl.read_corpus(spark, _written(spark, sf_dir))
    return r.select("schema", "source_text", F.size("tags").alias("n_tags"), F.length("reference").alias("reference_length"))


@query
def json_array_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file that holds one JSON array."""
    path = f"{shared_dir(spark)}/array"
    rows = table(spark, sf_dir, "nation").select(F.struct(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name")).alias("x"))
    rows.agg(F.to_json(F.collect_list("x")).alias("value")).coalesce(1).write.text(path)
    return jsonl.read_json_array(spark, path, "id long, name string")


@query
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report that was written, and fields of it read back; one is not there."""
    path = f"{shared_dir(spark)}/report"
    jsonl.write_report(table(spark, sf_dir, "customer").agg(F.count(F.lit(1)).alias("n"), F.max("c_custkey").alias("last")), path)
    r = spark.read.text(path)
    return r.select(*[jsonl.report_field(F.col("value"), name).alias(name) for name in ("n", "last", "absent")])


@query
def split_admitted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gate results in a folder for admitted and one for rejected ones."""
    path = f"{shared_dir(spark)}/split"
    jsonl.write_split(G.gate(records(spark, sf_dir)), path)
    parts = [spark.read.schema("record_id long").json(f"{path}/accepted={word}").withColumn("folder", F.lit(word)) for word in ("true", "false")]
    return parts[0].union(parts[1])


@query
def state_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A line for every region, then fields of all lines."""
    path = f"{shared_dir(spark)}/log"
    for r in table(spark, sf_dir, "region").collect():  # five rows
        jsonl.append_state(spark, path, step=r["r_regionkey"], **({"name": r["r_name"]} if r["r_regionkey"] % 2 else {}))
    return jsonl.read_state(spark, path, ["step", "name"])


@query
def corpus_command(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the command line writes: records by schema and tags."""
    path, n = f"{shared_dir(spark)}/corpus", table(spark, sf_dir, "nation").count()
    generate(["--schemas", "email, form", "--n", str(n), "--severities", "0,1.0", "--operators", "synonym", "--seed", "3", "--out", path], spark)
    return jsonl.read_corpus(spark, path).groupBy("schema", F.array_join("tags", ",").alias("tags")).agg(F.count(F.lit(1)).alias("n"))


@query
def file_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The digest of a file with the nations' names in order, one a line."""
    path = f"{shared_dir(spark)}/names"
    table(spark, sf_dir, "nation").coalesce(1).sortWithinPartitions("n_nationkey").select("n_name").write.text(path)
    return jsonl.file_digest(spark, f"{path}/part-*").select("sha256")


@query
def generation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens a second and valid outputs of the records' raw texts."""
    k = F.col("record_id")
    r = records(spark, sf_dir).select("raw", (k % 17).alias("tokens"), ((k % 9 + 1) / 10).alias("seconds"))
    return rounded(reports.generation_summary(r))


@query
def semantic_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests for what the schema leaves to the model."""
    r = records(spark, sf_dir)
    return r.select("record_id", P.semantic_prompt(F.col("schema"), F.col("source_text")).alias("prompt"))


# registries -----------------------------------------------------------------


def _known(name: str) -> bool:
    try:
        catalog.get_schema(name)
    except KeyError:
        return False
    return True


@query
def registry_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Schemas by name, and a name that is none."""
    names = [*(s.name for s in catalog.schemas()), "poem"]
    rows = [(n, _known(n), len(catalog.get_schema(n).fields) if _known(n) else 0) for n in names]
    return spark.createDataFrame(rows, "name string, known boolean, fields int")


@query
def split_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many schemas a split allows, and whether it lets a held-out one in."""
    rows = []
    for split in ("train", "eval", "any"):
        try:
            catalog.split_schemas(["kg_triple"], split)
            lets = True
        except ValueError:
            lets = False
        rows.append((split, len(catalog.split_schemas([], split)), lets))
    return spark.createDataFrame(rows, "split string, schemas int, lets_held_out boolean")


@query
def list_argument(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names given as one argument with commas, blanks and empty entries among them, by place."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # 25 rows
    given = split_names([" , ".join(names[:10]) + ",", *names[10:20], ",".join(names[20:]), ""])
    return spark.createDataFrame(list(enumerate(given)), "place int, name string")


@query
def struct_leaf_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaf paths of the Spark types of gold records."""
    rows = [(s.name, path) for s in catalog.schemas() for path in catalog.leaf_paths(s.struct())]
    return spark.createDataFrame(rows, "schema string, path string")


# text -----------------------------------------------------------------------


@query
def json_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects that are cut off: what there is of them, and nothing without ``tail``."""
    e = table(spark, sf_dir, "events").select("event_id", text_of("so: ", F.expr("left(props, length(props) - 1)")).alias("t"))
    return e.select("event_id", J.find_object(F.col("t"), tail=True).alias("rest"), J.find_object(F.col("t")).alias("whole"))


@query
def text_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", text_of(F.col("p_name"), ".  ", F.col("p_brand"), "!\n\n", F.col("p_type"), " end").alias("t"))
    return p.select("p_partkey", F.posexplode(sentences(F.col("t"))).alias("place", "sentence"))


@query
def text_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut at the last blank before their middle, or the first behind it."""
    p = table(spark, sf_dir, "part").select("p_partkey", text_of(F.col("p_name"), " ", F.col("p_type")).alias("t")).withColumn("h", CO.halves(F.col("t")))
    return p.select("p_partkey", F.col("h")[0].alias("head"), F.col("h")[1].alias("rest"))


@query
def number_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", ordinal_words((F.col("c_custkey") % 100).cast("int")).alias("word"))
    return c


# evaluation -----------------------------------------------------------------


@query
def prediction_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions for even keys alone, looked up by record."""
    r = records(spark, sf_dir)
    p = r.filter("record_id % 2 = 0").select("record_id", "raw")
    d = M.with_predictions(r.drop("raw"), p)
    number = F.coalesce(F.try_variant_get("prediction", "$.invoice_number", "string"), F.try_variant_get("prediction", "$.ticket_id", "string"))
    return d.select("record_id", F.col("prediction").isNotNull().alias("found"), number.alias("number"))


def _notes(spark: SparkSession, sf_dir: str, prediction, reference: str, source: str = "Jane Doe, seen for HTN, by Dr. Smith") -> DataFrame:
    """Customers as medical notes."""
    c = spread(table(spark, sf_dir, "customer"))
    return c.select(
        F.col("c_custkey").alias("record_id"), F.lit("medical_note").alias("schema"), F.lit(source).alias("source_text"), F.array(F.lit("a")).alias("tags"),
        F.parse_json(prediction).alias("prediction"), F.parse_json(F.lit(reference)).alias("reference"),
    )


def _by_key(options: list[str]):
    return F.element_at(F.array(*[F.lit(o) for o in options]), (F.col("c_custkey") % len(options) + 1).cast("int"))


#: Values of a note's fields: of every declared type, as each form that lax validation knows.
LAX = [
    {"patient_age": "42"}, {"patient_age": 42.0}, {"patient_age": 42.5}, {"patient_age": True}, {"patient_age": "old"}, {"patient_name": 5}, {"visit_date": "2026-04-10"},
    {"visit_date": "04/10/2026"}, {"visit_date": None}, {"visit_date": 86400}, {"medications": {"name": "a"}}, {"medications": []}, {"medications": [{"name": 1}]},
    {"patient_name": {"a": 1}}, {"patient_name": []}, {"extra": {"a": [1]}}, {"medications": None}, {"medications": [{"name": "a"}, None]},
]


@query
def lax_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    notes = _notes(spark, sf_dir, _by_key([json.dumps(v) for v in LAX]), "{}")
    return M.evaluate_records(notes).select("record_id", "schema_valid")


#: Pairs of values, one a category of mismatch; the last two are equal in other words.
PAIRS = [
    ({"diagnosis": "T2DM"}, "incorrect_normalization"), ({"patient_name": "Smith", "alias": "Jane Doe"}, "incorrect_nesting"),
    ({"patient_name": "Jane"}, "wrong_entity_boundary"), ({"physician_name": "Dr. Xu"}, "wrong_inferred_value"), ({"patient_name": None}, "missing_field"),
    ({"patient_name": "seen for"}, "unclassified_mismatch"), ({"patient_name": " jane  DOE"}, ""), ({"diagnosis": "htn"}, ""),
]
TRUTH = {"patient_name": "Jane Doe", "diagnosis": "Hypertension", "physician_name": "Dr. Kowalski"}


@query
def mismatch_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The categories of records that differ from the truth in one value, each in its own way."""
    notes = _notes(spark, sf_dir, _by_key([json.dumps(TRUTH | p) for p, _ in PAIRS]), json.dumps(TRUTH))
    f = FA.classify(M.evaluate_records(notes), notes)
    return f.filter("category <> 'hallucinated_field'").select("record_id", "category", "path")


@query
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers, dates, lists and nested values of invoices against the truth in other forms."""
    price = F.col("price")
    o = spread(table(spark, sf_dir, "orders")).select("o_orderkey", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "MMMM d, yyyy").alias("long_day"))
    k = F.col("o_orderkey") % 4
    truth = text_of('{"total_amount":"', price, '","invoice_date":"', F.col("day"), '","line_items":[{"quantity":1},{"quantity":2},{"quantity":2}]}')
    said = (
        F.when(k == 0, text_of('{"total_amount":"$', F.format_number("price", 2), '","invoice_date":"', F.col("long_day"), '","line_items":[{"quantity":2},{"quantity":1},{"quantity":2.0}]}'))
        .when(k == 1, text_of('{"total_amount":', price, ',"invoice_date":"', F.col("day"), '","line_items":[{"quantity":2}]}'))
        .when(k == 2, text_of('{"total_amount":{"value":"', price, '"},"invoice_date":"1901-01-01","line_items":[{"quantity":7},{"quantity":1},{"quantity":1},{"quantity":1}]}'))
        .otherwise(text_of('{"line_items":[{"a":{"b":[{"c":{"d":[{"e":1}]}}]}}]}'))
    )
    r = o.select(
        F.col("o_orderkey").alias("record_id"), F.lit("invoice").alias("schema"), F.lit(None).cast("string").alias("source_text"), F.array(F.lit("a")).alias("tags"),
        F.parse_json(said).alias("prediction"), F.parse_json(truth).alias("reference"),
    )
    return M.evaluate_records(r).select("record_id", "exact_match", "schema_valid", "n_correct", "n_predicted", "n_reference", "n_missing", F.array_join("missing", ",").alias("missing"))


@query
def gate_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical forms that only a surface form in the source supports, or nothing."""
    c = spread(table(spark, sf_dir, "customer"))
    raw = F.when(F.col("c_custkey") % 3 == 2, F.lit('{"diagnosis":"Chronic Kidney Disease"}')).otherwise(F.lit('{"diagnosis":"Hypertension"}'))
    source = F.when(F.col("c_custkey") % 3 == 0, "known htn since May").when(F.col("c_custkey") % 3 == 1, "nothing of note").otherwise(F.lit(None).cast("string"))
    out = c.select(F.col("c_custkey").alias("record_id"), F.lit("medical_note").alias("schema"), source.alias("source_text"), raw.alias("raw"))
    return G.gate(out).select("record_id", "accepted", "step", F.array_join("unsupported_fields", ",").alias("unsupported"))


@query
def gate_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts as they are, with the last letter wrong, or quite different, against windows of the source."""
    p = spread(table(spark, sf_dir, "part"))
    k = F.col("p_partkey") % 3
    name = F.when(k == 0, F.col("p_name")).when(k == 1, text_of(F.expr("left(p_name, length(p_name) - 1)"), "#")).otherwise(F.lit("zzzz qqqq"))
    out = p.select(
        F.col("p_partkey").alias("record_id"), F.lit("support_ticket").alias("schema"), text_of("12 34 56 78 ", F.col("p_name"), " 90 12").alias("source_text"),
        text_of('{"product":"', name, '"}').alias("raw"),
    )
    return G.gate(out, fuzzy=True).select("record_id", "accepted", "step")
