"""One query per operator, over tables rendered to documents whose truth is known.

Orders become records of two schemas.  A record's prediction is its gold, changed in a way
that the order key decides (see ``records``), so SQL over the tables gives the expected
counts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import catalog
from ..functions import extract as X
from ..functions.text import norm, ontology_lookup, to_date, to_number
from ..operators import calibration as C
from ..operators import failures as FA
from ..operators import gate as G
from ..operators import jsonops as J
from ..operators import merge as MG
from ..operators import metrics as M
from ..operators import prepass as P
from ..sources import corrupt as CO
from ..sources import jsonl
from ..sources.seeds import seeds
from . import corrupt_sql as CS
from .reports import confidence_report

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a task that extracts, evaluates or judges records, which take up to a millisecond each.
TASK_ROWS = 50_000


def tasks(df: DataFrame, times: int = 1) -> int:
    """As many tasks as take at most ``times`` TASK_ROWS of df's rows each, and one a core at least; counting reads no column."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // (times * TASK_ROWS)))


def spread(df: DataFrame) -> DataFrame:
    """df in tasks of equal size, whatever its files' row groups are: a file of few makes few tasks with all of its rows."""
    return df.repartition(tasks(df))


def text_of(*parts: Column | str) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def exploded(df: DataFrame, key: str, found: Column, *more: str) -> DataFrame:
    """One row an extraction.

    The outer form, since the filter that the optimiser infers for the other one would
    evaluate the extraction twice.
    """
    rows = df.select(key, F.posexplode_outer(found).alias("ord", "e")).filter("ord is not null")
    return rows.select(key, "ord", *[F.col(f"e.{c}").alias(f"{c}_" if c in ("start", "end") else c) for c in ("value", *more)])


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spread(table(spark, sf_dir, "orders")))


def _orders(o: DataFrame) -> DataFrame:
    o = o.select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", F.col("o_totalprice").cast("decimal(12,2)").alias("price"), "o_orderdate")
    return o.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))


# extractors -----------------------------------------------------------------


@query
def extract_emails(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return exploded(d, "doc_id", X.emails(F.col("text")), "start", "end")


@query
def extract_phones(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "customer").select("c_custkey", text_of("call +1 (", F.col("c_custkey") % 700 + 200, ") ", F.col("c_nationkey") + 300, "-", F.lpad((F.col("c_custkey") % 10000).cast("string"), 4, "0"), " now").alias("t"))
    return exploded(d, "c_custkey", X.phones(F.col("t")), "start", "end")


@query
def extract_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "pages").select("page_id", text_of("see ", F.col("url"), ". Then (", F.col("url"), ")!").alias("t"))
    return exploded(d, "page_id", X.urls(F.col("t")), "start")


@query
def extract_money(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("t", text_of("qty 4 of 2026: $", F.format_number("price", 2), " or (", F.format_number("price", 2), ") net"))
    return exploded(o, "o_orderkey", X.money(F.col("t")), "start")


@query
def extract_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("key"), (F.col("l_discount") * 100).cast("decimal(5,1)").alias("pct"))  # noqa: E741
    return exploded(l.withColumn("t", text_of("less ", F.col("pct"), " % now")), "key", X.percentages(F.col("t")), "start", "end")


def _dates(spark: SparkSession, sf_dir: str, pattern: str, *more: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("t", text_of("on ", F.date_format("o_orderdate", pattern), " sent"))
    return exploded(o, "o_orderkey", X.dates(F.col("t")), *more)


@query
def extract_dates_iso(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "yyyy/M/d", "start")


@query
def extract_dates_named(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _dates(spark, sf_dir, "MMMM d, yyyy", "start")


@query
def extract_dates_numeric(spark: SparkSession, sf_dir: str) -> DataFrame:
    """M/d/yyyy: the confidence is 0.7 where the day could be a month."""
    return _dates(spark, sf_dir, "M/d/yyyy", "confidence")


@query
def extract_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).withColumn("t", text_of("claim CLM-", F.col("o_orderkey"), " and POL", F.col("o_custkey"), " then XCLM-1"))
    return exploded(o, "o_orderkey", X.identifiers(F.col("t"), (r"\bCLM-?\d+\b", r"\bPOL-?\d+\b")), "start")


@query
def resolve_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates and amounts of one text; the amount inside the longer date goes."""
    o = orders(spark, sf_dir).withColumn("t", text_of("due ", F.date_format("o_orderdate", "MMMM d, yyyy"), " pay $", F.col("price"), " (", F.date_format("o_orderdate", "d.MM.yyyy"), ")"))
    found = F.concat(X.dates(F.col("t")), X.money(F.col("t")), X.identifiers(F.col("t"), (r"\d{4}\b",)))
    return exploded(o, "o_orderkey", X.resolve_overlaps(found), "extractor")


# pre-pass -------------------------------------------------------------------


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document an order: number, dates, vendor, items, tax and total."""
    o = table(spark, sf_dir, "orders")
    n = tasks(o)
    # both sides are dealt by the key into as many tasks, so that no other exchange sets the size of those that read the documents
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), F.col("l_extendedprice").cast("decimal(12,2)").alias("t")).repartition(n, "l_orderkey")  # noqa: E741
    item = text_of("Part ", F.col("l_linenumber"), " x ", F.col("q"), " @ $", (F.col("t") / F.col("q")).cast("decimal(12,2)"), " = $", F.col("t"), ".\n")
    items = l.groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "q", "t", item.alias("x")))), lambda s: s["x"]), "").alias("items"))
    text = text_of(
        "INV-", F.col("o_orderkey"), " date: ", F.col("day"), ", due: ", F.date_add(F.col("day").cast("date"), 30), "\nVendor: v", F.col("o_custkey"), "@shop.com, +1 (415) 555-2671\n",
        F.col("items"), "Subtotal: $", F.col("price"), ". Tax (8%): $", (F.col("price") * F.lit("0.08").cast("decimal(3,2)")).cast("decimal(12,2)"), ". Total: $", F.col("price"), ".",
    )
    return _orders(o.repartition(n, "o_orderkey")).join(items, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("record_id"), text.alias("source_text"))


@query
def prepass_invoice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.resolved_rows(P.prepass(invoices(spark, sf_dir), "invoice"))
    return p.filter(~F.col("repeated")).select("record_id", "path", F.col("values")[0].alias("value"))


@query
def line_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = P.resolved_rows(P.prepass(invoices(spark, sf_dir), "invoice"))
    return p.filter("repeated").select("record_id", "path", F.posexplode("values").alias("item", "value")).withColumn("value", F.col("value").cast("decimal(12,2)"))


@query
def unresolved_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).select(F.col("o_orderkey").alias("record_id"), F.when(F.col("o_orderkey") % 2 == 0, text_of("TKT-", F.col("o_orderkey"), " created ", F.col("day"))).otherwise(F.lit("no id here")).alias("source_text"))
    return P.prepass(d, "support_ticket").select("record_id", F.array_join("unresolved", ",").alias("unresolved"))


@query
def residual_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = orders(spark, sf_dir).select(F.col("o_orderkey").alias("record_id"), text_of("a@b.com owes ", F.col("price")).alias("source_text"))
    return P.prepass(d, "resume").select("record_id", P.residual_prompt(F.col("unresolved"), F.col("source_text")).alias("prompt"))


@query
def selection_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """first, last, max and min over three amounts."""
    o = orders(spark, sf_dir).withColumn("t", text_of("$", F.col("price"), " then $", F.col("price") + 10, " then $", F.col("price") + 5))
    m = X.money(F.col("t"))
    pick = lambda rule: P.select_match(F.col("t"), m, P.Binding("money", rule))["value"].cast("decimal(12,2)").alias(rule)
    return o.select("o_orderkey", pick("first"), pick("last"), pick("max"), pick("min"))


# JSON -----------------------------------------------------------------------


@query
def json_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("v", J.parse_object(F.col("props")))
    return e.select("event_id", F.try_variant_get("v", "$.k", "bigint").alias("k"))


@query
def json_find_object(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The object in noise, in a fence, with a brace in a string, or unbalanced."""
    e = table(spark, sf_dir, "events").select("event_id", "props")
    raw = (
        F.when(F.col("event_id") % 4 == 0, text_of("Sure: ", F.col("props"), " and {more}"))
        .when(F.col("event_id") % 4 == 1, text_of("```json\n", F.col("props"), "\n```\n{}"))
        .when(F.col("event_id") % 4 == 2, text_of('x {"a": "}{", "b": [', F.col("event_id"), "]} y"))
        .otherwise(text_of('{"a": [', F.col("event_id"), ",2}"))
    )
    return e.select("event_id", J.find_object(raw).alias("found"))


def _nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as a nested object."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"), "l_returnflag")  # noqa: E741
    l = l.repartition(tasks(l, 4), "l_orderkey")  # noqa: E741
    part = text_of('{"q":', F.col("q"), ',"flag":"', F.col("l_returnflag"), '"}')
    g = l.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", part.alias("x")))).alias("x"))
    text = text_of('{"id":', F.col("l_orderkey"), ',"meta":{"none":null,"empty":{}},"lines":[', F.array_join(F.transform("x", lambda s: s["x"]), ","), "]}")
    return g.select(F.col("l_orderkey").alias("record_id"), text.alias("json"))


@query
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    flat = J.flatten(_nested(spark, sf_dir).select("record_id", F.parse_json("json").alias("v")))
    return flat.filter(~F.col("empty")).groupBy("path", "listy").agg(F.count(F.lit(1)).alias("n"), F.count_if(J.kind_of(F.col("v")) == "null").alias("nulls"), F.sum(F.try_variant_get("v", "$", "bigint")).alias("total"))


@query
def json_unflatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = MG.model_leaves(_nested(spark, sf_dir).select("record_id", F.parse_json("json").alias("prediction")))
    v = F.try_parse_json(J.unflatten(F.col("leaves")))
    return rows.select("record_id", F.size(F.from_json(F.to_json(F.try_variant_get(v, "$.lines", "variant")), "array<string>")).alias("n"), F.try_variant_get(v, "$.id", "bigint").alias("id"), F.try_variant_get(v, "$.lines[0].q", "bigint").alias("q0"))


# comparison -----------------------------------------------------------------


@query
def normalize_ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = F.element_at(F.array(*[F.lit(x) for x in (" htn ", "T2DM", "Stroke", "copd")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    c = table(spark, sf_dir, "customer").withColumn("f", ontology_lookup(catalog.get_schema("medical_note").ontology, forms))
    return c.groupBy("f").agg(F.count(F.lit(1)).alias("n"))


@query
def tolerant_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    grouped = F.format_number("price", 2)
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, text_of("$", grouped))
        .when(F.col("o_orderkey") % 4 == 1, text_of("€ ", F.translate(grouped, ",.", ".,")))
        .when(F.col("o_orderkey") % 4 == 2, text_of(F.col("price")))
        .otherwise(text_of("N", F.col("price")))
    )
    return o.select("o_orderkey", to_number(raw).cast("decimal(12,2)").alias("n"))


@query
def tolerant_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir)
    raw = (
        F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "MM/dd/yyyy"))
        .when(F.col("o_orderkey") % 4 == 1, F.date_format("o_orderdate", "d MMMM yyyy"))
        .when(F.col("o_orderkey") % 4 == 2, F.date_format("o_orderdate", "yyyy-MM-dd"))
        .otherwise(F.lit("in summary"))
    )
    return o.select("o_orderkey", to_date(raw).cast("string").alias("d"))


@query
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", norm(text_of("  ", F.upper("p_name"), "\t\n ", F.col("p_brand"), " ")).alias("t"))


# evaluation -----------------------------------------------------------------


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as records of invoice (key divisible by 3) or support_ticket, with raw outputs.

    By key modulo 7 the output is the gold (0), lacks the last field (1), has another second
    value that is not in the source (2), has the gold in a fence (3), has a key beyond the
    schema (4), is no JSON (5), or has null first (6).  Divisible by 11: tagged ambiguous.
    """
    k = F.col("o_orderkey")
    inv = k % 3 == 0
    names = [F.when(inv, a).otherwise(b) for a, b in (("invoice_number", "ticket_id"), ("vendor_name", "urgency"), ("invoice_date", "created_date"))]
    values = [F.when(inv, text_of("INV-", k)).otherwise(text_of("TKT-", k)), text_of("V", F.col("o_custkey")), F.col("day")]
    pair = lambda i, v: F.concat(F.lit('"'), names[i], F.lit('":'), v)
    quoted = lambda v: F.concat(F.lit('"'), v, F.lit('"'))
    obj = lambda *parts: F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    gold = obj(*[pair(i, quoted(values[i])) for i in range(3)])
    m = k % 7
    raw = (
        F.when(m == 1, obj(pair(0, quoted(values[0])), pair(1, quoted(values[1]))))
        .when(m == 2, obj(pair(0, quoted(values[0])), pair(1, F.lit('"Ghost"')), pair(2, quoted(values[2]))))
        .when(m == 3, F.concat(F.lit("Here:\n```json\n"), gold, F.lit("\n```")))
        .when(m == 4, obj(*[pair(i, quoted(values[i])) for i in range(3)], F.lit('"zz":1')))
        .when(m == 5, F.lit("none"))
        .when(m == 6, obj(pair(0, F.lit("null")), pair(1, quoted(values[1])), pair(2, quoted(values[2]))))
        .otherwise(gold)
    )
    tags = F.when(k % 11 == 0, F.array(F.lit("typo"), F.lit("ambiguate"), F.lit("severity=0.5"))).otherwise(F.array(F.lit("typo"), F.lit("severity=0.5")))
    return orders(spark, sf_dir).select(
        k.alias("record_id"), F.when(inv, "invoice").otherwise("support_ticket").alias("schema"), text_of(values[0], " for ", values[1], " on ", values[2]).alias("source_text"),
        gold.alias("gold"), F.parse_json(gold).alias("reference"), raw.alias("raw"), tags.alias("tags"),
    )


def evaluated(spark: SparkSession, sf_dir: str, lists: bool = False) -> DataFrame:
    return M.evaluate_records(records(spark, sf_dir).withColumn("prediction", J.parse_object(F.col("raw"))), lists=lists)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes])


@query
def eval_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = evaluated(spark, sf_dir, lists=True)
    return r.select("record_id", "exact_match", "schema_valid", "n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated", F.array_join("missing", ",").alias("missing"), F.array_join("hallucinated", ",").alias("hallucinated"), F.size("errors").alias("n_errors"))


def _slice(kind: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(M.sliced(evaluated(spark, sf_dir)).filter(F.col("slice_kind") == kind).drop("slice_kind"))

    return run


for _kind in ("overall", "schema", "tag", "excluded"):
    QUERIES[f"eval_{'by_' if _kind in ('schema', 'tag') else ''}{_kind}"] = _slice(_kind)


@query
def eval_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics by row and schemas by column."""
    s = M.sliced(evaluated(spark, sf_dir)).filter("slice_kind = 'schema'")
    return rounded(M.metric_table(s, ["invoice", "support_ticket"]))


@query
def list_partial_credit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order's lines; the prediction lacks lines after the third and has the second wrong."""
    l = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("int").alias("q"))  # noqa: E741
    l = l.repartition(tasks(l, 4), "l_orderkey")  # noqa: E741
    one = lambda q: text_of('{"quantity":', q, "}")
    g = l.groupBy("l_orderkey").agg(
        F.array_join(F.collect_list(one(F.col("q"))), ",").alias("r"),
        F.array_join(F.collect_list(F.when(F.col("l_linenumber") <= 3, one(F.when(F.col("l_linenumber") == 2, 9999).otherwise(F.col("q"))))), ",").alias("p"),
    )
    whole = lambda c: F.parse_json(text_of('{"line_items":[', F.col(c), "]}"))
    recs = g.select(F.col("l_orderkey").alias("record_id"), F.lit("invoice").alias("schema"), F.lit(None).cast("string").alias("source_text"), F.expr("cast(array() as array<string>)").alias("tags"), whole("p").alias("prediction"), whole("r").alias("reference"))
    return M.evaluate_records(recs, lists=False).select("record_id", "n_correct", "n_predicted", "n_reference", "n_missing", "exact_match", "schema_valid")


def _systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules, model and hybrid predictions of the invoice records."""
    r = records(spark, sf_dir).filter("schema = 'invoice'")
    j = P.prepass(r, "invoice").withColumn("model", J.parse_object(F.col("raw"))).withColumn("leaves", MG.leaves_of(F.col("model")))
    rules = MG.rule_leaves(F.col("resolved"))
    systems = F.array(
        F.struct(F.lit("rules").alias("system"), MG.rules_only(F.col("resolved")).alias("v")),
        F.struct(F.lit("model").alias("system"), F.col("model").alias("v")),
        F.struct(F.lit("hybrid").alias("system"), MG.merged_object(rules, F.col("leaves"), "invoice").alias("v")),
    )
    return j.withColumn("s", F.explode(systems)).select("record_id", "schema", "source_text", "reference", F.array("s.system").alias("tags"), F.col("s.v").alias("prediction"))


@query
def hybrid_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pooled metrics of rules, model and hybrid; the system is the record's tag."""
    rows = _systems(spark, sf_dir)
    named = rows.withColumn("record_id", F.concat_ws(":", "record_id", F.col("tags")[0]))
    return rounded(M.evaluate_records(named, lists=False).groupBy(F.col("tags")[0].alias("system")).agg(*M.pooled()))


@query
def hybrid_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = _systems(spark, sf_dir).filter(F.array_contains("tags", "hybrid"))
    get = lambda n: F.try_variant_get("prediction", f"$.{n}", "string").alias(n)
    return v.select("record_id", get("invoice_number"), get("vendor_name"), get("invoice_date"))


# gate -----------------------------------------------------------------------


def _gated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.gate(records(spark, sf_dir))


@query
def gate_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gated(spark, sf_dir).select("record_id", "accepted", "step", F.array_join("reasons", ";").alias("reason"), F.array_join("unsupported_fields", ",").alias("unsupported"))


@query
def gate_rejection_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(G.rejection_rate(_gated(spark, sf_dir)))


@query
def gate_top_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.top_reasons(_gated(spark, sf_dir))


@query
def gate_regate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected outputs judged again with fuzzy support; a typo in the source is forgiven."""
    r = records(spark, sf_dir).withColumn("source_text", F.when(F.col("record_id") % 5 == 0, F.regexp_replace("source_text", " for V", " for Vx")).otherwise(F.col("source_text")))
    return G.regate(r, G.gate(r)).groupBy("accepted", "step").count()


# calibration ----------------------------------------------------------------


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", (F.pmod(F.col("event_id") * 37, F.lit(101)) / 100).alias("confidence"), (F.pmod(F.col("event_id") * 13, F.lit(10)) < 6).alias("correct"))


@query
def reliability_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.reliability_bins(scored(spark, sf_dir)))


@query
def calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.expected_calibration_error(scored(spark, sf_dir)))


@query
def temperature_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.fit_temperature(scored(spark, sf_dir)))


@query
def temperature_scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("event_id", F.round(C.calibrate(F.col("confidence"), 2.5), 6).alias("c"))


@query
def risk_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.risk_coverage(scored(spark, sf_dir)))


@query
def coverage_at_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(C.coverage_at_risk(C.risk_coverage(scored(spark, sf_dir)), 0.4))


@query
def fit_holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.split_even_odd(scored(spark, sf_dir), "event_id").groupBy("part").agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("y"))


@query
def sequence_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.array(*[-F.pmod(F.col("event_id") + i, F.lit(5)) / 10 for i in range(4)]).alias("p"), F.array(*[F.pmod(F.col("event_id") + i, F.lit(3)) for i in range(4)]).alias("t"))
    return e.select("event_id", F.round(C.sequence_confidence(F.col("p"), F.col("t"), [2]), 6).alias("c"))


@query
def confidence_eval(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = evaluated(spark, sf_dir).withColumn("c", F.pmod(F.col("record_id") * 37, F.lit(101)) / 100)
    return rounded(confidence_report(e, "c"))


@query
def record_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluated(spark, sf_dir).select("record_id", F.round(M.field_f1(), 6).alias("f1"))


@query
def public_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("text")).alias("text"), F.col("source").alias("input"))
    return d.select("doc_id", jsonl.document_text(d).alias("t"))


# failures -------------------------------------------------------------------


def _failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = records(spark, sf_dir)
    return FA.classify(M.evaluate_records(r.withColumn("prediction", J.parse_object(F.col("raw"))), "source_text"))


@query
def failure_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.by_category(_failures(spark, sf_dir))


@query
def failure_by_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.by_category_and_schema(_failures(spark, sf_dir))


@query
def failure_by_operator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.by_category_and_operator(_failures(spark, sf_dir))


@query
def failure_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.first_examples(_failures(spark, sf_dir)).select("category", "place", "record_id")


@query
def failure_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.top_category(_failures(spark, sf_dir))


@query
def failure_top_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return FA.top_groups(FA.by_category_and_schema(_failures(spark, sf_dir)), "schema", 1).drop("place")


@query
def failure_missing_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(FA.share_of(_failures(spark, sf_dir), "missing_field"))


# catalogue and sources ------------------------------------------------------


@query
def schema_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves by owner of the schemas that may be trained on."""
    d = catalog.field_dim(spark).join(F.broadcast(catalog.schema_dim(spark).filter(~F.col("held_out"))), "schema", "left_semi")
    return d.groupBy("schema").agg(F.count_if(F.col("owner") == "rule").alias("rule"), F.count_if(F.col("owner") == "model").alias("model"))


@query
def jsonl_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as key-sorted JSON lines."""
    r = records(spark, sf_dir).withColumn("reference", F.col("gold"))
    return r.select("record_id", jsonl.json_line().alias("line"))


@query
def log_scrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = orders(spark, sf_dir).select("o_orderkey", jsonl.scraped(text_of("x\nwrote ", F.col("o_orderkey"), " records\n[+] Gate: 3/", F.col("o_custkey"), " admitted (12.5% of all)")).alias("s"))
    return o.select("o_orderkey", "s.*")


@query
def manifest_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = orders(spark, sf_dir).withColumn("m", F.when(F.col("o_orderkey") % 3 == 0, text_of('{"f1": ', F.col("price"), "}")).when(F.col("o_orderkey") % 3 == 1, text_of('{"eval": {"f1": ', F.col("price"), "}}")).otherwise(F.lit("not json")))
    return m.select("o_orderkey", jsonl.manifest_metric(F.col("m"), ("$.f1", "$.eval.f1"), -1.0).alias("f1"))


def corpus_size(spark: SparkSession, sf_dir: str) -> int:
    """Records of each schema and severity: as many as there are customers, over thirty."""
    return max(1, table(spark, sf_dir, "customer").count() // 30)


def _seeded(name: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return seeds(spark, name, table(spark, sf_dir, "customer").count())

    return run


def _corrupted(operator: str) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        c = CO.corpus(spark, [], corpus_size(spark, sf_dir), list(CS.LEVELS), [operator], seed=CS.SEED)
        severity = F.substring_index(F.element_at("tags", -1), "=", -1).cast("double")
        return c.select("record_id", "schema", "reference", CS.SHOWN[operator](F.col("source_text"), severity).alias("shown"))

    return run


for _name in [s.name for s in catalog.schemas()]:
    QUERIES[f"seed_{_name}"] = _seeded(_name)
for _name in CO.OPERATORS:
    QUERIES[f"corrupt_{_name}"] = _corrupted(_name)


@query
def corpus_generate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chain of operators on schemas for training: gold, severity, and the text where that is 0."""
    c = CO.corpus(spark, ["invoice", "medical_note"], corpus_size(spark, sf_dir), list(CS.LEVELS), ["ocr_noise", "typo", "delabel"], seed=7, split="train")
    level = F.element_at("tags", -1)
    changed = F.size("tags") > 1
    return c.select("record_id", "schema", "reference", level.alias("severity"), changed.alias("changed"), F.when(level == "severity=0.0", F.col("source_text")).alias("clean"))


@query
def degradation_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What rules alone reach on corpora of growing severity."""
    c = CO.corpus(spark, [], corpus_size(spark, sf_dir), [0.0, 0.3, 0.6, 1.0], ["ocr_noise", "typo", "delabel"], seed=11).withColumn("severity", F.element_at("tags", -1))
    p = P.prepass(c).withColumn("prediction", MG.rules_only(F.col("resolved")))
    p = p.select("record_id", "schema", "source_text", F.array("severity").alias("tags"), "prediction", F.parse_json("reference").alias("reference"))
    return rounded(M.evaluate_records(p, lists=False).groupBy(F.col("tags")[0].alias("severity")).agg(*M.pooled()))
