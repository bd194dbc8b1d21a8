"""Failure analysis: what went wrong in each evaluated record, and counts of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import canonical

#: The categories in order.
CATEGORIES = (
    "missing_field", "incorrect_normalization", "wrong_entity_boundary", "wrong_inferred_value", "hallucinated_field",
    "schema_violation", "incorrect_nesting", "ambiguous_input", "unclassified_mismatch",
)
AMBIGUOUS = "ambiguate"


def mismatch(schema: Column, error: Column, predicted: Column, source: Column) -> Column:
    """The category of a leaf that both sides have and that differs.

    In this order: an ontology entry applied on either side; the reference value at
    another path of the prediction; one string inside the other; neither in the source.
    """
    p, r = error["predicted"], error["reference"]
    both = (error["p_kind"] == "str") & (error["r_kind"] == "str") & ~error["listy"]
    mapped = (canonical(schema, p) != p) | (canonical(schema, r) != r)
    elsewhere = F.exists(predicted, lambda x: (x["path"] != error["path"]) & F.array_contains(x["texts"], r))
    scalar = ~error["listy"] & (error["p_kind"] != "other") & ~error["r_kind"].isin("other", "null")
    a, b = F.trim(F.lower(F.upper(p))), F.trim(F.lower(F.upper(r)))
    folded = F.lower(F.upper(source))
    return (
        F.when(both & mapped, "incorrect_normalization")
        .when(scalar & elsewhere, "incorrect_nesting")
        .when(both & (a != "") & (b != "") & (a != b) & (F.contains(a, b) | F.contains(b, a)), "wrong_entity_boundary")
        .when(both & (a != "") & (b != "") & ~F.contains(folded, a) & ~F.contains(folded, b), "wrong_inferred_value")
        .otherwise("unclassified_mismatch")
    )


def classify(results: DataFrame, records: DataFrame | None = None) -> DataFrame:
    """One row a failure: record_id, schema, tags, seq, category, path, predicted, reference.

    results are evaluated records that kept ``source_text``; without it records give it by
    record_id.  A record tagged ambiguous is one failure and nothing else.
    """
    r = results if records is None else results.join(records.select("record_id", "source_text"), "record_id")
    r = r.withColumn("source", F.coalesce("source_text", F.lit("")))
    kind = "struct<category:string,path:string,predicted:string,reference:string>"

    def row(category: str | Column, path: Column, p: Column, q: Column) -> Column:
        return F.struct((F.lit(category) if isinstance(category, str) else category).alias("category"), path.alias("path"), p.alias("predicted"), q.alias("reference")).cast(kind)

    no = F.lit(None).cast("string")
    none = F.expr(f"cast(array() as array<{kind}>)")
    # an explicit null is missing already, not a mismatch as well
    wrong = F.filter("errors", lambda e: ~((e["p_kind"] == "null") & ~e["listy"]))
    every = F.concat(
        F.when(F.col("schema_valid"), none).otherwise(F.array(row("schema_violation", no, no, no))),
        F.transform("missing", lambda x: row("missing_field", x, no, no)),
        F.transform("hallucinated", lambda x: row("hallucinated_field", x, no, no)),
        F.transform(wrong, lambda e: row(mismatch(F.col("schema"), e, F.col("predicted"), F.col("source")), e["path"], e["predicted"], e["reference"])),
    )
    found = F.when(F.array_contains(F.coalesce("tags", F.expr("cast(array() as array<string>)")), AMBIGUOUS), F.array(row("ambiguous_input", no, no, no))).otherwise(every)
    return r.select("record_id", "schema", "tags", F.posexplode(found).alias("seq", "f")).select("record_id", "schema", "tags", "seq", "f.*")


def by_category(failures: DataFrame) -> DataFrame:
    """Counts of all nine categories, zeros included."""
    spine = failures.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    return spine.join(failures.groupBy("category").count(), "category", "left").select("category", F.coalesce("count", F.lit(0)).alias("n"))


def by_category_and_schema(failures: DataFrame) -> DataFrame:
    return failures.groupBy("category", "schema").agg(F.count(F.lit(1)).alias("n"))


def by_category_and_operator(failures: DataFrame) -> DataFrame:
    """Counts by corruption tag; tags that carry a severity are left out."""
    tags = failures.select("category", F.explode("tags").alias("operator")).filter(~F.col("operator").startswith("severity="))
    return tags.groupBy("category", "operator").agg(F.count(F.lit(1)).alias("n"))


def first_examples(failures: DataFrame, n: int = 5) -> DataFrame:
    """The first n failures of each category, in record order (a report)."""
    order = W.partitionBy("category").orderBy("record_id", "seq")
    return failures.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def top_category(failures: DataFrame) -> DataFrame:
    """The most frequent category other than ambiguous input; ties by name."""
    return failures.filter("category <> 'ambiguous_input'").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(1)


def top_groups(counts: DataFrame, group: str, n: int = 3) -> DataFrame:
    """The n largest groups of each category; ties by name."""
    order = W.partitionBy("category").orderBy(F.desc("n"), group)
    return counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)


def share_of(failures: DataFrame, category: str) -> DataFrame:
    """The share of failures in one category."""
    return failures.agg(F.coalesce(F.try_divide(F.count_if(F.col("category") == category), F.count(F.lit(1))), F.lit(0.0)).alias("share"))
