"""JSON lines and report files, as sources and sinks."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "struct<record_id:bigint,schema:string,source_text:string,reference:variant,tags:array<string>>"


def read_records(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """Evaluation records of a JSON-lines file; blank lines are skipped.

    A line that is no record raises an error that names the file and line (``strict``), or
    becomes a row with ``error``.  record_id is the line's place in the file order.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("record_id"))
    lines = lines.filter(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    schema = F.try_variant_get("v", "$.schema", "string")
    reference, tags = F.try_variant_get("v", "$.reference", "variant"), F.try_variant_get("v", "$.tags", "variant")
    tag_list = F.try_variant_get("v", "$.tags", "array<string>")
    kind = F.schema_of_variant
    error = (
        F.when(F.col("v").isNull() | ~kind(F.col("v")).startswith("OBJECT"), "not a JSON object")
        .when((F.coalesce(kind(F.try_variant_get("v", "$.schema", "variant")), F.lit("")) != "STRING") | (schema == ""), "schema must be a non-empty string")
        .when(reference.isNull() | ~kind(reference).startswith("OBJECT"), "reference must be an object")
        .when(tags.isNotNull() & ~kind(tags).isin("ARRAY<STRING>", "ARRAY<VOID>"), "tags must be a list of strings")
    )
    out = lines.select(
        "record_id", schema.alias("schema"), F.coalesce(F.try_variant_get("v", "$.source_text", "string"), F.lit("")).alias("source_text"),
        reference.alias("reference"), F.coalesce(tag_list, F.expr("cast(array() as array<string>)")).alias("tags"), error.alias("error"), "file",
    )
    if not strict:
        return out
    stop = F.raise_error(F.concat(F.col("file"), F.lit(", line "), F.col("record_id") + 1, F.lit(": "), F.col("error"))).cast("string")
    return out.withColumn("schema", F.when(F.col("error").isNotNull(), stop).otherwise(F.col("schema"))).drop("error", "file")


def json_line(record_id: str = "record_id") -> Column:
    """A record as one JSON line with sorted keys; ``reference`` is JSON text already."""
    quote = lambda c: F.regexp_extract(F.to_json(F.struct(F.col(c).alias("x"))), r'(?s)^\{"x":(.*)\}$', 1)
    return F.concat(F.lit('{"reference": '), F.col("reference"), F.lit(', "schema": '), quote("schema"), F.lit(', "source_text": '), quote("source_text"), F.lit(', "tags": '), F.to_json("tags"), F.lit("}"))


def write_records(records: DataFrame, path: str, one_file: bool = False) -> None:
    """JSON lines in record order; the same records give the same bytes (in one file if asked)."""
    lines = records.select("record_id", json_line().alias("value"))
    lines = lines.coalesce(1).sortWithinPartitions("record_id") if one_file else lines.orderBy("record_id")
    lines.select("value").write.mode("overwrite").text(path)


def write_split(results: DataFrame, path: str) -> None:
    """Admitted and rejected rows in folders of their own."""
    results.write.mode("overwrite").partitionBy("accepted").json(path)


def write_report(report: DataFrame, path: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(path)


def append_state(spark: SparkSession, path: str, **state: object) -> None:
    """One JSON line added to a state log."""
    spark.createDataFrame([(json.dumps(state, sort_keys=True),)], "value string").write.mode("append").text(path)


def read_state(spark: SparkSession, path: str, fields: Sequence[str]) -> DataFrame:
    """The named fields of every line of a state log, as text; null where one is absent."""
    lines = spark.read.text(path).withColumn("v", F.try_parse_json("value"))
    return lines.select(*[F.try_variant_get("v", f"$.{f}", "string").alias(f) for f in fields])


def read_json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of files that each hold one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def manifest_metric(manifest: Column, names: Sequence[str], fallback: float) -> Column:
    """The first of several JSON paths that an experiment manifest has, or the fallback."""
    return F.coalesce(*[F.get_json_object(manifest, n).try_cast("double") for n in names], F.lit(fallback))


def scraped(log: Column) -> Column:
    """struct<written, admitted, judged, percent> from a log's lines; null where there is none."""
    gate = r"Gate: (\d+)/(\d+) admitted \(([\d.]+)%"
    number = lambda p, i, kind: F.nullif(F.regexp_extract(log, p, i), F.lit("")).cast(kind)
    return F.struct(number(r"wrote (\d+) records", 1, "long").alias("written"), number(gate, 1, "long").alias("admitted"), number(gate, 2, "long").alias("judged"), number(gate, 3, "double").alias("percent"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """path and sha256 of files."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """A training corpus: schema, source_text, reference (JSON text) and tags, not validated."""
    return spark.read.schema("schema string, source_text string, reference string, tags array<string>").json(path)


def report_field(report: Column, name: str) -> Column:
    """A field of a report's JSON text, or null if there is no such report or field."""
    return F.try_variant_get(F.try_parse_json(report), f"$.{name}", "string")


def document_text(df: DataFrame, length: int = 500) -> Column:
    """The text of a row of some public dataset: its text, else its input, else the whole row, cut for display."""
    named = [F.col(c).cast("string") for c in ("text", "input") if c in df.columns]
    return F.substring(F.coalesce(*named, F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))), 1, length)
