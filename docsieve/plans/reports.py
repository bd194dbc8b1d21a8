"""Reports composed of the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import calibration as C
from ..operators.jsonops import parse_object
from ..operators.metrics import field_f1
from ..sources.scratch import shared_dir


def confidence_report(results: DataFrame, confidence: str, threshold: float = 0.5, risks: Sequence[float] = (0.1, 0.2, 0.3), steps: int = 500) -> DataFrame:
    """One row: the temperature fitted on even records, errors before and after on odd ones, coverage at each risk.

    results are evaluated records with a confidence column; a record is correct if its
    field F1 reaches the threshold.  The coverages are those of all records.
    """
    scored = results.select("record_id", F.col(confidence).alias("confidence"), (field_f1() >= threshold).alias("correct"))
    # three jobs read it, and none is to evaluate the records again
    path = shared_dir(results.sparkSession)
    scored.write.parquet(path)
    scored = results.sparkSession.read.schema(scored.schema).parquet(path)
    parts = C.split_even_odd(scored, "record_id")
    fit, hold = (parts.filter(F.col("part") == p) for p in ("fit", "holdout"))
    t = C.fit_temperature(fit, steps=steps)
    after = hold.join(F.broadcast(t)).withColumn("confidence", C.calibrate(F.col("confidence"), F.col("temperature")))
    out = t.select("temperature", F.col("ece").alias("ece_fit"))
    for name, df in (("ece_holdout_raw", hold), ("ece_holdout", after)):
        out = out.join(C.expected_calibration_error(df).withColumnRenamed("ece", name))
    points = C.risk_coverage(scored)
    for r in risks:
        out = out.join(C.coverage_at_risk(points, r).withColumnRenamed("coverage", f"coverage_at_{round(100 * r)}"))
    return out


def generation_summary(outputs: DataFrame) -> DataFrame:
    """One row of outputs (raw, tokens, seconds): tokens a second, and the share in which there is a JSON object; 0 without any."""
    valid = F.count_if(parse_object(F.col("raw")).isNotNull())
    rate = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0)).cast("double")
    return outputs.agg(rate(F.sum("tokens"), F.sum("seconds")).alias("tokens_per_second"), rate(valid, F.count(F.lit(1))).alias("valid_json"))
