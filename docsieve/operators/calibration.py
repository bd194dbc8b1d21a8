"""Calibration of confidences: reliability bins, ECE, temperature, risk and coverage.

Input is a table with ``confidence`` (0 to 1) and ``correct`` (boolean).  Confidences outside
0..1 are an error.  Global orders (``ordered``) are ranges of the key in tasks of their own;
what runs in one task has a row a range.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

CLAMP = 1e-6


def ordered(df: DataFrame, *by: Column | str) -> tuple[DataFrame, DataFrame]:
    """df written in the order of ``by`` with _range and _row (its place there), and the ranges with their sizes.

    Ranges are sampled, so a key of its own in many rows makes one range large and no other.
    """
    rows = df.repartitionByRange(*by).sortWithinPartitions(*by)
    rows = rows.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    path = shared_dir(df.sparkSession)
    rows.write.parquet(path)
    rows = df.sparkSession.read.schema(rows.schema).parquet(path)
    return rows, rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_size"))


def _earlier(of: str) -> Column:
    """The sum of a column over the ranges before; there is one row a range."""
    return F.coalesce(F.sum(of).over(W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def _checked(df: DataFrame) -> DataFrame:
    c = F.col("confidence").cast("double")
    bad = c.isNull() | F.isnan(c) | ~c.between(0, 1)
    return df.withColumn("confidence", F.when(bad, F.raise_error(F.lit("a confidence is not in 0..1"))).otherwise(c))


def _bin(c: Column, n: int) -> Column:
    """Equal widths; 1.0 is in the last."""
    return F.least(F.floor(c * n), F.lit(n - 1)).cast("int")


def reliability_bins(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """bin, lo, hi, confidence, accuracy, count for every bin; empty ones are zero."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    found = _checked(df).groupBy(_bin(F.col("confidence"), n_bins).alias("bin")).agg(
        F.avg("confidence").alias("confidence"), F.avg(F.col("correct").cast("int")).alias("accuracy"), F.count(F.lit(1)).alias("count")
    )
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    zero = lambda c, z: F.coalesce(c, F.lit(z)).alias(c)
    return spine.join(found, "bin", "left").select(
        "bin", (F.col("bin") / n_bins).alias("lo"), ((F.col("bin") + 1) / n_bins).alias("hi"), zero("confidence", 0.0), zero("accuracy", 0.0), zero("count", 0)
    )


def expected_calibration_error(df: DataFrame, n_bins: int = 10) -> DataFrame:
    """One row, ``ece``."""
    b = reliability_bins(df, n_bins)
    return b.agg(F.coalesce(F.sum(F.col("count") * F.abs(F.col("accuracy") - F.col("confidence"))) / F.sum("count"), F.lit(0.0)).alias("ece"))


def calibrate(confidence: Column, temperature: Column | float) -> Column:
    """sigmoid(logit(confidence) / temperature), the confidence kept off 0 and 1."""
    t = F.lit(temperature) if isinstance(temperature, float | int) else temperature
    p = F.least(F.greatest(confidence, F.lit(CLAMP)), F.lit(1 - CLAMP))
    z = (F.log(p) - F.log(1 - p)) / t
    value = F.when(z >= 0, 1 / (1 + F.exp(-z))).otherwise(F.exp(z) / (1 + F.exp(z)))
    return F.when(t > 0, value).otherwise(F.raise_error(F.lit("a temperature must be positive")))


def fit_temperature(df: DataFrame, lo: float = 0.05, hi: float = 50.0, steps: int = 500, n_bins: int = 10) -> DataFrame:
    """temperature and ece of the grid point with the least ECE; ties go to the lower one.

    Equal (confidence, correct) rows are counted first; what meets the grid (``steps``
    rows, broadcast) is at most the distinct values.
    """
    if not 0 < lo < hi or steps < 1:
        raise ValueError("need 0 < lo < hi and steps >= 1")
    step = (hi - lo) / (steps - 1) if steps > 1 else 0.0
    grid = df.sparkSession.range(steps).select((F.lit(lo) + F.lit(hi - lo) * F.col("id") / max(steps - 1, 1)).alias("temperature")) if step else df.sparkSession.range(1).select(F.lit(lo).alias("temperature"))
    counted = _checked(df).groupBy("confidence", "correct").agg(F.count(F.lit(1)).alias("n"))
    c = counted.join(F.broadcast(grid)).withColumn("c", calibrate(F.col("confidence"), F.col("temperature")))
    bins = c.groupBy("temperature", _bin(F.col("c"), n_bins).alias("bin")).agg(
        F.sum(F.col("c") * F.col("n")).alias("sum_c"), F.sum(F.when(F.col("correct"), F.col("n")).otherwise(0)).alias("sum_y"), F.sum("n").alias("n")
    )
    ece = bins.groupBy("temperature").agg((F.sum(F.abs(F.col("sum_y") - F.col("sum_c"))) / F.sum("n")).alias("ece"))
    # rounded, so that the order of summation decides no tie
    best = F.min(F.struct(F.round("ece", 12).alias("ece"), "temperature")).alias("x")
    return ece.agg(best).select("x.temperature", "x.ece")


def risk_coverage(df: DataFrame) -> DataFrame:
    """threshold, coverage, risk for every distinct confidence, highest first.

    Counts by confidence come first; running sums are inside ranges of distinct values, and
    over the ranges.
    """
    counts = _checked(df).groupBy(F.col("confidence").alias("threshold")).agg(F.count(F.lit(1)).alias("n"), F.count_if("correct").alias("y"))
    rows, _ = ordered(counts, F.desc("threshold"))
    sums = rows.groupBy("_range").agg(F.sum("n").alias("n"), F.sum("y").alias("y"))
    before = sums.select("_range", _earlier("n").alias("n_before"), _earlier("y").alias("y_before"), F.sum("n").over(W.partitionBy()).alias("all"))
    down = W.partitionBy("_range").orderBy("_row").rowsBetween(W.unboundedPreceding, W.currentRow)
    n, y = F.sum("n").over(down) + F.col("n_before"), F.sum("y").over(down) + F.col("y_before")
    return rows.join(before, "_range").select("threshold", (n / F.col("all")).alias("coverage"), (1 - y / n).alias("risk"))


def coverage_at_risk(points: DataFrame, max_risk: float) -> DataFrame:
    """The greatest coverage with a risk of at most ``max_risk``; 0 if there is none."""
    if max_risk < 0:
        raise ValueError("max_risk must not be negative")
    return points.agg(F.coalesce(F.max(F.when(F.col("risk") <= max_risk, F.col("coverage"))), F.lit(0.0)).alias("coverage"))


def split_even_odd(df: DataFrame, key: str) -> DataFrame:
    """df with ``part``: fit for even places in key order, holdout for odd ones."""
    rows, sizes = ordered(df, key)
    before = sizes.select("_range", _earlier("_size").alias("_before"))
    place = F.col("_row") + F.col("_before")
    return rows.join(before, "_range").withColumn("part", F.when(place % 2 == 0, "fit").otherwise("holdout")).drop("_range", "_row", "_before")


def sequence_confidence(logprobs: Column, tokens: Column, stops: list[int]) -> Column:
    """exp of the mean log probability before the first stop token; 0 for none."""
    first = F.array_position(F.transform(tokens, lambda t: t.isin(*stops)), True)
    used = F.when(first > 0, F.slice(logprobs, F.lit(1), F.greatest(first - 1, F.lit(0)).cast("int"))).otherwise(logprobs)
    mean = F.aggregate(used, F.lit(0.0), lambda a, x: a + x) / F.size(used)
    return F.when(F.size(used) > 0, F.least(F.greatest(F.exp(mean), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
