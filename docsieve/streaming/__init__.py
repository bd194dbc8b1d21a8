"""The stateless operators over streams.

Extraction, the pre-pass and corruption are row-wise expressions, so they run on a stream
as they stand.  Pooled metrics are sums, kept as running totals by event window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prepass import prepass


def prepass_stream(docs: DataFrame, schema: str, text: str = "source_text") -> DataFrame:
    """The pre-pass of a streaming table of documents."""
    if not docs.isStreaming:
        raise ValueError("docs is no stream; call prepass itself")
    return prepass(docs, schema, text)


def windowed_counts(results: DataFrame, at: str, window: str = "10 minutes", late: str = "20 minutes") -> DataFrame:
    """Totals of evaluated records by event-time window and schema; later rows than ``late`` are dropped by the watermark.

    The counts are those that the pooled metrics are ratios of.
    """
    counts = ("n_correct", "n_predicted", "n_reference", "n_missing", "n_hallucinated")
    return results.withWatermark(at, late).groupBy(F.window(at, window), "schema").agg(F.count(F.lit(1)).alias("n_records"), *[F.sum(c).alias(c) for c in counts])
