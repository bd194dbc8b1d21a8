"""Command line: write a corpus as JSON lines.

python -m docsieve.sources.generate --schemas invoice,email --n 10 --severities 0 0.5 --operators typo --seed 7 --out corpus.jsonl
"""

from __future__ import annotations

import argparse
from collections.abc import Sequence

from pyspark.sql import SparkSession

from .corrupt import OPERATORS, corpus
from .jsonl import write_records


def split_names(tokens: Sequence[str] | None) -> list[str]:
    """Names given apart, with commas, or both; empty ones are dropped."""
    return [part.strip() for token in tokens or [] for part in token.split(",") if part.strip()]


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    """Returns how many records were written."""
    p = argparse.ArgumentParser(description="Write a corpus of synthetic documents as JSON lines.")
    p.add_argument("--schemas", nargs="*", help="none: all that the split allows")
    p.add_argument("--n", type=int, default=5, help="records for every schema and severity")
    p.add_argument("--severities", nargs="*", default=["0.0"])
    p.add_argument("--operators", nargs="*", help=f"of {', '.join(OPERATORS)}")
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--split", choices=("train", "eval", "any"), default="any")
    p.add_argument("--out", required=True)
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.getOrCreate()
    records = corpus(spark, split_names(a.schemas), a.n, [float(s) for s in split_names(a.severities)], split_names(a.operators), a.seed, a.split)
    write_records(records, a.out)
    written = spark.read.text(a.out).count()
    print(f"wrote {written} records to {a.out}")
    return written


if __name__ == "__main__":
    main()
