"""A corpus pipeline: language ID, line dedup, near-dedup, mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next stage's docs.  All but the last return the columns of
documents, and any further ones of docs, whatever their names.  An empty table stays empty
at every stage.  What stages do with nulls, ties and repeated rows is said at each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docsieve.llm import langid, linededup, mixing, neardocs, packing
from docsieve.llm.common import staged


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language go: null, empty and letterless texts, and all if no row has a language to learn.

    Rows are judged by their text alone, so repeated rows and null doc_ids fare like any other.
    """
    return langid.with_language(docs)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near lines one stays, at its first place by (doc_id, hash of the text, line); documents left empty go.

    Null doc_ids are first.  A null text has no line to lose and stays.  Of rows equal in doc_id
    and text one keeps its lines.
    """
    return linededup.without_repeated_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that share 0.8 of their five-word shingles one stays: the first by (doc_id, hash of the text).

    Null doc_ids are last; null, empty and blank texts are near each other; of rows equal in
    doc_id and text one stays.  Candidates are operator 4's links of fingerprints, and since two
    bits reach next to no pair at this similarity also MinHash's (see ``neardocs``).
    """
    return neardocs.one_of_each(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, shard by shard; where the target falls, a document is cut.

    Null sources are a source; null texts have no words and go; repeated rows are each in the mix.
    """
    return mixing.mixed_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their place in sequences of 2048 tokens.

    A null text is its end token alone; repeated rows are packed each.
    """
    import public_tokenizers

    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"))


STAGES = [
    ("language_id", identify_language),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("mix_sources", mix_sources),
    ("pack", pack_sequences),
]

#: Fuzzy lines, fingerprints, the seeded mix and token ids are beyond SQL; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs)
    return docs
