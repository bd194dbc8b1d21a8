"""Helpers that the training-data operators share.

Words are runs of anything but space and U+0009..U+000D.  Those are all ASCII, so
``bytes.split()`` on UTF-8 gives exactly these words, and byte-level numpy code sees
the same borders as code-point-level code.
"""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import shared_dir

#: Java and Python spelling of a word.
WORD = r"[^\x20\x09-\x0D]+"
_MIX = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
_INVERSE = pow(_BASE, -1, 1 << 64)


def staged(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: lineage ends, lost executors cost nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_staged(df: DataFrame) -> None:
    """Delete what ``staged`` wrote for df, once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if "/docsieve-" in path:
            at = spark._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def only(df: DataFrame, *names: str) -> DataFrame:
    """The named columns by exact place, whatever else the table holds."""
    return df.select(*[F.col(f"`{n}`") for n in names])


def as_struct(docs: DataFrame) -> DataFrame:
    """All columns as one, ``_doc``, so that a join adds no name that clashes."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))


def from_struct(df: DataFrame, columns: list[str], text: Column) -> DataFrame:
    """The columns of ``_doc`` with another text, and n_chars to match if there is such a column."""
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return df.select(*[new[c].alias(c) if c in new else F.col("_doc").getField(c).alias(c) for c in columns])


def text_hash(text: Column | None = None) -> Column:
    """The hash that stands for a row's text; null counts as empty."""
    return F.xxhash64(F.coalesce(F.col("text") if text is None else text, F.lit("")))


def without_rows(docs: DataFrame, gone: DataFrame, repeated: DataFrame) -> DataFrame:
    """docs without the rows of ``gone``, and with one row for those of ``repeated`` (the least by all columns).

    Both have doc_id and row (hash of the text), different ones.
    """
    whole = as_struct(docs).withColumn("_row", text_hash(F.col("_doc.text")))

    def of(keys: DataFrame, how: str) -> DataFrame:
        k = keys.select(F.col("doc_id").alias("k_id"), F.col("row").alias("k_row"))
        return whole.join(k, F.col("_doc.doc_id").eqNullSafe(F.col("k_id")) & (F.col("_row") == F.col("k_row")), how)

    single = of(gone.union(repeated), "left_anti").select("_doc")
    one = of(repeated, "left_semi").groupBy(F.col("_doc.doc_id").alias("k_id"), "_row").agg(F.min("_doc").alias("_doc")).select("_doc")
    return from_struct(single.union(one), docs.columns, F.col("_doc.text"))


def first_rows(docs: DataFrame, rows: DataFrame) -> DataFrame:
    """Of every root one row of docs; rows has root, doc_id, row (hash of the text) and n, how many rows are equal in these.

    The first by (doc_id, row) stays, null doc_ids last.
    """
    keyed = staged(rows.select("root", "n", F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row").alias("key")))
    # a table of its own, so that a large group can be split over tasks
    first = staged(keyed.groupBy("root").agg(F.min("key").alias("first"), F.sum("n").alias("all")).filter("all > 1").drop("all"))
    several = keyed.join(first, "root")
    gone = several.filter("key <> first").select("key.doc_id", "key.row")
    repeated = several.filter("key = first and n > 1").select("key.doc_id", "key.row")
    return without_rows(docs, staged(gone), staged(repeated))


def give_back() -> None:
    """Return freed memory to the system; workers wait for their next task with what they hold."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
        trim(0)


def lean(run: Callable[[Iterable], Iterator]) -> Callable[[Iterable], Iterator]:
    """A function of batches that gives memory back at its end."""

    def wrapped(batches: Iterable) -> Iterator:
        try:
            yield from run(batches)
        finally:
            give_back()

    return wrapped


def arrow_map(
    df: DataFrame, schema: str, one: Callable[[pa.RecordBatch], Iterator[pa.RecordBatch] | pa.RecordBatch | None]
) -> DataFrame:
    """mapInArrow with a function of one batch."""

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                out = one(batch)
                if isinstance(out, pa.RecordBatch):
                    yield out
                elif out is not None:
                    yield from out

    return df.mapInArrow(lean(run), schema)


def text_chunks(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; one long text stays whole."""
    if not batch.num_rows:
        return
    sizes = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch[column]), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = sizes[start - 1] if start else 0
        end = max(start + 1, int(np.searchsorted(sizes, before + limit, side="right")))
        yield batch.slice(start, end - start)
        start = end


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def is_space(data: np.ndarray) -> np.ndarray:
    return (data == 32) | ((data >= 9) & (data <= 13))


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (the public splitmix64 constants)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends (bytes), 64-bit hashes of all words, and where each text's words begin (n + 1).

    Equal words have equal hashes; unequal ones may collide, so callers verify.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    letter = ~is_space(data)
    first = letter.copy()
    first[1:] &= ~letter[:-1]
    inner = offsets[1:-1]
    inner = inner[inner < n]
    first[inner] = letter[inner]  # a text's first byte begins a word
    last = np.empty(n, bool)
    last[:-1] = letter[:-1] & (~letter[1:] | first[1:])
    last[-1] = letter[-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    powers, inverse = _powers(_BASE, n), _powers(_INVERSE, n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers, out=sums[1:])
    hashes = mix64((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * _MIX)
    return starts, ends, hashes, np.searchsorted(starts, offsets)


def word_count(text: Column) -> Column:
    """Number of words; null counts as no text."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(spark: SparkSession, key: Column, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
