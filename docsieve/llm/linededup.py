"""Fuzzy line deduplication by MinHash (operator 8).

A line is a run of text between newlines, compared without the white space at its ends.
Equal lines are one line from the start.  Different ones are near when the Jaccard
similarity of their sets of character shingles (``SHINGLE`` code points; a shorter line
is one shingle) is at least ``threshold``:

1. one-permutation MinHash: each shingle hash falls in one of ``BANDS * ROWS`` bins, each
   bin keeps its least value, an empty bin borrows by a fixed second hash; all numpy, one
   pass over the text;
2. banding: lines that agree in a whole band are candidates.  With 12 bands of 4 rows a
   pair at 0.8 is missed with a chance of 0.2 %;
3. exact Jaccard verification, a bucket of up to ``SMALL`` different lines at a time: the
   sizes of all intersections are one product of the 0/1 matrix of lines and shingles, in
   bounded slices, and only a forest of the near pairs leaves the task.  Buckets of the
   same lines are compared once.  Of a larger bucket every line is first compared with the
   least; those near it are joined, and what is left is compared with all lines in groups of
   half that size, of which every two are such a bucket.  So no pair that could join two
   components is left out, no task is large, and the work grows with lines times what is left;
4. distributed union-find over the verified pairs; the component's first occurrence stays.

A line's class keeps the occurrence that comes first by (doc_id, line number).  Empty
lines are never duplicates.

Defined results: null text is one empty line; repeated rows have repeated lines, of which
the first row's stay (ties go by the text's hash, null doc_ids are first); of rows equal in doc_id
and text one is the first, and the others lose all lines; an empty table gives an empty table;
other columns keep their values.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, as_struct, from_struct, mix64, only, staged, text_hash, without_rows
from .components import components
from .sharing import shared_rows

SHINGLE = 9
BANDS, ROWS = 12, 4
THRESHOLD = 0.8
SMALL = 800
_P = np.uint64(0x9E3779B97F4A7C15)
#: White space that is not compared at the ends of a line.
_ENDS = " \t\x0b\x0c\r"
_EMPTY = np.uint32(0xFFFFFFFF)


def shingle_hashes(lines: list[str], width: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all character shingles and the line that each is from."""
    padded = [x if len(x) >= width else x + "\0" * (width - len(x)) for x in lines]
    code = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    sizes = np.fromiter(map(len, padded), np.int64, len(padded))
    ends = np.cumsum(sizes)
    h = np.zeros(max(len(code) - width + 1, 0), np.uint64)
    for j in range(width):
        h = h * _P + code[j : len(code) - width + 1 + j]
    line = np.repeat(np.arange(len(lines)), sizes)[: len(h)]
    inside = np.arange(len(h)) + width <= ends[line]
    return mix64(h[inside]), line[inside]


def signatures(lines: list[str], bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE) -> np.ndarray:
    """One value a line and band, from one hash a shingle."""
    bins = bands * rows
    h, line = shingle_hashes(lines, width)
    at = line * bins + ((h >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    sig = np.full(len(lines) * bins, _EMPTY, np.uint32)
    np.minimum.at(sig, at, np.minimum(h.astype(np.uint32), _EMPTY - np.uint32(1)))
    sig = sig.reshape(-1, bins)
    todo = np.flatnonzero((sig == _EMPTY).any(axis=1))
    if len(todo):
        own = sig[todo]
        full = own.copy()
        for t in range(2 * bins):  # a fixed pseudo-random tour for each bin, then all bins in turn
            lack = full == _EMPTY
            if not lack.any():
                break
            j = np.arange(bins, dtype=np.uint64)
            src = (mix64(j * np.uint64(1009) + np.uint64(t)) % np.uint64(bins)).astype(int) if t < bins else (np.arange(bins) + t) % bins
            full = np.where(lack, own[:, src], full)
        sig[todo] = full
    value = np.zeros((len(lines), bands), np.uint64)
    value += np.arange(1, bands + 1, dtype=np.uint64)
    for r in range(rows):
        value = mix64(value * _P + sig.reshape(-1, bands, rows)[:, :, r])
    return value


def _lines(batch: pa.RecordBatch, limit: int = 1 << 19):
    """Lists of different non-empty lines with about ``limit`` code points in each."""
    seen: dict[str, None] = {}
    size = 0
    for text in batch["text"]:
        for line in (text.as_py() or "").split("\n"):
            line = line.strip(_ENDS)
            if line and line not in seen:
                seen[line] = None
                size += len(line)
                if size >= limit:
                    yield list(seen)
                    seen, size = {}, 0
    if seen:
        yield list(seen)


def _node(lines: list[str]) -> np.ndarray:
    """The same 64-bit hash as Spark's xxhash64."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x.encode("utf-8", "surrogatepass"), 42) for x in lines), np.uint64, len(lines))


def _banded(bands, rows, batch):
    for lines in _lines(batch):
        yield signatures(lines, bands, rows).ravel(), np.repeat(_node(lines), bands)


def _texts(batch: pa.RecordBatch):
    for lines in _lines(batch, 2 << 20):
        yield pa.RecordBatch.from_arrays([pa.array(_node(lines).view(np.int64)), pa.array(lines, pa.string())], ["node", "line"])


def near_matrix(lines: list[str], threshold: float = THRESHOLD, cells: int = 4 << 20) -> np.ndarray:
    """lines x lines: whether the Jaccard similarity of the shingle sets is at least the threshold."""
    h, line = shingle_hashes(lines)
    order = np.lexsort((line, h))
    h, line = h[order], line[order]
    fresh = np.ones(len(h), bool)
    fresh[1:] = (h[1:] != h[:-1]) | (line[1:] != line[:-1])
    h, line = h[fresh], line[fresh]
    sizes = np.bincount(line, minlength=len(lines))
    starts = np.flatnonzero(np.append(True, h[1:] != h[:-1]))
    counts = np.diff(np.append(starts, len(h)))
    column = np.repeat(np.cumsum(counts > 1) - 1, counts)
    shared = np.repeat(counts > 1, counts)  # a shingle of one line is in no intersection
    line, column = line[shared], column[shared]
    both = np.zeros((len(lines), len(lines)), np.float32)
    step = max(1, cells // len(lines))
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, step):
        low, high = np.searchsorted(column, (at, at + step))
        part = np.zeros((len(lines), min(step, int(column[-1]) + 1 - at)), np.float32)
        part[line[low:high], column[low:high] - at] = 1
        both += part @ part.T
    return both >= threshold * (sizes[:, None] + sizes[None, :] - both) - 1e-6


def near_sets(lines: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """The same from sets, which is faster for a few lines."""
    sets = [{x[i : i + SHINGLE] for i in range(max(1, len(x) - SHINGLE + 1))} for x in lines]
    near = np.eye(len(lines), dtype=bool)
    for i, p in enumerate(sets):
        for j, q in enumerate(sets[:i]):
            if min(len(p), len(q)) >= threshold * max(len(p), len(q)) - 1e-6:
                both = len(p & q)
                near[i, j] = near[j, i] = both >= threshold * (len(p) + len(q) - both) - 1e-6
    return near


def join_bucket(lines: list[str], threshold: float = THRESHOLD) -> np.ndarray:
    """For each line the first one of its component."""
    near = (near_sets if len(lines) < 6 else near_matrix)(lines, threshold)
    root = np.arange(len(lines))
    while True:  # least neighbour, then the neighbour's neighbour
        least = np.minimum(root, np.where(near, root[None, :], len(lines)).min(axis=1))
        least = np.minimum(least, least[least])
        if (least == root).all():
            return root
        root = least


def _join_buckets(threshold: float, batch: pa.RecordBatch):
    for at in range(0, batch.num_rows, 256):
        a: list[int] = []
        b: list[int] = []
        for cell in batch["bucket"].slice(at, 256):
            rows = cell.as_py()
            nodes = [r["node"] for r in rows]
            for i, top in enumerate(join_bucket([r["line"] for r in rows], threshold).tolist()):
                if i != top:
                    a.append(nodes[i])
                    b.append(nodes[top])
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def _near_pairs(threshold: float, batch: pa.RecordBatch):
    keep = [bool(near_sets([p, q], threshold)[0, 1]) for p, q in zip(batch["p"].to_pylist(), batch["q"].to_pylist(), strict=True)]
    yield batch.select(["value", "a", "b"]).filter(pa.array(keep, pa.bool_()))


def _dealt(met: DataFrame, sized: DataFrame, stars: DataFrame | None, small: int) -> DataFrame:
    """(bucket, node) such that every two lines of a value that are to be compared share a bucket of at most ``small``.

    Lines of a large value that are near its first one (``stars``) are joined already: those
    are compared with the rest alone, and the rest with each other.
    """
    few = met.join(sized.filter(F.col("n") <= small).select("value"), "value").select(F.xxhash64("value", F.lit(0), F.lit(0)).alias("bucket"), "node")
    if stars is None:
        return few
    near = stars.select("value", F.col("a").alias("node"), F.lit(0).alias("rest"))
    near = near.union(sized.filter(F.col("n") > small).select("value", F.col("first").alias("node"), F.lit(0).alias("rest")))
    many = met.join(sized.filter(F.col("n") > small).select("value"), "value").join(near, ["value", "node"], "left")
    many = many.select("value", "node", F.coalesce("rest", F.lit(1)).alias("rest"))
    counts = many.groupBy("value").agg(F.sum("rest").alias("n_rest"), F.count_if(F.col("rest") == 0).alias("n_near")).filter("n_rest > 0")
    half = small // 2
    groups = counts.select("value", F.ceil(F.col("n_rest") / half).cast("int").alias("p"), F.ceil(F.col("n_near") / half).cast("int").alias("q"))
    placed = many.join(groups, "value")
    # groups 0..p-1 are of the rest, -1..-q of those near the first
    own = F.when(F.col("rest") == 1, F.pmod(F.xxhash64("node", "value"), F.col("p"))).otherwise(-1 - F.pmod(F.xxhash64("node", "value"), F.col("q"))).cast("int")
    rest = F.sequence(F.lit(0), F.col("p") - 1)
    other = F.when(F.col("rest") == 1, F.concat(rest, F.when(F.col("q") > 0, F.sequence(-F.col("q"), F.lit(-1))).otherwise(F.expr("cast(array() as array<int>)")))).otherwise(rest)
    pairs = placed.withColumn("own", own).withColumn("other", F.explode(other))
    return few.union(pairs.select(F.xxhash64("value", F.least("own", "other"), F.greatest("own", "other")).alias("bucket"), "node"))


def near_lines(docs: DataFrame, threshold: float = THRESHOLD, bands: int = BANDS, rows: int = ROWS, small: int = SMALL) -> DataFrame:
    """(a, b) whose transitive closure is that of the near pairs; nodes are hashes of the trimmed line."""
    text = only(docs, "text")
    met = staged(shared_rows(text, partial(_banded, bands, rows)).distinct())
    lines = arrow_map(text, "node long, line string", _texts)
    known = lines.join(met.select("node").distinct(), "node").groupBy("node").agg(F.min("line").alias("line"))
    sized = met.groupBy("value").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("first")).filter("n > 1")
    large = sized.filter(F.col("n") > small)
    stars = None
    if large.limit(1).count():
        known, sized = staged(known), staged(sized)  # both are read again
        pairs = met.join(sized.filter(F.col("n") > small), "value").filter("node <> first").select("value", F.col("node").alias("a"), F.col("first").alias("b"))
        pairs = pairs.join(known.withColumnsRenamed({"node": "a", "line": "p"}), "a").join(known.withColumnsRenamed({"node": "b", "line": "q"}), "b")
        stars = staged(arrow_map(pairs.select("value", "a", "b", "p", "q"), "value long, a long, b long", partial(_near_pairs, threshold)))
    dealt = _dealt(met, sized, stars, small)
    sets = dealt.groupBy("bucket").agg(F.array_sort(F.collect_set("node")).alias("nodes")).filter(F.size("nodes") > 1).select("nodes").distinct()
    named = sets.select(F.xxhash64("nodes").alias("id"), F.explode("nodes").alias("node"))
    full = named.join(known, "node").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("node", "line"))).alias("bucket"))
    found = arrow_map(full.select("bucket"), "a long, b long", partial(_join_buckets, threshold))
    return found if stars is None else found.union(stars.select("a", "b").distinct())


def _repeats(docs: DataFrame) -> DataFrame:
    """doc_id, row (hash of the text), n_lines and n, how many rows of docs have both."""
    size = F.size(F.split(F.coalesce("text", F.lit("")), "\n", -1)).cast("long")
    rows = only(docs, "doc_id", "text").select("doc_id", text_hash().alias("row"), size.alias("n_lines"))
    return rows.groupBy("doc_id", "row", "n_lines").agg(F.count(F.lit(1)).alias("n"))


def _lines_and_repeated(docs: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """doc_id, row, line_no of every line that is not empty, and of those that another row's or line's stands for."""
    parts = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), lambda x: F.trim(x, F.lit(_ENDS)))
    hashes = F.transform(parts, lambda x: F.when(x != "", F.struct(F.xxhash64(x).alias("node"), F.hash(x).alias("check"))))
    # the outer form: for the other the optimiser infers a filter that splits and hashes a second time
    lines = only(docs, "doc_id", "text").select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("row"), F.posexplode_outer(hashes).alias("line_no", "line"))
    lines = lines.filter("line is not null").select("doc_id", "row", "line_no", "line.node", "line.check")
    found = components(near_lines(docs, threshold))
    found = found.union(found.select(F.col("root").alias("node"), "root").distinct())
    lines = staged(lines)
    # lines that are near none are equal by two hashes, 96 bits in all
    check = F.when(F.col("root").isNull(), F.col("check")).otherwise(0)
    of_class = lines.join(found, "node", "left").select("doc_id", "row", "line_no", F.coalesce("root", "node").alias("class"), check.alias("check"))
    first = of_class.groupBy("class", "check").agg(F.min(F.struct("doc_id", "row", "line_no")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = staged(first.drop("n"))  # a table of its own, so that a frequent class can be split over tasks
    gone = of_class.join(first, ["class", "check"]).filter(~F.struct("doc_id", "row", "line_no").eqNullSafe(F.col("first"))).select("doc_id", "row", "line_no")
    return lines.select("doc_id", "row", "line_no"), gone


def repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, row (hash of the text), line_no of every line that another one stands for; of equal rows, of the first."""
    return _lines_and_repeated(docs, threshold)[1]


def _numbers(lines: DataFrame, name: str) -> DataFrame:
    """The numbers of lines, by _id and _row (hash of the text)."""
    by = lines.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("line_no")).alias(name))
    return by.withColumnsRenamed({"doc_id": "_id", "row": "_row"})


def line_report(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_lines, n_removed and removed (their numbers from 0, comma-joined) of every row."""
    lines, repeated = _lines_and_repeated(docs, threshold)
    rows = staged(_repeats(docs))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row"))
    firsts = rows.select("doc_id", "row", "n_lines").join(_numbers(repeated, "gone"), same, "left").select("doc_id", "n_lines", "gone")
    others = rows.filter("n > 1")
    keys = others.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    every = _numbers(lines.join(keys, same, "left_semi"), "gone")
    others = others.join(every, same, "left").withColumn("_", F.explode(F.sequence(F.lit(2).cast("long"), "n"))).select("doc_id", "n_lines", "gone")
    gone = F.coalesce("gone", F.expr("cast(array() as array<int>)"))
    return firsts.union(others).select("doc_id", "n_lines", F.size(gone).cast("long").alias("n_removed"), F.array_join(gone.cast("array<string>"), ",").alias("removed"))


def without_repeated_lines(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with repeated lines gone from the text; a document left without any line that is not empty goes."""
    lines, repeated = _lines_and_repeated(docs, threshold)
    gone = _numbers(repeated, "_gone")
    several = _repeats(docs).filter("n > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    # a row of empty lines loses none, and its repeats stay
    several = lines.join(several, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left_semi").select("doc_id", "row").distinct()
    several = staged(several)
    docs = without_rows(docs, several.limit(0), several)
    whole = as_struct(docs)  # one column, so that none clashes
    text = F.col("_doc.text")
    joined = whole.join(gone, F.col("_doc.doc_id").eqNullSafe(F.col("_id")) & (text_hash(text) == F.col("_row")), "left")
    kept = F.array_join(F.filter(F.split(text, "\n", -1), lambda x, i: ~F.array_contains("_gone", i)), "\n")
    out = joined.filter(F.col("_gone").isNull() | (F.trim(kept, F.lit(_ENDS + "\n")) != ""))
    return from_struct(out, docs.columns, F.when(F.col("_gone").isNull(), text).otherwise(kept))
