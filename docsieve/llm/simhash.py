"""SimHash near-duplicates by the generalised pigeonhole principle (operator 4).

A fingerprint has 64 bits.  Two fingerprints link when they differ in at most
``distance`` (two) bits.  The 64 positions are grouped into partitions so that correlated
bits sit together, which keeps the other partitions selective.  For thresholds t_i with
sum(t_i) = distance - parts + 1 (-1: the partition is not probed) any linked pair agrees
in some probed partition within t_i bits (Qin et al., "GPH", ICDE 2018).  Each
fingerprint gets its own thresholds by dynamic programming on candidate counts that are
estimated from a count sketch of all fingerprints.

There are three partitions, or two where a table is so large that the values of three would
be shared by too many: then a probe flips bits of one partition instead.  The count sketch
grows with the table, up to 2**20 cells a partition.

Frequent partition values would give candidates with the square of their count.  The
sketch, known to every task, says which values those are; there the fingerprints are not
paired, but meet at keys made of the value and the remaining bits with at most one of
them flipped.  Two fingerprints at the same key differ in at most two bits, and every
linked pair has such a key, so this path is exact too and linear in the fingerprints.

Defined results: null and empty texts have fingerprint zero and link like any other;
equal texts and repeated rows have equal fingerprints, hence one component; a repeated
doc_id gives repeated rows; an empty table gives an empty table; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, first_rows, lean, only, staged, text_chunks, utf8
from .components import components

BITS = 64
SHINGLE = 3
SEED = 42
PARTS = 3
DISTANCE = 2
#: Cells of the count sketch a partition, at least and at most, as powers of two.
CELL_BITS = (16, 20)
#: A partition value with a sketched count above this meets at flipped keys, not in pairs.
FREQUENT = 24
_NEVER = np.float64(1e18)


def fingerprint(data: bytes, shingle: int = SHINGLE, once: bool = False) -> int:
    """A-Z lower-cased; a bit is set if more than half of the shingle hashes have it; ``once``: repeats do not count."""
    words = data.lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], dtype="<u8")
    else:
        digest = xxhash.xxh64_intdigest
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
        hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8", count=len(words) - shingle + 1)
        hashes = np.unique(hashes) if once else hashes
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 65_536):
        part = hashes[at : at + 65_536]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def text_fingerprints(column: pa.Array, shingle: int = SHINGLE, once: bool = False) -> pa.Array:
    """The fingerprint of each text as a signed long."""
    data, offsets = utf8(column)
    raw = data.tobytes()
    out = np.array([fingerprint(raw[a:b], shingle, once) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
    return pa.array(out.view(np.int64))


def _fingerprints(shingle: int, batch: pa.RecordBatch):
    for chunk in text_chunks(batch):
        yield pa.RecordBatch.from_arrays([chunk["doc_id"], text_fingerprints(chunk["text"], shingle)], ["doc_id", "fp"])


def _with_hash(shingle: int, batch: pa.RecordBatch):
    """doc_id, hash of the text as Spark's xxhash64 has it, fingerprint."""
    for chunk in text_chunks(batch):
        data, offsets = utf8(chunk["text"])
        raw = data.tobytes()
        texts = [raw[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        row = np.array([xxhash.xxh64_intdigest(t, 42) for t in texts], np.uint64)
        fp = np.array([fingerprint(t, shingle) for t in texts], np.uint64)
        yield pa.RecordBatch.from_arrays([chunk["doc_id"], pa.array(row.view(np.int64)), pa.array(fp.view(np.int64))], ["doc_id", "row", "fp"])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) for every row."""
    return arrow_map(only(docs, "doc_id", "text"), "doc_id long, fp long", partial(_fingerprints, shingle))


def _together(batches):
    """How often each pair of bits is set together, for one task."""
    total, seen = np.zeros((BITS, BITS), np.int64), 0
    for batch in batches:
        for at in range(0, batch.num_rows, 50_000):
            fp = np.ascontiguousarray(batch["fp"].slice(at, 50_000).to_numpy(zero_copy_only=False))
            bits = np.unpackbits(fp.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            total += (bits.T @ bits).astype(np.int64)
            seen += len(fp)
    yield pa.RecordBatch.from_arrays(
        [pa.array(np.arange(BITS * BITS + 1)), pa.array(np.append(total.ravel(), seen))], ["k", "v"]
    )


def bit_groups(total: np.ndarray, seen: int, parts: int = PARTS) -> list[np.ndarray]:
    """Positions in ``parts`` groups of near-equal size; each grows by its most correlated free bit."""
    mean = np.diag(total) / max(seen, 1)
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    tie = np.abs((total / max(seen, 1) - np.outer(mean, mean)) / np.outer(spread, spread))
    np.fill_diagonal(tie, 0)
    free, groups = list(range(BITS)), []
    for g in range(parts):
        width = BITS // parts + (g < BITS % parts)
        start = max(free, key=lambda x: (tie[x, free].max(), -x))
        group = [start]
        free.remove(start)
        while len(group) < width:
            best = max(free, key=lambda x: (tie[x, group].sum(), -x))
            group.append(best)
            free.remove(best)
        groups.append(np.array(sorted(group)))
    return groups


def _masks(groups: list[np.ndarray]) -> np.ndarray:
    return np.array([sum(1 << int(b) for b in g) for g in groups], np.uint64)


def parts_for(n: int) -> int:
    """How many partitions make probes and candidates of n fingerprints fewest.

    Of three partitions each is probed once, if values are even with n / 2**21 candidates;
    of two, one is probed once and the other at every flipped bit too, with n / 2**32.
    """
    probes, width = BITS // 2 + 2, BITS // PARTS
    return PARTS if PARTS * (1 + n / 2**width) <= probes * (1 + n / 2 ** (BITS // 2)) else 2


def cell_bits(n: int) -> int:
    """About four fingerprints a cell, within the bounds."""
    return min(max(CELL_BITS[0], n.bit_length() - 2), CELL_BITS[1])


def _cell(value: np.ndarray, bits: int) -> np.ndarray:
    return ((value ^ (value >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64)


def _sketch(masks, bits, batches):
    counts = np.zeros((len(masks), 1 << bits), np.int64)
    for batch in batches:
        fp = np.ascontiguousarray(batch["fp"].to_numpy(zero_copy_only=False)).view(np.uint64)
        for i, m in enumerate(masks):
            counts[i] += np.bincount(_cell(fp & m, bits), minlength=1 << bits)
    cells = np.flatnonzero(counts.ravel())
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(counts.ravel()[cells])], ["k", "v"])


def allocate(cost: np.ndarray, distance: int = DISTANCE) -> np.ndarray:
    """Thresholds in -1..1 per row that sum to distance - parts + 1 at the least total cost.

    cost[n, part, t + 1] is what probing that partition with threshold t would cost.
    Dynamic programming over the partitions; the state is the sum so far.
    """
    n, parts, options = cost.shape
    goal, low = distance - parts + 1, -parts
    best = np.full((n, parts + 1, 2 * parts + 1), _NEVER)
    best[:, 0, -low] = 0
    choice = np.zeros((n, parts + 1, 2 * parts + 1), np.int8)
    for i in range(parts):
        for s in range(2 * parts + 1):
            for t in range(-1, options - 1):
                if 0 <= s + t <= 2 * parts:
                    new = best[:, i, s] + cost[:, i, t + 1]
                    better = new < best[:, i + 1, s + t]
                    best[better, i + 1, s + t] = new[better]
                    choice[better, i + 1, s + t] = t
    out, at = np.zeros((n, parts), np.int64), np.full(n, goal - low)
    for i in range(parts, 0, -1):
        out[:, i - 1] = choice[np.arange(n), i, at]
        at = at - out[:, i - 1]
    return out


def _probes(masks, groups, counts, frequent, batch):
    """Rows (kind, part, key, rest, fp): 0 index, 1 probe, 2 meeting key of a frequent value."""
    for at in range(0, batch.num_rows, 8_192):
        fp = np.ascontiguousarray(batch["fp"].slice(at, 8_192).to_numpy(zero_copy_only=False)).view(np.uint64)
        n, parts, bits = len(fp), len(masks), counts.shape[1].bit_length() - 1
        cost, near = np.zeros((n, parts, 3)), []
        for i, m in enumerate(masks):
            value = fp & m
            flips = value[:, None] ^ (np.uint64(1) << groups[i].astype(np.uint64))[None, :]
            near.append((value, flips))
            own, other = counts[i][_cell(value, bits)], counts[i][_cell(flips, bits)]
            price = lambda c: np.where(c > frequent, BITS, 1 + c)
            cost[:, i, 1] = price(own)
            cost[:, i, 2] = price(own) + price(other).sum(axis=1)
        limits = allocate(cost)
        rows: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = []
        for i, m in enumerate(masks):
            value, flips = near[i]
            rest = fp & ~m
            hot = counts[i][_cell(value, bits)] > frequent
            rows.append((0, i, value[~hot], np.zeros((~hot).sum(), np.uint64), fp[~hot]))
            if hot.any():
                others = np.array([b for b in range(BITS) if not int(m) >> b & 1], np.uint64)
                keys = np.concatenate([rest[hot][:, None], rest[hot][:, None] ^ (np.uint64(1) << others)[None, :]], axis=1)
                k = keys.shape[1]
                rows.append((2, i, np.repeat(value[hot], k), keys.ravel(), np.repeat(fp[hot], k)))
            probe = (limits[:, i] >= 0) & ~hot
            rows.append((1, i, value[probe], np.zeros(probe.sum(), np.uint64), fp[probe]))
            if (wide := limits[:, i] >= 1).any():
                w = flips.shape[1]
                keys, own, far = flips[wide].ravel(), np.repeat(fp[wide], w), np.repeat(rest[wide], w)
                hot = counts[i][_cell(keys, bits)] > frequent
                rows.append((1, i, keys[~hot], np.zeros((~hot).sum(), np.uint64), own[~hot]))
                rows.append((2, i, keys[hot], far[hot], own[hot]))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([np.full(len(r[4]), r[0], np.int32) for r in rows])),
                pa.array(np.concatenate([np.full(len(r[4]), r[1], np.int32) for r in rows])),
                *(pa.array(np.concatenate([r[j] for r in rows]).view(np.int64)) for j in (2, 3, 4)),
            ],
            ["kind", "part", "key", "rest", "fp"],
        )


def meetings(distinct: DataFrame, parts: int | None = None, frequent: int = FREQUENT) -> tuple[DataFrame, DataFrame]:
    """Pairs (a, b) and keys (part, key, rest, a) that together have all pairs of fp at most two bits apart, and no others.

    Any two fingerprints at one key are a pair.  The driver gets the 64 x 64 bit counts and the cells of the sketch, never fingerprints.
    """
    total = np.zeros(BITS * BITS + 1, np.int64)
    for r in distinct.mapInArrow(lean(_together), "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect():
        total[r.k] = r.v
    n = int(total[-1])
    parts, bits = parts or parts_for(n), cell_bits(n)
    groups = bit_groups(total[:-1].reshape(BITS, BITS), n, parts)
    masks = _masks(groups)
    counts = np.zeros(parts << bits, np.int64)
    for r in distinct.mapInArrow(lean(partial(_sketch, masks, bits)), "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).toLocalIterator():
        counts[r.k] = r.v
    counts = counts.reshape(parts, 1 << bits)
    # In a table so large that every cell is full, a value counts as frequent relative to the mean.
    frequent = frequent + 2 * n // (1 << bits)
    rows = staged(
        arrow_map(distinct, "kind int, part int, key long, rest long, fp long", partial(_probes, masks, groups, counts, frequent))
    )
    index = rows.filter("kind = 0").select("part", "key", F.col("fp").alias("b"))
    probe = rows.filter("kind = 1").select("part", "key", F.col("fp").alias("a"))
    close = probe.join(index, ["part", "key"]).filter((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE))
    return close.select("a", "b"), rows.filter("kind = 2").select("part", "key", "rest", F.col("fp").alias("a"))


def links(distinct: DataFrame, parts: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(a, b) whose transitive closure is that of all pairs of fp at most two bits apart."""
    close, meet = meetings(distinct, parts, frequent)
    least = meet.groupBy("part", "key", "rest").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b <> c")
    star = meet.join(least, ["part", "key", "rest"]).filter("a <> b")
    return close.union(star.select("a", "b"))


def alike(distinct: DataFrame, parts: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """(value, fp): any two fp at most two bits apart share a value, so that what they stand for can be compared."""
    close, meet = meetings(distinct, parts, frequent)
    ends = close.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = ends.select(F.xxhash64("a", "b").alias("value"), F.explode(F.array("a", "b")).alias("fp"))
    several = meet.groupBy("part", "key", "rest").agg(F.min("a").alias("b"), F.max("a").alias("c")).filter("b <> c")
    keyed = meet.join(several, ["part", "key", "rest"]).select(F.xxhash64("part", "key", "rest").alias("value"), F.col("a").alias("fp"))
    return pairs.union(keyed)


def _grouped(marked: DataFrame, parts: int | None, frequent: int) -> DataFrame:
    """fp, the least doc_id that has it, and root (the least fp of its component)."""
    distinct = staged(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(distinct.select("fp"), parts, frequent))
    return distinct.join(found.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, parts: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id for every row of docs."""
    marked = staged(fingerprints(docs, shingle))
    grouped = _grouped(marked, parts, frequent)
    lowest = grouped.groupBy("root").agg(F.min("least").alias("component_id"))
    of_fp = grouped.join(lowest, "root").select("fp", "component_id")
    return marked.join(of_fp, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, parts: int | None = None, frequent: int = FREQUENT) -> DataFrame:
    """Of every component of docs one row: that with the least (doc_id, hash of the text), null doc_ids last.

    Rows go by doc_id and text, so a row that shares its doc_id with a near copy stays; of rows
    equal in both one stays; other columns keep their values; an empty table gives an empty table.
    """
    marked = staged(arrow_map(only(docs, "doc_id", "text"), "doc_id long, row long, fp long", partial(_with_hash, shingle)))
    rows = marked.join(_grouped(marked, parts, frequent).select("fp", "root"), "fp").groupBy("root", "doc_id", "row").agg(F.count(F.lit(1)).alias("n"))
    return first_rows(docs, rows)
