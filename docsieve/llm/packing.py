"""Best-fit packing of tokenised documents after Martello-Toth dominance reduction (operator 9).

Which pieces share a sequence depends on their lengths alone, and there are at most
``capacity`` lengths.  So the instance is the histogram of lengths, exact at any number of
documents.  On it, whole classes of equal items are treated at once:

* the reduction (Martello and Toth, "Lower bounds and reduction procedures for the bin
  packing problem", 1990) goes through items from the longest down and fixes a sequence
  whenever a set of one or two items dominates every other that contains the item;
* best-fit decreasing packs what is left, and what room the fixed sequences have.

The result is a list of runs: items of one length, ranked so many to so many, go to so
many consecutive sequences at one offset.  Every piece finds its run by its rank among the
pieces of its length, which is counted in hashed buckets, so a frequent length is spread.

Defined results: null and empty texts are the end token alone; an added token of the
vocabulary in a text is that one token; equal texts and repeated
rows are packed once for each row; a text is never cut unless it is longer than the
capacity; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_left, insort
from functools import lru_cache, partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import arrow_map, only, staged, text_chunks

CAPACITY = 2048
END = 0


@lru_cache(maxsize=2)
def _encoder(path: str):
    """The tokenizer of a rank file: the same vocabulary, added tokens, pattern and ids as the JSON beside it, some five times as fast."""
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    with open(path.removesuffix(".tiktoken") + ".json", encoding="utf-8") as f:
        added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=added)


def _pieces(path: str, capacity: int, keep_ids: bool, batch: pa.RecordBatch):
    encode = partial(_encoder(path).encode, allowed_special="all")
    for chunk in text_chunks(batch):
        rows: list[tuple] = []
        for doc_id, text in zip(chunk["doc_id"].to_pylist(), chunk["text"].to_pylist(), strict=True):
            ids = np.array([*encode(text or ""), END], dtype="<u4")
            # the first piece takes the remainder, so that all others are full
            cuts = [0, *range(len(ids) % capacity or capacity, len(ids) + 1, capacity)]
            for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                raw = ids[a:b].tobytes()
                rows.append((doc_id, i, a, b - a, zlib.crc32(raw), raw if keep_ids else None))
        columns = list(zip(*rows, strict=True))
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: 6 if keep_ids else 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(columns, kinds, names, strict=False)], names)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """Every document's tokens and end token, in pieces of at most ``capacity``; ids are little-endian uint32."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return arrow_map(only(docs, "doc_id", "text"), schema, partial(_pieces, tokenizer, capacity, keep_ids))


class Run(NamedTuple):
    """Items of ``length`` ranked rank..rank + count - 1: ``each`` a sequence from ``sequence`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    sequence: int
    each: int
    offset: int


def solve(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """The runs for so many items of each length, and the number of sequences."""
    left = {k: v for k, v in counts.items() if v > 0}
    if any(not 0 < k <= capacity for k in left):
        raise ValueError(f"lengths must be 1 to {capacity}")
    lengths = sorted(left)  # those with items left
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    open_: dict[int, list[tuple[int, int]]] = {}  # by room left: (first sequence, how many)
    rooms: list[int] = []
    total = 0

    def take(length: int, count: int, sequence: int, each: int, offset: int) -> None:
        runs.append(Run(length, used[length], count, sequence, each, offset))
        used[length] += count
        left[length] -= count
        if not left[length]:
            del lengths[bisect_left(lengths, length)]

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in open_:
                open_[room] = []
                insort(rooms, room)
            open_[room].append((sequence, count))

    def smallest_two(without: int) -> int:
        """The least sum of two items when one of ``without`` is in use."""
        got: list[int] = []
        for k in lengths[:3]:
            got += [k] * min(2, left[k] - (k == without))
        return got[0] + got[1] if len(got) > 1 else capacity + 1

    for length in sorted(left, reverse=True):
        while left[length]:
            room = capacity - length
            at = bisect_left(lengths, room + 1) - 1
            if at >= 0 and lengths[at] == length and left[length] < 2:
                at -= 1
            mate = lengths[at] if at >= 0 else 0
            if mate and mate < room and smallest_two(length) <= room:
                break  # two more items fit, and no single one fills the room: not decided here
            if not mate:
                n = left[length]
                take(length, n, total, 1, 0)
            elif mate == length:
                n = left[length] // 2
                take(length, 2 * n, total, 2, 0)
            else:
                n = min(left[length], left[mate])
                take(length, n, total, 1, 0)
                take(mate, n, total, 1, length)
            leave(room - mate, total, n)
            total += n

    for length in sorted(left, reverse=True):
        while left[length]:
            at = bisect_left(rooms, length)
            if at == len(rooms):
                leave(capacity, total, -(-left[length] // (capacity // length)))
                total += -(-left[length] // (capacity // length))
                continue
            room = rooms[at]
            first, many = open_[room].pop()
            if not open_[room]:
                del open_[room], rooms[at]
            each = min(room // length, left[length])
            n = min(many, left[length] // each)
            take(length, n * each, first, each, capacity - room)
            leave(room - each * length, first, n)
            leave(room, first + n, many - n)
    return runs, total


def _place(table: np.ndarray, batch: pa.RecordBatch) -> pa.RecordBatch:
    length, rank = (batch[c].to_numpy(zero_copy_only=False) for c in ("length", "rank"))
    key = (table[:, 0].astype(np.int64) << 44) | table[:, 1]
    run = table[np.searchsorted(key, (length << 44) | rank, side="right") - 1]
    nth = rank - run[:, 1]
    kept = [c for c in batch.schema.names if c != "rank"]
    return pa.RecordBatch.from_arrays(
        [*(batch[c] for c in kept), pa.array(run[:, 3] + nth // run[:, 4]), pa.array(run[:, 5] + nth % run[:, 4] * length)],
        [*kept, "sequence_id", "offset"],
    )


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """cut (doc_id, piece, length and more) with sequence_id and offset.

    The driver gets one count a length.
    """
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}
    runs, _ = solve(counts, capacity)
    table = np.array(sorted(runs), dtype=np.int64).reshape(-1, len(Run._fields))
    buckets = max(64, 1 << (sum(counts.values()) // 4096).bit_length())
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int"))
    before = (
        dealt.groupBy("length", "bucket").count()
        .withColumn("before", F.sum("count").over(W.partitionBy("length").orderBy("bucket")) - F.col("count"))
        .drop("count")
    )
    ranked = dealt.join(before, ["length", "bucket"]).withColumn(
        "rank", F.col("before") + F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")) - 1
    ).select(*cut.columns, "rank")
    kinds = ", ".join(f"{n} {k}" for n, k in cut.dtypes)
    return arrow_map(ranked, f"{kinds}, sequence_id long, offset long", partial(_place, table))


def packed(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of docs."""
    return pack(staged(pieces(docs, tokenizer, capacity)), capacity)
