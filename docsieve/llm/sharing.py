"""Which (value, node) rows have a value that another node has too.

Most values of a corpus occur once.  Rows travel as packed arrays, one binary cell per
task chunk and shard, and only rows whose value is shared become Spark rows again.  A
value that a chunk already knows to be shared sends one row to its shard however many
nodes have it there, so a value that a third of all rows have is as cheap as any other.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean

Rows = tuple[np.ndarray, np.ndarray]


def _runs(value: np.ndarray, node: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows by (value, node), where each value begins, and whether it has two nodes."""
    order = np.argsort(value, kind="stable")
    value, node = value[order], node[order]
    again = np.zeros(len(value), bool)
    again[1:] = value[1:] == value[:-1]
    if again.any():  # only rows of repeated values need their nodes in order
        some = again.copy()
        some[:-1] |= again[1:]
        at = np.flatnonzero(some)
        at = at[np.lexsort((node[at], value[at]))]
        node[some] = node[at]
        fresh = ~again
        fresh[1:] |= node[1:] != node[:-1]
        value, node = value[fresh], node[fresh]
    first = np.ones(len(value), bool)
    first[1:] = value[1:] != value[:-1]
    starts = np.flatnonzero(first)
    many = np.diff(np.append(starts, len(value))) > 1
    return value, node, starts, many


def _blob(value: np.ndarray, node: np.ndarray) -> bytes:
    return value.astype("<u8").tobytes() + node.astype("<u8").tobytes()


def shared_rows(df: DataFrame, rows: Callable[[pa.RecordBatch], Iterator[Rows]]) -> DataFrame:
    """(value, node), repeats possible, for the rows that ``rows`` makes of each batch."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shards = 4 * parts

    def send(batches):
        for batch in batches:
            for value, node in rows(batch):
                value, node, starts, many = _runs(value, node)
                if not len(value):
                    continue
                lengths = np.diff(np.append(starts, len(value)))
                known = np.repeat(many, lengths)
                ids, blobs = [], []
                if known.any():
                    ids.append(-1 - int(value[0] % np.uint64(shards)))
                    blobs.append(_blob(value[known], node[known]))
                value, node = value[starts], node[starts]
                shard = (value % np.uint64(shards)).astype(np.int64)
                order = np.argsort(shard, kind="stable")
                cuts = np.searchsorted(shard[order], np.arange(shards + 1))
                for k in range(shards):
                    if cuts[k] < cuts[k + 1]:
                        at = order[cuts[k] : cuts[k + 1]]
                        ids.append(k)
                        blobs.append(_blob(value[at], node[at]))
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(blobs, pa.binary())], ["shard", "rows"])

    def receive(batches):
        held: list[np.ndarray] = []

        def out(value, node):
            for at in range(0, len(value), 100_000):
                a, b = value[at : at + 100_000], node[at : at + 100_000]
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["value", "node"])

        for batch in batches:
            for shard, raw in zip(batch["shard"].to_pylist(), batch["rows"], strict=True):
                both = np.frombuffer(raw.as_py(), dtype="<u8").reshape(2, -1)
                if shard < 0:
                    yield from out(both[0].copy(), both[1].copy())
                else:
                    held.append(both)
        if held:
            both = np.concatenate(held, axis=1)
            held.clear()
            value, node, starts, many = _runs(both[0], both[1])
            keep = np.repeat(many, np.diff(np.append(starts, len(value))))
            yield from out(value[keep], node[keep])

    sent = df.mapInArrow(lean(send), "shard int, rows binary").repartition(parts, "shard")
    return sent.mapInArrow(lean(receive), "value long, node long")
