"""Connected components of an edge table, without collecting nodes or edges.

Per-partition union-find first shrinks every partition to a forest.  Then large-star
and small-star rounds (Kiveris et al., "Connected Components in MapReduce and Beyond",
2014) move every node below the least node of its component.  Each half is a minimum
per node (combined before the shuffle) and an equi-join, which adaptive execution can
split where one node has most of the edges.  Every round is a written table.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, lean, staged


def _forest(batches):
    """Union-find over one partition's edges; yields (hi, lo = root) of what it has seen."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := parent.get(top, top)) != top:
            top = up
        while (up := parent.get(x, x)) != top:
            parent[x], x = top, up
        return top

    def flush():
        rows = [(x, root(x)) for x in parent]
        rows = [r for r in rows if r[0] != r[1]]
        parent.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["hi", "lo"]
        )

    for batch in batches:
        for a, b in zip(batch["hi"].to_pylist(), batch["lo"].to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                parent[max(a, b)] = min(a, b)
                parent.setdefault(min(a, b), min(a, b))
        if len(parent) > 500_000:  # bounded memory: hand on what is known and begin anew
            yield flush()
    yield flush()


def _is_star(edges: DataFrame) -> bool:
    """Whether every node hangs once, directly below a node that hangs nowhere."""
    twice = edges.groupBy("hi").count().filter("count > 1").select(F.col("hi"))
    below = edges.select("lo").distinct().join(edges.select(F.col("hi").alias("lo")), "lo", "left_semi")
    return twice.union(below).limit(1).count() == 0


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) for every node of an edge with two different ends; root is the least node.

    Nodes are longs.  Nulls and loops are no edges.  An empty table gives an empty table.
    """
    ends = edges.select(F.greatest(a, b).alias("hi"), F.least(a, b).alias("lo")).filter("hi <> lo")
    now = staged(ends.mapInArrow(lean(_forest), "hi long, lo long").distinct())
    while not _is_star(now):
        both = now.union(now.select(F.col("lo"), F.col("hi")))
        least = both.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m")).select("node", F.least("node", "m").alias("m"))
        large = (
            now.join(least, F.col("lo") == F.col("node")).select(F.col("hi"), F.col("m").alias("lo")).filter("hi <> lo").distinct()
        )
        large = staged(large)
        below = large.groupBy(F.col("hi").alias("node")).agg(F.min("lo").alias("m"))
        small = (
            large.join(below, F.col("hi") == F.col("node"))
            .select(F.inline(F.array(F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("hi"), F.col("m").alias("lo")))))
            .filter("hi <> lo")
        )
        after = staged(small.distinct().mapInArrow(lean(_forest), "hi long, lo long").distinct())
        drop_staged(now)
        drop_staged(large)
        now = after
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root"))
