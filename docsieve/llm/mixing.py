"""Mixing sources to target weights with a hypergeometric splitting tree (operator 2).

DataFrame and SQL functions only.  Documents are hashed into blocks of their source.  A
source's target, a number of words, turns into an exact quota: the blocks of a seeded
permutation, once or twice over, up to the block in which the target falls, which is
taken in part.  A binary tree then splits every source's block quota among the output
shards.  A node's left child gets half of the node's blocks; how many of them come from
each source is one draw from the multivariate hypergeometric distribution, made source
by source from the conditional (univariate) distributions by inversion around the mode.
Each shard takes its quota as the next consecutive, so disjoint, blocks of the source's
permutation, and within a shard documents are ordered by a seeded hash.

What a document is taken for is the sum over the shards that drew its block: a row of the mix
is a document's place in a shard, and ``mixed_documents`` is laid out shard by shard in that
order.  The tree has as many levels as give shards of about ``SHARD_BLOCKS`` blocks.

Only block totals (at most ``MAX_BLOCKS`` a source) and source totals are ranked; documents
are ordered inside their shard alone, so a hot source is spread over its blocks and shards.
What has one entry a source (their targets, a node's quotas) is in one row or task.  The same
seed and rows give the same mix.

Defined results: null text has no words and is taken 0 times; null source is a source of
its own, after all others; every row is in the mix, also where rows share a doc_id or have
none; rows equal in doc_id, source and text are copies of one document, each dealt and taken
by itself, and one row of ``taken_words`` with the words of all copies; ties in hash order
go by doc_id, size, hash of the text and copy;
an empty table gives an empty mix; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, as_struct, from_struct, only, staged, text_hash, word_count

WEIGHTS = (5.0, 2.0, 1.0)
TOTAL_SHARE = 1.5
MOST = 2.0
SEED = 20_260_101
#: Words a block aims at, and how many blocks a source has at least and at most.
BLOCK_WORDS, MIN_BLOCKS, MAX_BLOCKS = 65_536, 256, 1 << 20
#: Blocks that a shard aims at, and the least and most levels of the tree (so 16 to 4096 shards).
SHARD_BLOCKS, LEVELS = 64, (4, 12)
#: Documents of a shard that are laid out together.
STRETCH = 1_024
#: Levels that run in one task; below them every node is a task's own.
TOP_LEVELS = 6


def source_targets(
    sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = TOTAL_SHARE, most: float = MOST
) -> DataFrame:
    """source, source_size, target, one row a source.

    Targets are min(cap, level x weight) with cap = most x source_size; the level is where
    they sum to share x all sizes.  In the order of cap / weight the capped sources come
    first, so running sums give the level without iteration; this is what sharing the
    excess again and again by weight ends in.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    listed = F.array(*[F.lit(float(w)) for w in weights])
    t = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(order) - 1)
        .withColumn("w", F.element_at(listed, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", F.col("source_size") * F.lit(most))
        .withColumn("ratio", F.col("cap") / F.col("w"))
    )
    by = W.orderBy("ratio", "place")
    before = by.rowsBetween(W.unboundedPreceding, -1)
    t = (
        t.withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("w").over(by.rowsBetween(0, W.unboundedFollowing)))
        .withColumn("all", F.sum("source_size").over(W.partitionBy()))
        .withColumn("level", (F.col("all") * F.lit(share) - F.col("capped")) / F.col("open"))
    )
    # the first source that its cap does not bind sets the level
    loose = F.col("ratio") > F.col("level")
    first = F.min_by(F.when(loose, F.col("level")), F.when(loose, F.struct("ratio", "place")))
    t = t.withColumn("level", first.over(W.partitionBy()))
    return t.select("source", "source_size", F.coalesce(F.least("cap", F.col("level") * F.col("w")), "cap").alias("target"))


def _unit(*of: Column | str) -> Column:
    """A seeded number in [0, 1)."""
    return F.pmod(F.xxhash64(F.lit(SEED), *of), F.lit(1 << 52)) / F.lit(float(1 << 52))


def _document(*more: Column | str) -> Column:
    """A seeded hash of a row; without a doc_id, and for copies, it takes the text's hash and the copy's number too."""
    own = F.col("doc_id").isNotNull() & (F.col("copy") == 0)
    return F.when(own, F.xxhash64(F.lit(SEED), "doc_id", *more)).otherwise(F.xxhash64(F.lit(SEED), "doc_id", "row", "copy", *more))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value evaluated once; a repeated Column would be evaluated at every mention."""
    return F.element_at(F.transform(F.array(value), body), 1)


def hypergeometric(u: Column, total: Column, marked: Column, drawn: Column) -> Column:
    """Marked among ``drawn`` of ``total`` with ``marked`` marked, by inversion of u.

    Log weights are summed over all values within 12 deviations (and at least 40) of the
    mean, inside the support; what lies beyond is below 1e-30.
    """
    n, k, d = (c.cast("double") for c in (total, marked, drawn))
    mean = F.when(n > 0, d * k / n).otherwise(0.0)
    spread = F.sqrt(F.greatest(F.when(n > 1, mean * (1 - k / n) * (n - d) / (n - 1)).otherwise(0.0), F.lit(0.0)))
    reach = F.greatest(12 * spread, F.lit(40.0))
    low = F.greatest(F.lit(0), drawn - (total - marked), F.floor(mean - reach)).cast("long")
    high = F.least(marked, drawn, F.ceil(mean + reach)).cast("long")

    def inverse(p: Column) -> Column:
        n, k, d = p["n"], p["k"], p["d"]

        def step(state: Column, x: Column) -> Column:
            before = (x - 1).cast("double")
            ratio = (k - before) * (d - before) / ((before + 1) * (n - k - d + before + 1))
            return F.concat(state, F.array(F.when(x == p["low"], F.lit(0.0)).otherwise(F.element_at(state, -1) + F.log(ratio))))

        # seeded with one value so that -1 always has something to read
        logs = F.aggregate(F.sequence(p["low"], p["high"]), F.array(F.lit(0.0)), step)
        logs = F.slice(logs, F.lit(2), (p["high"] - p["low"] + 1).cast("int"))
        return _let(logs, lambda v: _let(F.array_max(v), lambda top: _let(F.transform(v, lambda x: F.exp(x - top)), chosen)))

    def chosen(weights: Column) -> Column:
        state = "struct<sum:double,n:bigint>"

        def passed(goal: Column) -> Column:
            def step(a: Column, v: Column) -> Column:
                return F.struct((a["sum"] + v).alias("sum"), (a["n"] + (a["sum"] + v <= goal).cast("long")).alias("n")).cast(state)

            return F.aggregate(weights, F.struct(F.lit(0.0).alias("sum"), F.lit(0).cast("long").alias("n")).cast(state), step)["n"]

        return _let(u * F.aggregate(weights, F.lit(0.0), lambda a, v: a + v), passed)

    given = F.struct(n.alias("n"), k.alias("k"), d.alias("d"), low.alias("low"), high.alias("high"))
    return _let(given, lambda p: F.least(p["low"] + inverse(p), p["high"]))


def split_quotas(quotas: DataFrame, levels: int = LEVELS[0]) -> DataFrame:
    """(source, shard, blocks) from (source, blocks): a tree of ``levels`` binary splits.

    A tree level is two steps over (node, source) rows: the running totals inside a node,
    then one conditional draw a source.  The conditional draws of a multivariate
    hypergeometric need the ones before them, so the sources of a node are folded in one
    row; that row has one entry a source.
    """
    tree = quotas.filter("blocks > 0").groupBy().agg(
        F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", "blocks"))).alias("q")
    ).withColumn("node", F.lit(1).cast("long"))
    kind = "struct<rest:bigint,left:bigint,draws:array<bigint>>"
    for level in range(levels):
        if level == TOP_LEVELS:
            tree = tree.repartition("node")
        total = F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x["blocks"])

        def draw(state: Column, x: Column) -> Column:
            def after(got: Column) -> Column:
                return F.struct(
                    (state["rest"] - x["blocks"]).alias("rest"),
                    (state["left"] - got).alias("left"),
                    F.concat(state["draws"], F.array(got)).alias("draws"),
                ).cast(kind)

            return _let(hypergeometric(_unit("node", x["source"]), state["rest"], x["blocks"], state["left"]), after)

        start = F.struct(total.alias("rest"), F.floor((total + 1) / 2).alias("left"), F.expr("cast(array() as array<bigint>)").alias("draws"))
        tree = tree.withColumn("draws", F.aggregate("q", start.cast(kind), draw)["draws"])

        def child(right: bool) -> Column:
            mine = F.transform(
                F.arrays_zip("q", "draws"),
                lambda z: F.struct(
                    z["q"]["last"].alias("last"),
                    z["q"]["source"].alias("source"),
                    ((z["q"]["blocks"] - z["draws"]) if right else z["draws"]).alias("blocks"),
                ),
            )
            return F.struct(mine.alias("q"), (2 * F.col("node") + int(right)).alias("node"))

        tree = tree.select(F.inline(F.array(child(False), child(True))))
    return tree.select((F.col("node") - (1 << levels)).alias("shard"), F.inline("q")).drop("last").filter("blocks > 0")


def block_plan(
    sizes: DataFrame,
    weights: Sequence[float] = WEIGHTS,
    share: float = TOTAL_SHARE,
    most: float = MOST,
    levels: int | None = None,
    block_words: int = BLOCK_WORDS,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """sizes with its block, the targets, and the chosen blocks.

    sizes has doc_id, source, size, row (hash of the text), copy.  The chosen blocks are (source, block, pass, words,
    shard, place): words is how much of the block is taken, all of it but for the last.
    """
    targets = staged(source_targets(sizes, weights, share, most))
    count = F.greatest(F.lit(MIN_BLOCKS), F.least(F.lit(MAX_BLOCKS), F.ceil(F.col("source_size") / block_words)))
    joined = sizes.join(
        targets.select(F.col("source").alias("s"), "source_size", "target"), sizes["source"].eqNullSafe(F.col("s"))
    )
    dealt = joined.withColumn("block", F.pmod(_document(), count).cast("int")).drop("s")
    blocks = dealt.filter("size > 0").groupBy("source", "block").agg(
        F.sum("size").alias("words"), F.first("source_size").alias("source_size"), F.first("target").alias("target")
    )
    passes = blocks.withColumn("pass", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn(
        "h", F.xxhash64(F.lit(SEED), "pass", "source", "block")
    )
    order = W.partitionBy("source", "pass").orderBy("h", "block")
    # the second pass begins where the first, a whole source, ended
    wanted = F.round("target").cast("long") - F.col("pass") * F.col("source_size")
    chosen = (
        passes.withColumn("before", F.sum("words").over(order) - F.col("words"))
        .withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("take", F.least("words", wanted - F.col("before")))
        .filter("take > 0")
    )
    chosen = staged(chosen.select("source", "block", "pass", "words", "take", "rank"))
    firsts = chosen.groupBy("source").agg(
        F.count(F.lit(1)).alias("blocks"), F.sum((F.col("pass") == 0).cast("long")).alias("of_first")
    )
    if levels is None:
        levels = min(max((chosen.count() // SHARD_BLOCKS).bit_length(), LEVELS[0]), LEVELS[1])
    shards = split_quotas(firsts.select("source", "blocks"), levels)
    upto = W.partitionBy("source").orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    slots = shards.withColumn("from", F.coalesce(F.sum("blocks").over(upto), F.lit(0))).select(
        "source", "shard", F.posexplode(F.sequence(F.col("from"), F.col("from") + F.col("blocks") - 1)).alias("place", "slot")
    )
    c = chosen.join(firsts.select(F.col("source").alias("s"), "of_first"), chosen["source"].eqNullSafe(F.col("s"))).drop("s")
    c = c.withColumn("slot", F.col("rank") + F.col("pass") * F.col("of_first"))
    s = slots.withColumnRenamed("source", "s").withColumnRenamed("slot", "t")
    placed = c.join(s, c["source"].eqNullSafe(s["s"]) & (c["slot"] == s["t"]))
    return dealt, targets, placed.select("source", "block", "pass", "words", "take", "shard", "place")


def mix(docs: DataFrame, **how) -> DataFrame:
    """The mix: one row per row of docs and pass that takes words of it.

    doc_id, source, row (hash of the text), copy and copies (its number among equal rows, and how many there
    are), size, source_size, target, pass, taken (the document's first words
    where it is cut), shard and position: the place after the shard's local shuffle, from 0.  Documents that no
    pass takes have one row with pass, shard and position null and taken 0.
    """
    rows = only(docs, "doc_id", "source", "text").select("doc_id", "source", text_hash().alias("row"), word_count(F.col("text")).alias("size"))
    rows = rows.groupBy("doc_id", "source", "row", "size").agg(F.count(F.lit(1)).alias("copies"))
    sizes = staged(rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1))))
    dealt, _, placed = block_plan(sizes, **how)
    p = placed.select(F.col("source").alias("s"), F.col("block").alias("b"), "pass", "words", "take", "shard", "place")
    whole = dealt.join(p.filter("take = words").drop("words", "take", "place"), dealt["source"].eqNullSafe(F.col("s")) & (dealt["block"] == F.col("b")) & (dealt["size"] > 0), "left")
    whole = whole.drop("s", "b").withColumn("taken", F.when(F.col("pass").isNotNull(), F.col("size")).otherwise(0))
    cut = dealt.join(p.filter("take < words").drop("place"), dealt["source"].eqNullSafe(F.col("s")) & (dealt["block"] == F.col("b")) & (dealt["size"] > 0)).drop("s", "b")
    # one cut block a source: running words inside that block only
    inside = W.partitionBy("source", "block", "pass").orderBy(_document("pass"), "doc_id", "size", "row", "copy")
    cut = cut.withColumn("before", F.sum("size").over(inside.rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("size"))
    cut = cut.withColumn("taken", F.least("size", F.col("take") - F.col("before"))).filter("taken > 0")
    names = ["doc_id", "source", "row", "copy", "copies", "size", "source_size", "target", "pass", "taken", "shard"]
    out = whole.select(names).union(cut.select(names))
    key = F.when(F.col("doc_id").isNotNull() & (F.col("copy") == 0), F.xxhash64(F.lit(SEED), "shard", "doc_id", "pass"))
    key = F.coalesce(key, F.xxhash64(F.lit(SEED), "shard", "doc_id", "row", "copy", "pass"))
    # what no shard takes is spread over windows of its own, since its places do not count
    own = F.coalesce(F.col("shard"), -1 - F.pmod(F.xxhash64("doc_id", "row", "copy"), F.lit(4096)))
    order = W.partitionBy(own).orderBy(key, "doc_id", "pass", "row", "copy")
    return out.withColumn("position", F.when(F.col("pass").isNotNull(), F.row_number().over(order) - 1).cast("long"))


def mix_report(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken and places of every row of docs.

    taken is the sum over the row's places in shards: (pass, shard, position, words), by pass.
    """
    place = F.when(F.col("pass").isNotNull(), F.struct("pass", "shard", "position", F.col("taken").alias("words")))
    whole = mix(docs, **how).groupBy("doc_id", "source", "row", "copy").agg(
        F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.array_sort(F.collect_list(place)).alias("places")
    )
    taken = F.aggregate("places", F.lit(0).cast("long"), lambda a, p: a + p["words"])
    return whole.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "places")


def taken_words(docs: DataFrame, **how) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per document, for the words of all its copies."""
    taken = mix(docs, **how).groupBy("doc_id", "source", "row").agg(
        (F.first("size") * F.first("copies")).alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.sum("taken").alias("taken")
    )
    return taken.drop("source", "row")


def _copies_of(rows: DataFrame, several: DataFrame, same: Column) -> DataFrame:
    """The rows that are equal in doc_id, source and text with the places of each.

    Copies are numbered in the order of their other columns; rows equal in all are counted, not ranked.
    """
    keys = ("_doc_id", "_source", "_row")
    alike = rows.join(several.select(*keys).distinct(), same).groupBy(*keys, "_doc").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(W.partitionBy(*keys).orderBy("_doc").rowsBetween(W.unboundedPreceding, W.currentRow))
    each = alike.withColumn("_upto", upto).select(
        F.col("_doc"), F.col("_doc_id").alias("k_id"), F.col("_source").alias("k_source"), F.col("_row").alias("k_row"),
        F.explode(F.sequence(F.col("_upto") - F.col("_n"), F.col("_upto") - 1)).alias("k_copy"),
    )
    mine = F.col("k_id").eqNullSafe(F.col("_doc_id")) & F.col("k_source").eqNullSafe(F.col("_source")) & (F.col("k_row") == F.col("_row"))
    return each.join(several, mine & (F.col("k_copy") == F.col("_copy")))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix as documents: a row for each time one is taken, cut to its first words where the target falls.

    Rows are laid out shard by shard in the order of each shard's shuffle.  Null texts have no
    words and go; rows equal in doc_id, source and text are taken each by itself; other columns
    keep their values, whatever their names; an empty table gives an empty table.
    """
    plan = mix(docs, **how).filter("taken > 0")
    plan = staged(plan.select(*[F.col(c).alias(f"_{c}") for c in ("doc_id", "source", "row", "copy", "copies", "size", "taken", "shard", "position")]))
    text = F.col("_doc.text")
    rows = as_struct(docs).withColumn("_text", text_hash(text))
    same = F.col("_doc.doc_id").eqNullSafe(F.col("_doc_id")) & F.col("_doc.source").eqNullSafe(F.col("_source")) & (F.col("_text") == F.col("_row"))
    names = ("_doc", "_taken", "_size", "_shard", "_position")
    joined = rows.join(plan.filter("_copies = 1"), same).select(*names)
    several = plan.filter("_copies > 1")
    if several.limit(1).count():  # otherwise all texts would be shuffled once more for nothing
        joined = joined.union(_copies_of(rows, several, same).select(*names))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # stretches of a shard, so that no task has to hold a whole one and none is sampled for its range
    stretch = F.floor(F.col("_position") / STRETCH)
    joined = joined.repartition(parts, "_shard", stretch).sortWithinPartitions("_shard", "_position")
    part = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.lit(1), F.col("_taken").cast("int")), " ")
    return from_struct(joined, docs.columns, F.when(F.col("_taken") < F.col("_size"), part).otherwise(text))
