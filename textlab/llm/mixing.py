"""Mixing sources to target weights by a multivariate-hypergeometric splitting tree.

Targets: sources share ``budget`` times all sizes by weight, no source above ``cap``
times its own size; the excess goes to the others by weight (water filling, found
in closed form from one sort of the sources).

Blocks: a source's documents, in the order of a hash of their ids, fall into blocks
by equal hash ranges - a permuted, disjoint cut that needs no sort. A source with
target ``f`` times its size plus a rest takes all its blocks ``f`` times and then
blocks in order up to the rest; the last of them is cut inside, document by document,
by a running sum within that block alone.

Splitting tree: the taken blocks of all sources are only counted at first. The root
holds every source's quota; each node halves what it holds by drawing its left
half without replacement (so the counts of the halves are multivariate
hypergeometric), down to one node per output shard. Each shard then gets its quota of
every source as the next blocks of that source's order, and shuffles them locally.
What the mix takes of a document is counted over the shards.

Only DataFrame functions run, and the tree works on at most ``BLOCKS`` x ``cap`` rows
plus a few per source, whatever the corpus holds. Seeds are fixed: reruns agree.

Defined results: null and empty texts have size 0 and are never taken in part (taken
0); a null source is a source, last in order; an empty table gives an empty result;
repeated rows share a place in the order (at a cut the first ones go in); documents without an id are ordered by a hash of their
size; further columns are ignored (``mix`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import n_words, saved, text_or_empty

# Weights of the sources in code point order, and the budget and cap.
WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2

BLOCKS = 8192   # over all sources, by size; every source has at least one
SHARDS = 8      # a power of two
SEED = 20


def unit(*cols: Column) -> Column:
    """A uniform number in [0, 1) from a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(SEED), *cols), 11) / float(1 << 53)


def documents(df: DataFrame, id_col: str, text_col: str, source_col: str, row_col: str | None = None) -> DataFrame:
    """row (a number of its own for every row), doc_id, source, size, place (in its source's permutation, in [0, 1))."""
    size = n_words(text_or_empty(text_col))
    key = F.coalesce(F.col(id_col).cast("string"), F.concat(F.lit("size "), size.cast("string")))
    row = F.col(row_col) if row_col else F.monotonically_increasing_id()
    return df.select(row.alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), size.alias("size"),
                     unit(F.lit("place"), key).alias("place"))


def targets(docs: DataFrame, weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP) -> DataFrame:
    """source, source_size, weight, target: one row per source.

    Water level: with sources sorted by cap per weight, the first ``k`` are full and the
    rest share what is left by weight. The level is the share at the first source whose
    cap is above it, which is the greatest such share."""
    sized = saved(docs.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    in_order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    dealt = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(in_order) - 1) % len(weights) + 1)
    full = F.col("source_size") * cap
    rising = Window.orderBy(F.col("ratio"), F.col("source").asc_nulls_last())
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (sized.withColumn("weight", dealt.cast("double")).withColumn("ratio", full / F.col("weight"))
             .withColumn("total", budget * F.sum("source_size").over(everything))
             .withColumn("filled", F.coalesce(F.sum(full).over(before), F.lit(0)))
             .withColumn("open", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
             .withColumn("share", (F.col("total") - F.col("filled")) / F.col("open"))
             .withColumn("level", F.max(F.when(F.col("ratio") >= F.col("share"), F.col("share"))).over(everything)))
    return level.select("source", "source_size", "weight",
                        F.least(full.cast("double"), F.coalesce(F.col("level") * F.col("weight"), full.cast("double"))).alias("target"))


def source_key(c: str = "source") -> Column:
    """Join key that keeps a null source apart from every string."""
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("null"))


def planned(sources: DataFrame, blocks: int = BLOCKS) -> DataFrame:
    """Adds whole (full passes), rest (words of the last pass) and n_blocks to each source."""
    everything = Window.partitionBy()
    size = F.col("source_size")
    return (sources.withColumn("whole", F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("int"))
            .withColumn("rest", F.col("target") - F.col("whole") * size)
            .withColumn("n_blocks", F.greatest(F.lit(1), F.round(
                F.try_divide(size * blocks, F.sum(size).over(everything))).cast("int"))).withColumn("key", source_key()))


def taken_blocks(docs: DataFrame, sources: DataFrame) -> DataFrame:
    """key, block, words before it, its words, for every block that holds words."""
    of_block = docs.withColumn("key", source_key()).join(sources.select("key", "n_blocks"), "key") \
        .groupBy("key", F.floor(F.col("place") * F.col("n_blocks")).cast("int").alias("block")).agg(F.sum("size").alias("words"))
    before = Window.partitionBy("key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return of_block.withColumn("before", F.coalesce(F.sum("words").over(before), F.lit(0)))


def copies(docs: DataFrame, sources: DataFrame, blocks: DataFrame) -> DataFrame:
    """Adds copies, the number of times the mix takes each document."""
    cut = (blocks.join(sources.select("key", "rest"), "key")
           .where((F.col("before") <= F.col("rest")) & (F.col("rest") < F.col("before") + F.col("words"))))
    cut = cut.select("key", F.col("block").alias("cut_block"), F.col("before").alias("cut_before"))
    plan = saved(sources.select("key", "source_size", "target", "whole", "rest", "n_blocks").join(cut, "key", "left"), "mix-plan")
    rows = docs.withColumn("key", source_key()).join(plan, "key").withColumn("block", F.floor(F.col("place") * F.col("n_blocks")).cast("int"))
    # the documents of the cut block alone, in order; one that fits by half is taken
    inside = Window.partitionBy("key").orderBy("place", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)
    edge = rows.where(F.col("block") == F.col("cut_block")).withColumn(
        "last", (F.col("cut_before") + F.coalesce(F.sum("size").over(inside), F.lit(0)) + F.col("size") / 2.0 <= F.col("rest")).cast("int"))
    others = rows.where(F.col("cut_block").isNull() | (F.col("block") != F.col("cut_block"))).withColumn(
        "last", (F.col("block") < F.col("cut_block")).cast("int"))
    both = others.unionByName(edge).withColumn("last", F.coalesce("last", F.lit(0)))
    return both.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + F.col("last")).otherwise(0))


def shards_of(sources: DataFrame, blocks: DataFrame, shards: int = SHARDS) -> DataFrame:
    """key, turn (the turn-th block a source gives, over all its passes), shard: the splitting tree."""
    kept = blocks.join(sources.select("key", "whole", "rest"), "key").where("words > 0")
    passes = F.col("whole") + (F.col("before") < F.col("rest")).cast("int")
    quota = kept.groupBy("key").agg(F.sum(passes).alias("quota"))
    balls = quota.where("quota > 0").select("key", F.explode(F.sequence(F.lit(1), F.col("quota"))).alias("ball")).withColumn("node", F.lit(0))
    nodes = 1
    while nodes < shards:  # each node draws half of what it holds, without replacement
        node = Window.partitionBy("node")
        drawn = F.row_number().over(node.orderBy(F.xxhash64(F.lit(SEED), F.lit(nodes), F.col("node"), F.col("key"), F.col("ball")), "key", "ball"))
        half = F.ceil(F.count(F.lit(1)).over(node) / 2)
        balls = balls.withColumn("drawn", drawn).withColumn("half", half) \
            .withColumn("node", F.col("node") * 2 + (F.col("drawn") > F.col("half")).cast("int")).drop("drawn", "half")
        nodes *= 2
    # a shard's quota of a source is the next blocks in that source's order
    given = balls.groupBy("key", F.col("node").alias("shard")).agg(F.count(F.lit(1)).alias("n"))
    upto = Window.partitionBy("key").orderBy("shard")
    return given.withColumn("to", F.sum("n").over(upto)).withColumn("turn", F.explode(F.sequence(F.col("to") - F.col("n") + 1, F.col("to")))) \
        .select("key", "turn", "shard")


class Mix:
    """The stored tables of one mix: documents, sources, blocks and the passes each document is in.

    ``row_col`` names a column that tells all rows of ``df`` apart; without it rows are numbered here."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
                 weights=WEIGHTS, budget: float = BUDGET, cap: float = CAP, row_col: str | None = None):
        self.docs = saved(documents(df, id_col, text_col, source_col, row_col), "mix-documents")
        self.sources = saved(planned(targets(self.docs, weights, budget, cap)), "mix-sources")
        self.blocks = saved(taken_blocks(self.docs, self.sources), "mix-blocks")
        self.rows = saved(copies(self.docs, self.sources, self.blocks), "mix-passes")

    def per_document(self) -> DataFrame:
        """doc_id, source, size, source_size, target, copies (rows of the stream), taken, block."""
        drawn = self.stream().groupBy("row").agg(F.count(F.lit(1)).cast("int").alias("drawn"))
        copies = F.coalesce("drawn", F.lit(0))
        return self.rows.join(drawn, "row", "left").select(
            "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (F.col("size") * copies).cast("long").alias("taken"), "block")

    def stream(self, shards: int = SHARDS) -> DataFrame:
        """The mix itself: row, doc_id, copy, shard, position (a key that shuffles within the shard)."""
        order = Window.partitionBy("key").orderBy("pass", "block")
        kept = self.blocks.where("words > 0").join(self.sources.select("key", "whole", "rest"), "key")
        passes = F.col("whole") + (F.col("before") < F.col("rest")).cast("int")
        turns = (kept.where(passes > 0).select("key", "block", F.explode(F.sequence(F.lit(1), passes)).alias("pass"))
                 .withColumn("turn", F.row_number().over(order)).join(shards_of(self.sources, self.blocks, shards), ["key", "turn"])
                 .select("key", "block", "pass", "shard"))
        rows = self.rows.where("copies > 0").select(
            "row", "doc_id", "key", "block", "place", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("pass"))
        return rows.join(turns, ["key", "block", "pass"]).select(
            "row", "doc_id", F.col("pass").alias("copy"), "shard", F.xxhash64(F.lit(SEED), "shard", "place", "pass").alias("position"))
