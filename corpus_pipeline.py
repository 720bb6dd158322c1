"""Corpus pipeline: documents to packed training sequences in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as
Parquet and reread as the next stage's docs. The first four return the columns of
``documents``; the last returns one row per packed piece. A stage judges every row
its predecessor kept.

Every row is judged by itself: rows that repeat an id, or have none, get their own verdicts.
Filters know a row by its id and two hashes of its text, so no stage writes the texts
a second time to number them.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textlab.llm.common import saved, table
from textlab.llm.line_dedup import line_dedup
from textlab.llm.mixing import Mix
from textlab.llm.packing import pack_documents
from textlab.llm.quality_rules import quality_verdicts
from textlab.llm.simhash import simhash_components

TOKENIZER = "word_bpe_49k.json"
NAME = "__row_name"  # no column of documents


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or the learned decision list rejects go."""
    judged = quality_verdicts(docs.withColumn(NAME, name()), table(spark, sf_dir, "labels"), row_col=NAME)
    rejected = saved(judged.where("NOT kept").select(F.col("row").alias(NAME)).distinct(), "rejected")
    return docs.join(rejected, name() == F.col(NAME), "left_anti")


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are cut out of the texts; n_chars follows."""
    def column(c: str) -> Column:
        old = F.col("row").getField(c)
        if c == "text":
            return F.col("new_text").alias(c)
        if c == "n_chars":
            return F.when(F.col("new_text").isNull(), old).otherwise(F.length("new_text")).cast(docs.schema[c].dataType).alias(c)
        return old.alias(c)
    return line_dedup(docs).select(*[column(c) for c in docs.columns])


def simhash_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays: the one with the smallest id.

    Rows of one id and one text have one name; where such a name stays, the row of the
    smallest hash over all columns does, picked by a partial aggregate."""
    found = simhash_components(docs.withColumn(NAME, name()), row_col=NAME)
    verdicts = saved(found.groupBy(F.col("row").alias(NAME), "kept").agg(F.count(F.lit(1)).alias("n")).where("NOT kept OR n > 1"), "near-copies")
    single = docs.join(verdicts.select(NAME), name() == F.col(NAME), "left_anti")
    twins = docs.join(verdicts.where("kept").select(NAME), name() == F.col(NAME), "left_semi")
    one = twins.groupBy(name().alias(NAME)).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias("doc"))
    return single.unionByName(one.select("doc.*"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, so that sources meet their targets; shard by shard, shuffled."""
    rows = saved(docs.select(F.monotonically_increasing_id().alias("row"), F.struct("*").alias("doc")), "mix-rows")  # numbers that stay
    texts = rows.select("row", *[F.col("doc").getField(c).alias(c) for c in ("doc_id", "text", "source")])
    taken = Mix(texts, row_col="row").stream()
    return rows.join(taken.select("row", "shard", "position"), "row").orderBy("shard", "position").select("doc.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of at most 4096 ids with their sequence and place."""
    return pack_documents(docs, public_tokenizers.path(TOKENIZER))


def name() -> Column:
    """What tells a row apart: its id and two hashes of its text; never null, though its id may be."""
    return F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(1), F.col("text")).alias("k2"))


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup_stage),
    ("simhash_near_dedup", simhash_stage),
    ("mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]

# The stages learn rules, hash with functions DuckDB lacks and run a subword tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
