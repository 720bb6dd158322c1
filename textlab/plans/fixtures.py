"""Inputs of the registered queries, derived by Spark from the driver tables.

* labelled corpus: ``documents`` inner join ``labels`` on ``doc_id``;
  ``row_id = doc_id``, ``dataset = lang``, ``label = toxic``, split by id.
* binary predictions: three deterministic scorers over the labelled corpus
  (one long table keyed by dataset, experiment).
* multiclass predictions: softmax of the first ten embedding entries
  against ``embeddings.label``.

Every frame grows with the tables it reads. The same derivations are spelled
in SQL in ``oracle.py``.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import argmax_label, binary_probs, softmax
from ..operators.corpus import join_text_labels

KEYS = ["dataset", "experiment"]

# The deterministic scorers P(class 1) of the binary runs.
# e1 and e2 are uninformative with many ties, e3 leans on the label.
SCORERS = {
    "e1": "CAST((n_chars * 7919 + row_id * 31) % 50 AS DOUBLE) / 50",
    "e2": "CAST((n_chars * 104729 + row_id * 7) % 97 AS DOUBLE) / 97",
    "e3": "CASE WHEN label = 1 THEN 0.35 + CAST((row_id * 13) % 60 AS DOUBLE) / 100 "
          "ELSE CAST((row_id * 17) % 70 AS DOUBLE) / 100 END",
}
SPLIT_RULE = "CASE row_id % 4 WHEN 0 THEN 'test' WHEN 1 THEN 'validation' ELSE 'train' END"
N_MULTI = 10


# Tables whose rows carry whole texts (CPU-heavy per row).
TEXT_TABLES = {"documents", "pages", "conversations", "benchmark"}


def spread(df: DataFrame) -> DataFrame:
    """A scan with fewer splits than cores (one large row group) is spread
    round-robin before CPU-heavy text work; at cluster scale the scan already
    has far more splits than cores and this is a no-op."""
    try:
        cores = df.sparkSession.sparkContext.defaultParallelism
        n = df.rdd.getNumPartitions()
    except Exception:  # no JVM context (e.g. a remote session): leave the scan as is
        return df
    return df.repartition(cores) if n < cores else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    df = spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
    return spread(df) if name in TEXT_TABLES else df


def labelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """row_id, dataset, split, text, label, n_chars, source."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels")
    j = join_text_labels(docs, labels, key="doc_id")
    return j.select(
        F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset"),
        F.expr(SPLIT_RULE.replace("row_id", "doc_id")).alias("split"),
        "text", F.col("toxic").cast("int").alias("label"), "n_chars", "source",
    )


def unlabelled_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("doc_id").alias("row_id"), F.col("lang").alias("dataset"),
                       F.expr(SPLIT_RULE.replace("row_id", "doc_id")).alias("split"), "text", "n_chars", "source")


# Symbols that the posts below carry, by id: one code point, skin tone, flag, keycap, variation
# selector, joined figures, a lone flag letter, none.
SYMBOLS = ["\U0001F600", "\U0001F44D\U0001F3FD", "\U0001F1E7\U0001F1F7", "1\uFE0F\u20E3", "\u2600\uFE0F",
           "\U0001F469\U0001F3FE\u200D\U0001F4BB", "\U0001F1E7", ":)"]

# Tokens of the social grammar that the posts carry, by id.
MARKS = [":-)", "U.S.A.", "f**k", "<3", "12/05/2021", "+55(11)99999-1234", "^_^", "50%", "R$3,50", "1,000.5"]

FIRST_TWO = "([A-Za-z]+)[^A-Za-z]*([A-Za-z]*)"


def posts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as a social-media post (row_id, text): its text, then a symbol, an address, a name, an
    e-mail, a time, a price, a grammar token and a compound tag made of its own id, language, source and first two words."""
    word = lambda i: F.regexp_extract("text", FIRST_TWO, i)
    symbol = F.get(F.array(*[F.lit(s) for s in SYMBOLS]), (F.col("doc_id") % len(SYMBOLS)).cast("int"))
    extra = F.concat(F.lit(" &amp; "), symbol, F.lit(" http://"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(" @"), "lang",
                     F.lit(" me"), F.lit("@ex.com at "), (F.col("doc_id") % 24).cast("string"), F.lit(":"),
                     F.lpad((F.col("doc_id") % 60).cast("string"), 2, "0"), F.lit(" for $"), F.col("doc_id").cast("string"), F.lit(".99 "),
                     F.get(F.array(*[F.lit(m) for m in MARKS]), (F.col("doc_id") % len(MARKS)).cast("int")), F.lit(" #"), word(1), word(2), F.lit(" #\u00d3dio!"))
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("row_id"), F.concat("text", extra).alias("text"))


def binary_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """dataset, experiment, row_id, label, pred, probs (one row per run and document)."""
    c = labelled_corpus(spark, sf_dir)
    runs = F.array(*[F.struct(F.lit(name).alias("experiment"), F.expr(expr).cast("double").alias("p"))
                     for name, expr in SCORERS.items()])
    x = c.select("dataset", "row_id", "label", F.explode(runs).alias("r"))
    return x.select("dataset", F.col("r.experiment").alias("experiment"), "row_id", "label",
                    binary_probs(F.col("r.p")).alias("probs")) \
        .withColumn("pred", argmax_label("probs"))


def multiclass_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    logits = F.slice(F.col("embedding"), 1, N_MULTI)
    return e.select(F.lit("emb").alias("dataset"), F.lit("slice10").alias("experiment"),
                    F.col("vec_id").alias("row_id"), F.col("label").cast("int").alias("label"),
                    F.transform(logits, lambda x: x.cast("double")).alias("logits")) \
        .withColumn("probs", softmax("logits")).withColumn("pred", argmax_label("probs"))


def epoch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run = user_id, epoch = 1.. by (ts, event_id), value = events.value (nulls dropped)."""
    from ..operators.rank import global_row_number
    ev = table(spark, sf_dir, "events").where(F.col("value").isNotNull())
    ev = ev.select(F.col("user_id").alias("run"), "ts", "event_id", "value",
                   F.unix_micros(F.col("ts").cast("timestamp")).alias("_tsu"))
    r = global_row_number(ev, "_tsu", [F.col("ts"), F.col("event_id")], group_cols=["run"], out="epoch")
    return r.select("run", "epoch", "value")
