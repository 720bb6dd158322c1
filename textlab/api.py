"""Entry points shaped like the reference's workflow, composed from the operators.

* ``load_data``      split files -> keep-first dedup on train/validation (raw
                     text) -> cleaned text -> (split, row_id, text, label), plus
                     balanced class weights of the cleaned train split.
* ``load_synthetic`` a raw labelled source -> binarised label, nulls dropped,
                     canonical names, simple cleaning, exact 60/15/25 split.
* ``evaluate``       predictions -> one metric record per run.
* ``load_all_results`` run records on disk -> ranked result table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import clean_text, simple_preprocess
from .operators import corpus as C
from .operators import metrics as M
from .sources import readers as SR


def prepare_corpus(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    """Dedup (raw text, train/validation only) then clean every split."""
    d = C.dedup_keep_first(df, text_col=text_col)
    return d.select("split", "row_id", clean_text(text_col).alias("text"), F.col(label_col).cast("int").alias("label"))


def load_data(spark: SparkSession, train_path: str, val_path: str, test_path: str,
              text_column: str = "text", label_column: str = "label", schema=None, materialize: bool = False):
    """Returns (corpus, class_weights of the train split). ``materialize`` writes
    the cleaned corpus once to the shared checkpoint folder, so every training
    or scoring run reads it instead of re-reading and re-cleaning the files."""
    raw = SR.read_corpus_csv(spark, train_path, val_path, test_path, text_column, label_column, schema)
    corpus = prepare_corpus(raw)
    if materialize:
        from .session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark)
        corpus = corpus.checkpoint(eager=True)
    weights = C.class_weights(corpus.where(F.col("split") == "train"), "label", "balanced")
    return corpus, weights


def load_synthetic(df: DataFrame, text_col: str, label_col: str, positive: str,
                   seed: int = 42, order_col: str = "row_id") -> DataFrame:
    """Binarised label (value == positive), nulls dropped, simple cleaning,
    exact 25% test then 20% of the rest validation."""
    x = df.select(F.col(order_col).alias("row_id"), F.col(text_col).alias("text"),
                  C.binarize_label(label_col, positive).alias("label"))
    x = C.drop_null_rows(x, ["text", "label"])
    x = x.withColumn("text", simple_preprocess(F.col("text").cast("string"))).withColumn("label", F.col("label").cast("int"))
    return C.random_split(x, 0.25, 0.20, seed)


def evaluate(preds: DataFrame, keys: Sequence[str] = ("dataset", "experiment"),
             label_names: Sequence[str] | None = None) -> DataFrame:
    return M.evaluate_runs(preds, keys, label_names)


def load_all_results(spark: SparkSession, pattern: str, class_names: Sequence[str] | None = None) -> DataFrame:
    return SR.scan_result_records(spark, pattern, class_names)
