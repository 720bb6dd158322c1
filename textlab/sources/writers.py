"""Writers: split files, metric records, submissions, prediction and result tables."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .readers import CSV_OPTIONS

# Record keys left out of the metric JSON (row-level data).
BULKY_KEYS = ["predictions", "true_labels", "probabilities"]


def _csv_writer(df: DataFrame, sep: str = ","):
    return df.write.mode("overwrite").options(**CSV_OPTIONS).option("sep", sep)


def write_split_csv(df: DataFrame, path: str, sep: str = ",", partition_by: str | None = None) -> None:
    """Corpus to delimited text with header (one folder, or one per split)."""
    w = _csv_writer(df, sep)
    if partition_by:
        w = w.partitionBy(partition_by)
    w.csv(path)


def write_metric_json(records: DataFrame, path: str, partition_by=("experiment",)) -> None:
    """Metric records without the bulky row-level keys, one folder per run."""
    slim = records.drop(*[c for c in BULKY_KEYS if c in records.columns])
    slim.repartition(*partition_by).write.mode("overwrite").partitionBy(*partition_by).json(path)


def write_submission_jsonl(df: DataFrame, path: str, index_col: str = "index", pred_col: str = "prediction") -> None:
    """``{"index", "prediction"}`` lines in index order (range-partitioned sort)."""
    out = df.select(F.col(index_col).alias("index"), F.col(pred_col).alias("prediction")).orderBy("index")
    out.write.mode("overwrite").json(path)


def write_prediction_csv(preds: DataFrame, metrics_row: DataFrame, path: str) -> None:
    """``True,Prediction`` table and a one-row metric table whose header matches its values."""
    _csv_writer(preds.select(F.col("label").alias("True"), F.col("pred").alias("Prediction"))).csv(
        os.path.join(path, "predictions"))
    _csv_writer(metrics_row.coalesce(1)).csv(os.path.join(path, "metrics"))


def write_result_tables(results: DataFrame, path: str, summary: DataFrame, detailed: DataFrame) -> None:
    """all_results (raw doubles), summary_results and detailed_results (4 decimals)."""
    _csv_writer(results).csv(os.path.join(path, "all_results"))
    _csv_writer(summary).csv(os.path.join(path, "summary_results"))
    _csv_writer(detailed).csv(os.path.join(path, "detailed_results"))
