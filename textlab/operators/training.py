"""Epoch-metric tables: best checkpoint and early stopping, per run.

Input: ``run, epoch (1..n consecutive), value`` (one evaluation per epoch).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rank import running_max


def best_checkpoint(epochs: DataFrame, run_col: str = "run", metric_col: str = "value",
                    greater_is_better: bool = True) -> DataFrame:
    """Per run the epoch with the best metric; first epoch on ties; nulls skipped.
    A plain aggregate (partial aggregation per task), so a huge run is no hot spot."""
    v = F.col(metric_col) if greater_is_better else -F.col(metric_col)
    key = F.struct(v.alias("v"), (-F.col("epoch")).alias("e"))
    return (epochs.where(F.col(metric_col).isNotNull()).groupBy(run_col)
            .agg(F.max_by("epoch", key).alias("best_epoch"), F.max_by(metric_col, key).alias("best_value"),
                 F.count(F.lit(1)).alias("epochs")))


def early_stop_epoch(epochs: DataFrame, run_col: str = "run", metric_col: str = "value",
                     patience: int = 5, greater_is_better: bool = True) -> DataFrame:
    """Per run the first epoch after ``patience`` successive evaluations without a
    new best (strict improvement); null when training would run to the end.

    Improvements are strict, so the last improving epoch up to epoch e is where
    the running maximum of (value, -epoch) was first reached: one running max
    pass. A null value counts as an improvement only while no value has been
    seen, hence the (-inf, +epoch) key for nulls."""
    sign = 1.0 if greater_is_better else -1.0
    v = F.col(metric_col) * sign
    key = (F.when(v.isNull(), F.struct(F.lit(float("-inf")).alias("v"), F.col("epoch").cast("double").alias("e")))
           .otherwise(F.struct(v.alias("v"), (-F.col("epoch")).cast("double").alias("e"))))
    best = running_max(epochs.select(run_col, "epoch", key.alias("_best")), [run_col], "epoch", ["_best"])
    stale = best.withColumn("_stale", F.col("epoch") - F.abs(F.col("runmax__best.e")).cast("long"))
    return stale.groupBy(run_col).agg(
        F.min(F.when(F.col("_stale") >= patience, F.col("epoch"))).alias("stop_epoch"),
        F.count(F.lit(1)).alias("epochs"))
