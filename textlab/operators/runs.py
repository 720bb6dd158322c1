"""Run-level tables: flatten metric records, rank, compare, summarise, report.

A results table has one row per run (``partition`` columns, e.g. dataset, plus
``experiment``) and only a handful of rows per dataset, so windows over it are
cheap; the heavy lifting happened in ``metrics.evaluate_runs``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import title_case

from ..functions.formats import py_format

# Column groups of the result table.
HEAD_METRICS = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "ece"]
CLASS_PREFIXES = ["f1_", "precision_", "recall_", "ap_"]
MINIMIZE = ["ece"]
# Report tables look for this macro-AP column name (the loader writes
# ``macro_avg_precision``, so by default macro-AP stays out of reports).
REPORT_AP_COLUMN = "macro_ap"


def flatten_metric_maps(records: DataFrame, keys: Sequence[str], class_names: Sequence[str]) -> DataFrame:
    """Metric records -> wide result rows with ``f1_<c>``, ``precision_<c>``,
    ``recall_<c>``, ``ap_<c>`` per class name (absent -> null)."""
    maps = {"f1_": "f1_per_class", "precision_": "precision_per_class", "recall_": "recall_per_class",
            "ap_": "avg_precision_per_class"}
    cols = [F.col(k) for k in keys] + [
        F.col("macro_f1"), F.col("accuracy"), F.col("macro_avg_precision"), F.col("roc_auc"),
        F.col("expected_calibration_error").alias("ece")]
    for prefix, m in maps.items():
        cols += [F.element_at(F.col(m), F.lit(c)).alias(f"{prefix}{c}") for c in class_names]
    return records.select(*cols)


def select_by_prefix(df: DataFrame, prefixes: Sequence[str], keep: Sequence[str] = ("experiment",),
                     exclude: Sequence[str] = ("macro_f1",)) -> DataFrame:
    """Plan-time column choice: ``keep`` then, per prefix, the sorted matching columns."""
    cols = list(keep)
    for p in prefixes:
        cols += sorted(c for c in df.columns if c.startswith(p) and c not in exclude and c not in cols)
    return df.select(*cols)


def rank_experiments(results: DataFrame, partition: Sequence[str] = ("dataset",), metric: str = "macro_f1",
                     ascending: bool = False) -> DataFrame:
    """Rank column by ``metric`` (desc by default), experiment name breaks ties."""
    order = F.col(metric).asc_nulls_last() if ascending else F.col(metric).desc_nulls_last()
    w = Window.partitionBy(*partition).orderBy(order, F.col("experiment"))
    return results.withColumn("rank", F.row_number().over(w).cast("long"))


def metric_columns(results: DataFrame) -> list[str]:
    return [c for c in results.columns
            if c in HEAD_METRICS or any(c.startswith(p) for p in CLASS_PREFIXES)]


def long_metrics(results: DataFrame, partition: Sequence[str] = ("dataset",), metrics: Sequence[str] | None = None,
                 with_rank: bool = True) -> DataFrame:
    """Unpivot to (partition, experiment, [rank], metric, value)."""
    metrics = list(metrics or metric_columns(results))
    base = rank_experiments(results, partition) if with_rank else results
    ids = [*partition, "experiment"] + (["rank"] if with_rank else [])
    casted = base.select(*ids, *[F.col(m).cast("double").alias(m) for m in metrics])
    return casted.unpivot(ids, metrics, "metric", "value")


def best_method_per_metric(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    """argmax per metric (argmin for ece) over macro_f1, accuracy, macro AP, ROC-AUC,
    ``f1_*`` and ``ap_*``; nulls skipped; the earliest run in rank order wins ties."""
    metrics = [m for m in ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc"] if m in results.columns]
    metrics += [c for c in results.columns if c.startswith("f1_") or c.startswith("ap_")]
    metrics += [m for m in MINIMIZE if m in results.columns]
    lm = long_metrics(results, partition, metrics).where(F.col("value").isNotNull())
    direction = F.when(F.col("metric").isin(MINIMIZE), F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(*partition, "metric").orderBy(direction, F.col("rank"))
    return (lm.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
            .select(*partition, "metric", "experiment", "value"))


def metric_statistics(results: DataFrame, partition: Sequence[str] = ("dataset",),
                      ap_column: str = REPORT_AP_COLUMN) -> DataFrame:
    """best, worst (with their runs), mean, median, sample std per headline metric."""
    metrics = [m for m in ["macro_f1", "accuracy", ap_column, "roc_auc", "ece"] if m in results.columns]
    lm = long_metrics(results, partition, metrics)
    good = F.when(F.col("metric").isin(MINIMIZE), F.col("value")).otherwise(-F.col("value"))
    key_best = F.struct((-good).alias("g"), (-F.col("rank")).alias("r"))
    key_worst = F.struct(good.alias("g"), (-F.col("rank")).alias("r"))
    nn = F.col("value").isNotNull()
    return lm.groupBy(*partition, "metric").agg(
        F.max_by(F.when(nn, F.col("value")), F.when(nn, key_best)).alias("best"),
        F.max_by(F.when(nn, F.col("experiment")), F.when(nn, key_best)).alias("best_experiment"),
        F.max_by(F.when(nn, F.col("value")), F.when(nn, key_worst)).alias("worst"),
        F.max_by(F.when(nn, F.col("experiment")), F.when(nn, key_worst)).alias("worst_experiment"),
        F.avg("value").alias("mean"), F.median("value").alias("median"), F.stddev_samp("value").alias("std"),
    )


def minmax_scaled_metrics(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    """Long form with ``raw`` and ``scaled`` (0..1 per metric column; ece first
    replaced by max - ece; a constant column scales to 0)."""
    lm = long_metrics(results, partition, with_rank=False)
    w = Window.partitionBy(*partition, "metric")
    v = F.when(F.col("metric").isin(MINIMIZE), F.max("value").over(w) - F.col("value")).otherwise(F.col("value"))
    x = lm.withColumn("raw", F.col("value")).withColumn("_v", v)
    lo, hi = F.min("_v").over(w), F.max("_v").over(w)
    scaled = F.when(hi - lo > 0, (F.col("_v") - lo) / (hi - lo)).otherwise(F.col("_v") - lo)
    return x.select(*partition, "experiment", "metric", "raw", scaled.alias("scaled"))


def melt_class_f1(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    """wide ``f1_*`` -> (experiment, class, f1); every ``f1_`` removed from the
    name, ``_`` to space, title-cased."""
    f1_cols = [c for c in results.columns if c.startswith("f1_")]
    lm = results.select(*partition, "experiment", *[F.col(c).cast("double") for c in f1_cols]) \
        .unpivot([*partition, "experiment"], f1_cols, "class", "f1")
    name = title_case(F.replace(F.replace(F.col("class"), F.lit("f1_"), F.lit("")), F.lit("_"), F.lit(" ")))
    return lm.withColumn("class", name)


def fmt(col, digits: int = 4, missing: str = "N/A"):
    """Fixed-decimal string, ``missing`` for null (formatting only, never fed back)."""
    return py_format(col, digits, missing)


def summary_table(results: DataFrame, metrics: Sequence[str] = ("macro_f1", "accuracy"),
                  partition: Sequence[str] = ("dataset",)) -> DataFrame:
    cols = [m for m in metrics if m in results.columns]
    return results.select(*partition, "experiment", *[fmt(m).alias(m) for m in cols])


def detailed_table(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    main = ["macro_f1", "accuracy"] + [c for c in ["macro_avg_precision", "roc_auc", "ece"] if c in results.columns]
    main += sorted(c for c in results.columns if c.startswith("f1_"))
    return results.select(*partition, "experiment", *[fmt(m).alias(m) for m in main])


def class_table(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    cols = [c for p in CLASS_PREFIXES for c in sorted(x for x in results.columns if x.startswith(p))]
    return results.select(*partition, "experiment", *[fmt(m).alias(m) for m in cols])


def _report_columns(results: DataFrame, ap_column: str) -> list[str]:
    cols = ["macro_f1", "accuracy"] + [c for c in [ap_column, "roc_auc", "ece"] if c in results.columns]
    return cols + sorted(c for c in results.columns if c.startswith("f1_"))


def _report_rows(results: DataFrame, partition, digits: int, missing: str, bold: bool, ap_column: str):
    cols = _report_columns(results, ap_column)
    r = rank_experiments(results, partition)
    cells = []
    for c in cols:
        s = py_format(c, digits, missing)
        if bold:
            good = F.col(c) if c in MINIMIZE else -F.col(c)
            w = Window.partitionBy(*partition).orderBy(F.when(F.col(c).isNotNull(), good).asc_nulls_last(),
                                                       F.col("rank"))
            is_best = (F.row_number().over(w) == 1) & F.col(c).isNotNull()
            s = F.when(is_best, F.concat(F.lit("\\textbf{"), s, F.lit("}"))).otherwise(s)
        cells.append(s)
    return r, cells


def report_latex_rows(results: DataFrame, partition: Sequence[str] = ("dataset",),
                      ap_column: str = REPORT_AP_COLUMN) -> DataFrame:
    """LaTeX body rows: 3 decimals, ``---`` for null, best per column bold
    (min for ece, max otherwise, first run in rank order on ties)."""
    r, cells = _report_rows(results, partition, 3, "---", True, ap_column)
    line = F.concat(F.concat_ws(" & ", F.col("experiment"), *cells), F.lit(" \\\\"))
    return r.select(*partition, "rank", line.alias("line"))


def report_markdown_rows(results: DataFrame, partition: Sequence[str] = ("dataset",),
                         ap_column: str = REPORT_AP_COLUMN) -> DataFrame:
    """Markdown body rows, 4 decimals, ``---`` for null."""
    cols = ["macro_f1", "accuracy"] + [c for c in [ap_column, "roc_auc", "ece"] if c in results.columns]
    r = rank_experiments(results, partition)
    cells = [py_format(c, 4, "---") for c in cols]
    line = F.concat(F.lit("| "), F.concat_ws(" | ", F.col("experiment"), *cells), F.lit(" |"))
    return r.select(*partition, "rank", line.alias("line"))


def compare_two_methods(results: DataFrame, method1: str, method2: str, partition: Sequence[str] = ("dataset",),
                        ap_column: str = REPORT_AP_COLUMN) -> DataFrame:
    """Metric by metric: v1, v2, diff = v1 - v2, and whether method1 wins
    (ece: smaller wins; a tie is not a win). Per-class F1 rows included.
    Groups where a method is missing give no rows."""
    metrics = [m for m in ["macro_f1", "accuracy", ap_column, "roc_auc", "ece"] if m in results.columns]
    metrics += [c for c in results.columns if c.startswith("f1_")]
    lm = long_metrics(results, partition, metrics, with_rank=False)
    piv = lm.groupBy(*partition, "metric").agg(
        F.max(F.when(F.col("experiment") == method1, F.col("value"))).alias("v1"),
        F.max(F.when(F.col("experiment") == method2, F.col("value"))).alias("v2"),
        F.max((F.col("experiment") == method1).cast("int")).alias("_h1"),
        F.max((F.col("experiment") == method2).cast("int")).alias("_h2"),
    ).where((F.col("_h1") == 1) & (F.col("_h2") == 1))
    diff = F.col("v1") - F.col("v2")
    win = F.when(F.col("metric").isin(MINIMIZE), diff < 0).otherwise(diff > 0)
    return piv.select(*partition, "metric", "v1", "v2", diff.alias("diff"), F.coalesce(win, F.lit(False)).alias("method1_wins"))


def available_experiments(results: DataFrame, partition: Sequence[str] = ("dataset",)) -> DataFrame:
    """The run names per group (what a caller lists when a name is not found)."""
    return results.groupBy(*partition).agg(F.sort_array(F.collect_set("experiment")).alias("experiments"))


def filter_experiment(results: DataFrame, experiment: str, must_exist: bool = False) -> DataFrame:
    """Rows of one run; ``must_exist`` fails with the names there are if there is none (a table has a row per run)."""
    found = results.where(F.col("experiment") == experiment)
    if must_exist and found.isEmpty():
        names = sorted({n for r in available_experiments(results, []).collect() for n in r["experiments"]})
        raise ValueError(f"no run {experiment!r}; there are {names}")
    return found
