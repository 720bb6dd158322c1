"""Classification metrics over a long predictions table, for many runs at once.

Every metric is keyed by ``keys`` (e.g. dataset, experiment). Row-level data
is touched only by map-side-combined aggregations (confusion counts, score
histograms, calibration bins); everything after is algebra on small tables.
Predictions: ``keys..., row_id, label int, pred int, probs array<double>``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import argmax_label, log_softmax_at, max_confidence
from .rank import running_sums


def _k(keys: Sequence[str]) -> list[str]:
    return list(keys)


# ---------------------------------------------------------------- confusion

def confusion_counts(preds: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """(keys, label, pred, n) for the pairs that occur."""
    return (preds.groupBy(*_k(keys), F.col(label).alias("label"), F.col(pred).alias("pred"))
            .agg(F.count(F.lit(1)).alias("n")))


def class_union(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per group, the sorted union of true and predicted labels (tiny)."""
    return (counts.groupBy(*_k(keys))
            .agg(F.array_sort(F.array_union(F.collect_set("label"), F.collect_set("pred"))).alias("classes")))


def confusion_matrix(preds: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred",
                     counts: DataFrame | None = None) -> DataFrame:
    """Counts by (true, pred), zero-filled over the label union of each group."""
    counts = counts if counts is not None else confusion_counts(preds, keys, label, pred)
    grid = (class_union(counts, keys)
            .select(*_k(keys), F.explode("classes").alias("label"), "classes")
            .select(*_k(keys), "label", F.explode("classes").alias("pred")))
    return (grid.join(counts, on=[*_k(keys), "label", "pred"], how="left")
            .select(*_k(keys), "label", "pred", F.coalesce("n", F.lit(0)).cast("long").alias("n")))


def confusion_normalized(preds: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred") -> DataFrame:
    """Row shares (recall view); a row with no true samples gives null."""
    cm = confusion_matrix(preds, keys, label, pred)
    w = Window.partitionBy(*_k(keys), "label")
    total = F.sum("n").over(w)
    return cm.withColumn("share", F.when(total > 0, F.col("n") / total))


def confusion_array(preds: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred",
                    counts: DataFrame | None = None) -> DataFrame:
    """(keys, confusion_matrix array<array<bigint>>) rows = true class."""
    cm = confusion_matrix(preds, keys, label, pred, counts)
    rows = (cm.groupBy(*_k(keys), "label")
            .agg(F.array_sort(F.collect_list(F.struct("pred", "n"))).alias("cells"))
            .select(*_k(keys), "label", F.transform("cells", lambda c: c["n"]).alias("row")))
    return (rows.groupBy(*_k(keys))
            .agg(F.array_sort(F.collect_list(F.struct("label", "row"))).alias("rows"))
            .select(*_k(keys), F.transform("rows", lambda r: r["row"]).alias("confusion_matrix")))


def class_stats(preds: DataFrame, keys: Sequence[str], label: str = "label", pred: str = "pred",
                counts: DataFrame | None = None) -> DataFrame:
    """(keys, cls, tp, support, predicted) over the label union."""
    counts = counts if counts is not None else confusion_counts(preds, keys, label, pred)
    roles = F.array(
        F.struct(F.col("label").alias("cls"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(F.lit(0)).cast("long").alias("tp")),
        F.struct(F.col("pred").alias("cls"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("tp")),
    )
    return (counts.select(*_k(keys), F.explode(roles).alias("r"))
            .groupBy(*_k(keys), F.col("r.cls").alias("cls"))
            .agg(F.sum("r.tp").alias("tp"), F.sum("r.support").alias("support"),
                 F.sum("r.predicted").alias("predicted")))


def _ratio(num, den, zero_division: float):
    return F.when(den > 0, num / den).otherwise(F.lit(float(zero_division)))


def per_class_report(preds: DataFrame, keys: Sequence[str], zero_division: float = 0.0,
                     label: str = "label", pred: str = "pred", counts: DataFrame | None = None) -> DataFrame:
    """precision, recall, F1, support per class; ``zero_division`` for 0/0."""
    s = class_stats(preds, keys, label, pred, counts)
    return s.select(
        *_k(keys), "cls",
        _ratio(F.col("tp"), F.col("predicted"), zero_division).alias("precision"),
        _ratio(F.col("tp"), F.col("support"), zero_division).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), zero_division).alias("f1"),
        F.col("support"), F.col("tp"), F.col("predicted"),
    )


def classification_report(preds: DataFrame, keys: Sequence[str], zero_division: float = 0.0,
                          label_names: Sequence[str] | None = None, counts: DataFrame | None = None) -> DataFrame:
    """Per-class rows plus ``accuracy``, ``macro avg`` and ``weighted avg`` rows."""
    rep = per_class_report(preds, keys, zero_division, counts=counts)
    name = F.col("cls").cast("string")
    if label_names:
        name = F.coalesce(F.element_at(F.create_map(*[x for i, n in enumerate(label_names)
                                                      for x in (F.lit(i), F.lit(n))]), F.col("cls")), name)
    per = rep.select(*_k(keys), name.alias("row"), F.col("cls").alias("ord"), "precision", "recall", "f1",
                     F.col("support").cast("double").alias("support"))
    g = rep.groupBy(*_k(keys)).agg(
        (F.sum("tp") / F.sum("support")).alias("acc"),
        F.avg("precision").alias("mp"), F.avg("recall").alias("mr"), F.avg("f1").alias("mf"),
        (F.sum(F.col("precision") * F.col("support")) / F.sum("support")).alias("wp"),
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("wr"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("wf"),
        F.sum("support").cast("double").alias("n"),
    )
    big = 1 << 30
    acc = g.select(*_k(keys), F.lit("accuracy").alias("row"), F.lit(big).alias("ord"), F.lit(None).cast("double").alias("precision"),
                   F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1"), F.col("n").alias("support"))
    mac = g.select(*_k(keys), F.lit("macro avg").alias("row"), F.lit(big + 1).alias("ord"), F.col("mp").alias("precision"),
                   F.col("mr").alias("recall"), F.col("mf").alias("f1"), F.col("n").alias("support"))
    wei = g.select(*_k(keys), F.lit("weighted avg").alias("row"), F.lit(big + 2).alias("ord"), F.col("wp").alias("precision"),
                   F.col("wr").alias("recall"), F.col("wf").alias("f1"), F.col("n").alias("support"))
    return per.unionByName(acc).unionByName(mac).unionByName(wei)


def summary_metrics(preds: DataFrame, keys: Sequence[str], zero_division: float = 0.0,
                    counts: DataFrame | None = None) -> DataFrame:
    """accuracy, macro P/R/F1, micro P/R/F1 and MCC per group."""
    s = class_stats(preds, keys, counts=counts)
    rep = s.select(
        *_k(keys), "tp", "support", "predicted",
        _ratio(F.col("tp"), F.col("predicted"), zero_division).alias("precision"),
        _ratio(F.col("tp"), F.col("support"), zero_division).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("support") + F.col("predicted"), zero_division).alias("f1"),
    )
    g = rep.groupBy(*_k(keys)).agg(
        F.sum("tp").cast("double").alias("c"), F.sum("support").cast("double").alias("s"),
        F.sum("predicted").cast("double").alias("pp"),
        F.sum(F.col("predicted").cast("double") * F.col("support")).alias("pt"),
        F.sum(F.col("predicted").cast("double") * F.col("predicted")).alias("p2"),
        F.sum(F.col("support").cast("double") * F.col("support")).alias("t2"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"),
        F.avg("f1").alias("macro_f1"),
    )
    micro_p = F.when(F.col("pp") > 0, F.col("c") / F.col("pp")).otherwise(F.lit(float(zero_division)))
    micro_r = F.when(F.col("s") > 0, F.col("c") / F.col("s")).otherwise(F.lit(float(zero_division)))
    den = (F.col("s") * F.col("s") - F.col("p2")) * (F.col("s") * F.col("s") - F.col("t2"))
    mcc = F.when(den > 0, (F.col("c") * F.col("s") - F.col("pt")) / F.sqrt(den)).otherwise(F.lit(0.0))
    return g.select(
        *_k(keys),
        (F.col("c") / F.col("s")).alias("accuracy"),
        "macro_precision", "macro_recall", "macro_f1",
        micro_p.alias("micro_precision"), micro_r.alias("micro_recall"),
        F.when(F.col("pp") + F.col("s") > 0, 2 * F.col("c") / (F.col("pp") + F.col("s")))
         .otherwise(F.lit(float(zero_division))).alias("micro_f1"),
        mcc.alias("mcc"),
    )


# ---------------------------------------------------------------- ranking

def score_histogram(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label",
                    classes: Sequence[int] | None = None) -> DataFrame:
    """One-vs-rest (keys, cls, score, pos, neg), pre-aggregated by distinct score.

    ``classes``: which probability columns to score (default: all entries).
    """
    base = preds.select(*_k(keys), F.col(label).alias("_y"), F.posexplode(probs).alias("cls", "score"))
    if classes is not None:
        base = base.where(F.col("cls").isin(list(classes)))
    return (base.groupBy(*_k(keys), "cls", "score")
            .agg(F.sum(F.when(F.col("_y") == F.col("cls"), 1).otherwise(0)).cast("long").alias("pos"),
                 F.sum(F.when(F.col("_y") == F.col("cls"), 0).otherwise(1)).cast("long").alias("neg")))


def _curve(preds: DataFrame, keys: Sequence[str], probs: str, label: str, classes=None) -> DataFrame:
    """Histogram with inclusive running sums from the top score down, plus class totals."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(preds.sparkSession)
    # the histogram feeds the range sketch and three plan branches: write it
    # once to the shared checkpoint folder (reliable, lineage cut) and reuse it
    h = score_histogram(preds, keys, probs, label, classes).checkpoint(eager=True)
    cum = running_sums(h, [*_k(keys), "cls"], "score", ["pos", "neg"], descending=True)
    # class totals from the same frame: the histogram shuffle is shared, not redone
    totals = cum.groupBy(*_k(keys), "cls").agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return cum.join(totals, on=[*_k(keys), "cls"], how="inner")


def average_precision(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label",
                      classes: Sequence[int] | None = None) -> DataFrame:
    """Per class: sum over distinct thresholds of (R_i - R_{i-1}) * P_i (step, no
    interpolation). 0 when the class has no positive."""
    c = _curve(preds, keys, probs, label, classes)
    term = F.when(F.col("P") > 0, (F.col("pos") / F.col("P")) * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))))
    return c.groupBy(*_k(keys), "cls").agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("average_precision"))


def _auc_per_class(preds, keys, probs, label, classes=None) -> DataFrame:
    c = _curve(preds, keys, probs, label, classes)
    # positives at s beat negatives strictly below s, tie with negatives at s (half)
    term = F.col("pos") * ((F.col("N") - F.col("cum_neg")) + F.col("neg") / 2.0)
    return c.groupBy(*_k(keys), "cls").agg(
        F.sum(term).alias("_w"), F.first("P").alias("P"), F.first("N").alias("N"))


def roc_auc_binary(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label") -> DataFrame:
    """Rank AUC on P(class 1); ties count half; null if a class is absent."""
    a = _auc_per_class(preds, keys, probs, label, classes=[1])
    return a.select(*_k(keys), F.when((F.col("P") > 0) & (F.col("N") > 0),
                                      F.col("_w") / (F.col("P").cast("double") * F.col("N"))).alias("roc_auc"))


def roc_auc_ovr_macro(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label") -> DataFrame:
    """One-vs-rest AUC per class, macro mean; null if any class lacks positives or negatives."""
    a = _auc_per_class(preds, keys, probs, label)
    per = a.select(*_k(keys), "cls", F.when((F.col("P") > 0) & (F.col("N") > 0),
                                            F.col("_w") / (F.col("P").cast("double") * F.col("N"))).alias("auc"))
    return per.groupBy(*_k(keys)).agg(
        F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc")).alias("roc_auc"))


def ranking_metrics(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label") -> DataFrame:
    """One pass over one curve: per (keys, cls) average precision, one-vs-rest
    AUC (null when a side is empty), positives and negatives."""
    c = _curve(preds, keys, probs, label)
    ap_term = F.when(F.col("P") > 0, (F.col("pos") / F.col("P")) * (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))))
    auc_term = F.col("pos") * ((F.col("N") - F.col("cum_neg")) + F.col("neg") / 2.0)
    g = c.groupBy(*_k(keys), "cls").agg(
        F.coalesce(F.sum(ap_term), F.lit(0.0)).alias("average_precision"),
        F.sum(auc_term).alias("_w"), F.first("P").alias("P"), F.first("N").alias("N"))
    auc = F.when((F.col("P") > 0) & (F.col("N") > 0), F.col("_w") / (F.col("P").cast("double") * F.col("N")))
    return g.select(*_k(keys), "cls", "average_precision", auc.alias("auc"), "P", "N")


def pr_curve(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label",
             classes: Sequence[int] | None = None) -> DataFrame:
    """(keys, cls, threshold, precision, recall) per distinct score, plus the
    (precision 1, recall 0) end point with a null threshold."""
    c = _curve(preds, keys, probs, label, classes)
    pts = c.select(
        *_k(keys), "cls", F.col("score").alias("threshold"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"),
        F.when(F.col("P") > 0, F.col("cum_pos") / F.col("P")).otherwise(F.lit(1.0)).alias("recall"),
    )
    end = (c.select(*_k(keys), "cls").distinct()
           .select(*_k(keys), "cls", F.lit(None).cast("double").alias("threshold"),
                   F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall")))
    return pts.unionByName(end)


# ---------------------------------------------------------------- calibration

def bin_edges(n_bins: int = 10) -> list[float]:
    """Evenly spaced edges computed like a linspace: i * (1/n), last edge exactly 1."""
    step = 1.0 / n_bins
    return [i * step for i in range(n_bins)] + [1.0]


def bin_index(conf, n_bins: int = 10):
    """Right-closed bins (lo, hi] by comparison with the double edges; 0 is in no bin."""
    edges = bin_edges(n_bins)
    c = F.col(conf) if isinstance(conf, str) else conf
    expr = None
    for i in range(n_bins):
        cond = (c > F.lit(edges[i])) & (c <= F.lit(edges[i + 1]))
        expr = F.when(cond, F.lit(i)) if expr is None else expr.when(cond, F.lit(i))
    return expr


def _calibration_rows(preds: DataFrame, keys: Sequence[str], probs: str, label: str, n_bins: int) -> DataFrame:
    return preds.select(
        *_k(keys),
        max_confidence(probs).alias("conf"),
        (argmax_label(probs) == F.col(label)).cast("int").alias("hit"),
    ).withColumn("bin", bin_index("conf", n_bins))


def calibration_bins(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label",
                     n_bins: int = 10) -> DataFrame:
    """All ``n_bins`` rows per group: lower, upper, mean confidence, accuracy, count (zeros when empty)."""
    rows = _calibration_rows(preds, keys, probs, label, n_bins)
    per = (rows.where(F.col("bin").isNotNull()).groupBy(*_k(keys), "bin")
           .agg(F.avg("conf").alias("confidence"), F.avg("hit").alias("accuracy"),
                F.count(F.lit(1)).alias("count")))
    edges = bin_edges(n_bins)
    dim = F.array(*[F.struct(F.lit(i).alias("bin"), F.lit(edges[i]).alias("bin_lower"),
                             F.lit(edges[i + 1]).alias("bin_upper")) for i in range(n_bins)])
    groups = rows.select(*_k(keys)).distinct().select(*_k(keys), F.explode(dim).alias("b")) \
        .select(*_k(keys), "b.*")
    return (groups.join(per, on=[*_k(keys), "bin"], how="left")
            .select(*_k(keys), "bin", "bin_lower", "bin_upper",
                    F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
                    F.coalesce("accuracy", F.lit(0.0)).alias("accuracy"),
                    F.coalesce("count", F.lit(0)).cast("long").alias("count")))


def ece(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label", n_bins: int = 10,
        cells: DataFrame | None = None) -> DataFrame:
    """sum_b (n_b / n) * |conf_b - acc_b|; n counts every row (also those in no bin)."""
    if cells is None:
        rows = _calibration_rows(preds, keys, probs, label, n_bins)
        per = rows.groupBy(*_k(keys), "bin").agg(
            F.count(F.lit(1)).alias("nb"), F.sum("conf").alias("sc"), F.sum("hit").alias("sh"))
    else:
        per = cells.groupBy(*_k(keys), "bin").agg(
            F.sum("n").alias("nb"), F.sum("sc").alias("sc"), F.sum(F.col("n") * F.col("hit")).alias("sh"))
    w = Window.partitionBy(*_k(keys))
    per = per.withColumn("n", F.sum("nb").over(w))
    term = F.when(F.col("bin").isNotNull(),
                  F.abs(F.col("sc") / F.col("nb") - F.col("sh") / F.col("nb")) * (F.col("nb") / F.col("n")))
    return per.groupBy(*_k(keys)).agg(F.coalesce(F.sum(term), F.lit(0.0)).alias("ece"))


# ---------------------------------------------------------------- loss

def weighted_cross_entropy(df: DataFrame, keys: Sequence[str], weights: DataFrame, logits: str = "logits",
                           label: str = "label") -> DataFrame:
    """sum(w_y * -log softmax(logits)[y]) / sum(w_y) per group.

    ``weights``: (label, weight), one row per class. A row whose label has no
    weight fails the job: it must not vanish from the mean.
    """
    w = weights.select(F.col("label").alias("_wl"), F.col("weight").alias("_w"))
    known = F.coalesce("_w", F.raise_error(F.concat(F.lit("no class weight for label "), F.coalesce(F.col(label).cast("string"), F.lit("null")))).cast("double"))
    rows = df.join(w, F.col(label) == F.col("_wl"), "left").select(
        *_k(keys), known.alias("_w"), (-log_softmax_at(logits, F.col(label))).alias("_nll"))
    return rows.groupBy(*_k(keys)).agg(
        (F.sum(F.col("_w") * F.col("_nll")) / F.sum("_w")).alias("weighted_cross_entropy"),
        F.count(F.lit(1)).alias("n"))


# ---------------------------------------------------------------- one record per run

def metric_cells(preds: DataFrame, keys: Sequence[str], probs: str = "probs", label: str = "label",
                 pred: str = "pred", n_bins: int = 10) -> DataFrame:
    """One pass over the rows: (keys, label, pred, bin, hit) -> n, sum of
    confidence. Every confusion- and calibration-based metric derives from this
    small table (at most classes^2 x (bins + 1) x 2 rows per group)."""
    rows = preds.select(*_k(keys), F.col(label).alias("label"), F.col(pred).alias("pred"),
                        max_confidence(probs).alias("conf"),
                        (argmax_label(probs) == F.col(label)).cast("int").alias("hit"))
    return (rows.withColumn("bin", bin_index("conf", n_bins))
            .groupBy(*_k(keys), "label", "pred", "bin", "hit")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("conf").alias("sc")))


def counts_from_cells(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    return cells.groupBy(*_k(keys), "label", "pred").agg(F.sum("n").alias("n"))


def evaluate_runs(preds: DataFrame, keys: Sequence[str], label_names: Sequence[str] | None = None,
                  zero_division: float = 0.0, n_bins: int = 10) -> DataFrame:
    """The full metric record per group: macro_f1, accuracy, macro_avg_precision,
    roc_auc (binary when two probability entries, else one-vs-rest macro), ece,
    per-class maps (keyed by class name), the confusion matrix and the classification report (a map from its rows
    to precision, recall, f1 and support)."""
    keys = _k(keys)
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(preds.sparkSession)
    cells = metric_cells(preds, keys, n_bins=n_bins).checkpoint(eager=True)  # small, read by 3 branches
    counts = counts_from_cells(cells, keys)
    rep = per_class_report(preds, keys, zero_division, counts=counts)
    rk = ranking_metrics(preds, keys)

    def name(c):
        if not label_names:
            return c.cast("string")
        m = F.create_map(*[x for i, n in enumerate(label_names) for x in (F.lit(i), F.lit(n))])
        return F.coalesce(F.element_at(m, c), c.cast("string"))

    cls_maps = rep.groupBy(*keys).agg(
        F.avg("f1").alias("macro_f1"),
        (F.sum("tp") / F.sum("support")).alias("accuracy"),
        F.map_from_entries(F.collect_list(F.struct(name(F.col("cls")), F.col("f1")))).alias("f1_per_class"),
        F.map_from_entries(F.collect_list(F.struct(name(F.col("cls")), F.col("precision")))).alias("precision_per_class"),
        F.map_from_entries(F.collect_list(F.struct(name(F.col("cls")), F.col("recall")))).alias("recall_per_class"),
    )
    # two probability entries: binary AUC on class 1; more: one-vs-rest macro mean
    ap_maps = rk.groupBy(*keys).agg(
        F.avg("average_precision").alias("macro_avg_precision"),
        F.map_from_entries(F.collect_list(F.struct(name(F.col("cls")), F.col("average_precision")))).alias("avg_precision_per_class"),
        F.when(F.count(F.lit(1)) == 2, F.max(F.when(F.col("cls") == 1, F.col("auc"))))
         .otherwise(F.when(F.count("auc") == F.count(F.lit(1)), F.avg("auc"))).alias("roc_auc"),
    )
    entry = F.struct("row", F.struct("precision", "recall", "f1", "support"))
    reports = (classification_report(preds, keys, zero_division, label_names, counts).groupBy(*keys)
               .agg(F.map_from_entries(F.collect_list(entry)).alias("classification_report")))
    return (cls_maps.join(ap_maps, keys, "left").join(reports, keys, "left")
            .join(ece(preds, keys, n_bins=n_bins, cells=cells).withColumnRenamed("ece", "expected_calibration_error"),
                  keys, "left")
            .join(confusion_array(preds, keys, counts=counts), keys, "left"))


def cross_dataset_eval(preds: DataFrame, train_col: str = "train_dataset", test_col: str = "test_dataset",
                       extra_keys: Sequence[str] = (), full: bool = False) -> DataFrame:
    """Metrics of models trained on one corpus and tested on another: the
    (train, test) pair is just more grouping keys; ``full`` gives the complete
    metric record, otherwise the confusion-based summary."""
    keys = [train_col, test_col, *extra_keys]
    return evaluate_runs(preds, keys) if full else summary_metrics(preds, keys)
