"""Registered queries: one per operator key, each reading the driver tables.

Doubles are rounded to 6 places at the very end so the DuckDB oracle can be
compared value by value; formatting and rounding never feed back into logic.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import corpus as C
from ..operators import metrics as M
from . import fixtures as X
from .fixtures import KEYS

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def r6(c):
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def round_doubles(df: DataFrame) -> DataFrame:
    return df.select(*[r6(f.name).alias(f.name) if f.dataType.typeName() == "double" else F.col(f"`{f.name}`")
                       for f in df.schema.fields])


# ---------------------------------------------------------------- flagship

def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned, deduplicated corpus -> deterministic scorers on the cleaned
    length -> confusion-based quality and calibration per (dataset, experiment)."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    corpus = X.labelled_corpus(spark, sf)
    deduped = C.dedup_keep_first(corpus)
    cleaned = deduped.withColumn("text", T.clean_text("text")).withColumn("n_chars", F.length("text").cast("long"))
    runs = F.array(*[F.struct(F.lit(n).alias("experiment"), F.expr(e).cast("double").alias("p"))
                     for n, e in X.SCORERS.items()])
    preds = (cleaned.select("dataset", "row_id", "label", F.explode(runs).alias("r"))
             .select("dataset", F.col("r.experiment").alias("experiment"), "row_id", "label",
                     F.array(F.lit(1.0) - F.col("r.p"), F.col("r.p")).alias("probs"))
             .withColumn("pred", F.when(F.col("probs")[1] > F.col("probs")[0], 1).otherwise(0)))
    # one pass over the rows into the small cells table, everything else from it
    cells = M.metric_cells(preds, KEYS).checkpoint(eager=True)
    summ = M.summary_metrics(preds, KEYS, counts=M.counts_from_cells(cells, KEYS)).select(*KEYS, "accuracy", "macro_f1")
    cal = M.ece(preds, KEYS, cells=cells)
    n = cells.groupBy(*KEYS).agg(F.sum("n").alias("n"))
    return round_doubles(summ.join(cal, KEYS).join(n, KEYS))


register("scorer_quality")(flagship)


# ---------------------------------------------------------------- §2.7 text functions

def _docs(spark, sf):
    return X.table(spark, sf, "documents").select(F.col("doc_id").alias("row_id"), "text")


def _text_query(fn):
    def q(spark, sf):
        return _docs(spark, sf).select("row_id", fn(F.col("text")).alias("out"))
    return q


for _name, _fn in {
    "clean_text": T.clean_text,
    "normalize_mention": T.normalize_mention,
    "normalize_email": T.normalize_email,
    "unpack_hashtag": T.unpack_hashtag,
    "expand_ampersand": T.expand_ampersand,
    "collapse_whitespace": T.collapse_whitespace,
    "simple_preprocess": T.simple_preprocess,
}.items():
    register(_name)(_text_query(_fn))


@register("generic_preprocess")
def q_generic_preprocess(spark, sf):
    from ..functions.emoji import emoji_to_text
    return X.posts(spark, sf).select("row_id", T.generic_preprocess("text", emoji_to_text("text", "tokens")).alias("out"))


@register("baseline_preprocess")
def q_baseline_preprocess(spark, sf):
    from ..operators.hashtags import baseline_clean
    return baseline_clean(X.posts(spark, sf)).select("row_id", F.col("text").alias("out"))


@register("social_normalize")
def q_social_normalize(spark, sf):
    from ..operators.hashtags import social_clean
    return social_clean(X.posts(spark, sf)).select("row_id", F.col("text").alias("out"))


@register("normalize_url")
def q_normalize_url(spark, sf):
    pages = X.table(spark, sf, "pages")
    return pages.select(F.col("page_id").alias("row_id"),
                        T.normalize_url(F.concat_ws(" ", "url", "html")).alias("out"))


@register("token_length_stats")
def q_token_length_stats(spark, sf):
    return round_doubles(C.token_length_stats(X.unlabelled_corpus(spark, sf), by=["split"]))


@register("corpus_unigrams")
def q_corpus_unigrams(spark, sf):
    return C.corpus_unigrams(X.table(spark, sf, "documents"))


# Prompt templates of the registered prompt queries.
ZERO_TEMPLATE = "Classifique o texto (0 = normal, 1 = ofensivo).\nTexto: {text}\n{examples}Classe:"
FEW_TEMPLATE = "Classifique o texto.{examples}\nTexto: {text}\nClasse:"
NAMES = ["normal", "ofensivo"]


@register("format_prompt_zero")
def q_format_prompt_zero(spark, sf):
    from ..functions.prompts import format_prompt_zero
    c = X.unlabelled_corpus(spark, sf)
    return c.select("row_id", format_prompt_zero(ZERO_TEMPLATE, "text").alias("prompt"))


def _few_shot_examples(spark, sf, n=2):
    c = X.labelled_corpus(spark, sf)
    return C.few_shot_sample(c.where(F.col("split") == "train"), n=n, seed=42)


@register("format_prompt_few")
def q_format_prompt_few(spark, sf):
    from ..functions.prompts import examples_block, format_prompt_few
    ex = examples_block(_few_shot_examples(spark, sf), NAMES)
    rows = X.unlabelled_corpus(spark, sf)
    # attach_examples: the one-row block enters every row as a scalar subquery
    return rows.select("row_id", format_prompt_few(FEW_TEMPLATE, "text", ex.scalar()).alias("prompt"))


@register("attach_examples")
def q_attach_examples(spark, sf):
    from ..functions.prompts import attach_examples, examples_block
    ex = examples_block(_few_shot_examples(spark, sf), NAMES)
    j = attach_examples(X.unlabelled_corpus(spark, sf), ex)
    return j.select("row_id", F.length("examples").cast("long").alias("examples_chars"),
                    F.md5("examples").alias("examples_md5"))


@register("build_instruction_pairs")
def q_build_instruction_pairs(spark, sf):
    from ..functions.prompts import build_instruction_pairs
    c = X.labelled_corpus(spark, sf)
    return build_instruction_pairs(c).select("row_id", "input_text", "target_text")


@register("verbalize_label")
def q_verbalize_label(spark, sf):
    c = X.labelled_corpus(spark, sf)
    return c.select("row_id", "label", T.verbalize_label("label").alias("target"))


def _answers(spark, sf):
    conv = X.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", F.col("text").alias("generated"))


@register("extract_label_simple")
def q_extract_label_simple(spark, sf):
    from ..functions.answers import extract_label_simple
    return _answers(spark, sf).select("conv_id", "turn", extract_label_simple("generated").alias("pred"))


@register("extract_label")
def q_extract_label(spark, sf):
    from ..functions.answers import extract_label
    a = _answers(spark, sf)
    return a.select("conv_id", "turn",
                    extract_label("generated", 2).alias("pred"),
                    extract_label("generated", 2, ["0", "1"]).alias("pred_named"),
                    extract_label("generated", 3, ["neutro", "ofensivo", "odio"]).alias("pred_k3"))


@register("extraction_outcome")
def q_extraction_outcome(spark, sf):
    from ..functions.answers import extraction_outcome
    a = _answers(spark, sf)
    return (a.select(extraction_outcome("generated", 2, ["0", "1"]).alias("outcome"))
            .groupBy("outcome").agg(F.count(F.lit(1)).alias("n")))


# ---------------------------------------------------------------- §2.4 metrics

def _all_preds(spark, sf):
    """Binary runs (3 scorers x 4 datasets) and the 10-class run, one long table."""
    b = X.binary_predictions(spark, sf)
    m = X.multiclass_predictions(spark, sf).drop("logits")
    return b.unionByName(m)


@register("confusion_matrix")
def q_confusion_matrix(spark, sf):
    return M.confusion_matrix(_all_preds(spark, sf), KEYS)


@register("confusion_normalized")
def q_confusion_normalized(spark, sf):
    return round_doubles(M.confusion_normalized(_all_preds(spark, sf), KEYS))


@register("per_class_report")
def q_per_class_report(spark, sf):
    r = M.per_class_report(_all_preds(spark, sf), KEYS, zero_division=0.0)
    return round_doubles(r.select(*KEYS, "cls", "precision", "recall", "f1", "support"))


@register("classification_report")
def q_classification_report(spark, sf):
    r = M.classification_report(_all_preds(spark, sf), KEYS)
    return round_doubles(r.drop("ord"))


@register("macro_f1")
def q_macro_f1(spark, sf):
    return round_doubles(M.summary_metrics(_all_preds(spark, sf), KEYS).select(*KEYS, "macro_f1"))


@register("accuracy")
def q_accuracy(spark, sf):
    return round_doubles(M.summary_metrics(_all_preds(spark, sf), KEYS).select(*KEYS, "accuracy"))


@register("f1_per_class")
def q_f1_per_class(spark, sf):
    return round_doubles(M.per_class_report(_all_preds(spark, sf), KEYS).select(*KEYS, "cls", "f1"))


@register("micro_prf")
def q_micro_prf(spark, sf):
    s = M.summary_metrics(_all_preds(spark, sf), KEYS)
    return round_doubles(s.select(*KEYS, "micro_precision", "micro_recall", "micro_f1"))


@register("macro_prf")
def q_macro_prf(spark, sf):
    s = M.summary_metrics(_all_preds(spark, sf), KEYS, zero_division=1.0)
    return round_doubles(s.select(*KEYS, "macro_precision", "macro_recall", "macro_f1"))


@register("mcc")
def q_mcc(spark, sf):
    return round_doubles(M.summary_metrics(_all_preds(spark, sf), KEYS).select(*KEYS, "mcc"))


@register("average_precision")
def q_average_precision(spark, sf):
    return round_doubles(M.average_precision(_all_preds(spark, sf), KEYS))


@register("roc_auc_binary")
def q_roc_auc_binary(spark, sf):
    return round_doubles(M.roc_auc_binary(X.binary_predictions(spark, sf), KEYS))


@register("roc_auc_ovr_macro")
def q_roc_auc_ovr_macro(spark, sf):
    return round_doubles(M.roc_auc_ovr_macro(_all_preds(spark, sf), KEYS))


@register("pr_curve")
def q_pr_curve(spark, sf):
    return round_doubles(M.pr_curve(_all_preds(spark, sf), KEYS))


@register("ece")
def q_ece(spark, sf):
    return round_doubles(M.ece(_all_preds(spark, sf), KEYS))


@register("calibration_bins")
def q_calibration_bins(spark, sf):
    return round_doubles(M.calibration_bins(_all_preds(spark, sf), KEYS))


@register("weighted_cross_entropy")
def q_weighted_cross_entropy(spark, sf):
    """Every entry of the embedding is a logit; the labels are the first classes."""
    m = X.table(spark, sf, "embeddings").select(
        F.lit("emb").alias("dataset"), F.lit("whole").alias("experiment"), F.col("label").cast("int").alias("label"),
        F.transform("embedding", lambda x: x.cast("double")).alias("logits"))
    w = C.class_weights(m, "label", mode="balanced")
    return round_doubles(M.weighted_cross_entropy(m, KEYS, w))


@register("softmax")
def q_softmax(spark, sf):
    from ..functions.arrays import softmax
    e = X.table(spark, sf, "embeddings")
    p = softmax("embedding")
    return e.select(F.col("vec_id").alias("row_id"), F.posexplode(p).alias("cls", "prob")) \
        .withColumn("prob", r6("prob"))


@register("argmax_label")
def q_argmax_label(spark, sf):
    from ..functions.arrays import argmax_label
    e = X.table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("row_id"), argmax_label("embedding").alias("pred"))


@register("max_confidence")
def q_max_confidence(spark, sf):
    from ..functions.arrays import max_confidence, softmax
    m = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), softmax("embedding").alias("probs"))
    return m.select("row_id", r6(max_confidence("probs")).alias("confidence"))


@register("prob_slice")
def q_prob_slice(spark, sf):
    from ..functions.arrays import prob_slice, softmax
    m = X.table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), softmax("embedding").alias("probs"))
    return m.select("row_id", F.posexplode(prob_slice("probs", 3)).alias("cls", "prob")).withColumn("prob", r6("prob"))


def _report_text(report):
    """``row:precision:recall:f1:support`` of every row in millionths, sorted, comma-joined."""
    shown = lambda x: F.coalesce(F.round(x * 1e6).cast("long").cast("string"), F.lit(""))
    row = lambda e: F.concat_ws(":", e["key"], *[shown(e["value"][c]) for c in ("precision", "recall", "f1", "support")])
    return F.array_join(F.array_sort(F.transform(F.map_entries(report), row)), ",")


@register("evaluate_runs")
def q_evaluate_runs(spark, sf):
    ev = M.evaluate_runs(_all_preds(spark, sf), KEYS)
    return round_doubles(ev.select(*KEYS, "macro_f1", "accuracy", "macro_avg_precision", "roc_auc",
                                   "expected_calibration_error",
                                   F.to_json("confusion_matrix").alias("confusion_matrix"), _report_text("classification_report").alias("report")))


# ---------------------------------------------------------------- §2.2 / §2.3 projections and joins

@register("join_text_labels")
def q_join_text_labels(spark, sf):
    j = C.join_text_labels(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"), key="doc_id")
    return j.select("doc_id", "lang", "n_chars", "quality", "toxic")


@register("align_predictions")
def q_align_predictions(spark, sf):
    truth = X.labelled_corpus(spark, sf).select("row_id", "label")
    preds = X.binary_predictions(spark, sf).where(F.col("experiment") == "e3").select("row_id", "pred")
    return C.align_predictions(truth, preds)


@register("union_corpora")
def q_union_corpora(spark, sf):
    lab = X.labelled_corpus(spark, sf).select("row_id", "text", "label").withColumn("origin", F.lit("documents"))
    bench = X.table(spark, sf, "benchmark").select(F.col("item_id").alias("row_id"), "text") \
        .withColumn("origin", F.lit("benchmark"))
    u = C.union_corpora(lab, bench)
    return u.select("origin", "row_id", "label", F.length("text").cast("long").alias("chars"))


@register("project_text_label")
def q_project_text_label(spark, sf):
    return C.project_text_label(X.labelled_corpus(spark, sf))


@register("canonical_rename")
def q_canonical_rename(spark, sf):
    j = C.join_text_labels(X.table(spark, sf, "documents"), X.table(spark, sf, "labels"), key="doc_id")
    r = C.canonical_rename(j.select("doc_id", F.col("text").alias("body"), "toxic"), "body", "toxic")
    return r.select("doc_id", "text", "label")


@register("binarize_label")
def q_binarize_label(spark, sf):
    conv = X.table(spark, sf, "conversations")
    return conv.select("conv_id", "turn", C.binarize_label("role", "assistant").alias("label"))


@register("drop_null_rows")
def q_drop_null_rows(spark, sf):
    docs = X.table(spark, sf, "documents")
    j = docs.join(X.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", F.col("toxic").alias("label"))
    return C.drop_null_rows(j).select("doc_id", "label")


@register("drop_all_null_columns")
def q_drop_all_null_columns(spark, sf):
    docs = X.table(spark, sf, "documents").select("doc_id", "lang")
    unl = docs.join(X.table(spark, sf, "labels"), "doc_id", "left_anti")
    j = unl.join(X.table(spark, sf, "labels"), "doc_id", "left")  # quality / toxic are all null here
    return C.drop_all_null_columns(j)


@register("cast_label")
def q_cast_label(spark, sf):
    lab = X.table(spark, sf, "labels").select(F.col("doc_id").alias("text"), F.col("quality").alias("label"))
    return C.cast_label(lab)


@register("filter_class")
def q_filter_class(spark, sf):
    return X.labelled_corpus(spark, sf).where(F.col("label") == 1).select("row_id", "dataset")


@register("label_name_lookup")
def q_label_name_lookup(spark, sf):
    c = X.labelled_corpus(spark, sf)
    named = c.select("row_id", C.label_name_lookup("label", NAMES).alias("name"))
    return named.select("row_id", "name", C.label_id_lookup("name", NAMES).alias("label"))


@register("add_row_index")
def q_add_row_index(spark, sf):
    return C.add_row_index(X.unlabelled_corpus(spark, sf).select("row_id")).select("row_id", "index")


@register("sort_by_index")
def q_sort_by_index(spark, sf):
    idx = C.add_row_index(X.binary_predictions(spark, sf).where(F.col("experiment") == "e3").select("row_id", "pred"))
    return idx.select("index", F.col("pred").alias("prediction")).orderBy("index")


# ---------------------------------------------------------------- §2.4 corpus aggregations

def _train(spark, sf):
    return X.labelled_corpus(spark, sf).where(F.col("split") == "train")


@register("class_distribution")
def q_class_distribution(spark, sf):
    return round_doubles(C.class_distribution(_train(spark, sf), names=NAMES))


@register("class_weights_balanced")
def q_class_weights_balanced(spark, sf):
    return round_doubles(C.class_weights(_train(spark, sf), mode="balanced"))


@register("class_weights_inverse")
def q_class_weights_inverse(spark, sf):
    return round_doubles(C.class_weights(_train(spark, sf), mode="inverse"))


@register("minority_class")
def q_minority_class(spark, sf):
    return C.minority_class(X.labelled_corpus(spark, sf))


@register("null_profile")
def q_null_profile(spark, sf):
    docs = X.table(spark, sf, "documents")
    j = docs.join(X.table(spark, sf, "labels"), "doc_id", "left").select("doc_id", "text", "lang", "quality", "toxic")
    return C.null_profile(j)


@register("duplicate_count")
def q_duplicate_count(spark, sf):
    return C.duplicate_count(X.table(spark, sf, "documents"), ["text"])


@register("column_profile")
def q_column_profile(spark, sf):
    return round_doubles(C.table_profile(X.table(spark, sf, "documents")))


@register("split_conservation")
def q_split_conservation(spark, sf):
    return C.split_conservation(C.random_split(X.unlabelled_corpus(spark, sf).select("row_id")))


# ---------------------------------------------------------------- §2.5 window-style operators

@register("dedup_keep_first")
def q_dedup_keep_first(spark, sf):
    return C.dedup_keep_first(X.unlabelled_corpus(spark, sf)).select("row_id", "split")


@register("few_shot_sample")
def q_few_shot_sample(spark, sf):
    return _few_shot_examples(spark, sf, n=3).select("label", "shot", "row_id")


@register("random_split")
def q_random_split(spark, sf):
    return C.random_split(X.unlabelled_corpus(spark, sf).select("row_id")).select("row_id", "split")


@register("stratified_split")
def q_stratified_split(spark, sf):
    return C.stratified_split(X.labelled_corpus(spark, sf).drop("split")).select("row_id", "label", "split")


@register("batch_assignment")
def q_batch_assignment(spark, sf):
    return C.batch_assignment(X.unlabelled_corpus(spark, sf).select("row_id"), 16)


@register("length_bucketed_batches")
def q_length_bucketed_batches(spark, sf):
    d = X.unlabelled_corpus(spark, sf).select("row_id", "n_chars")
    return C.length_bucketed_batches(d, "n_chars", batch_size=8, width=1000)


@register("length_grouped_batches")
def q_length_grouped_batches(spark, sf):
    """Shuffled length grouping of all documents, with the padding share of its batches and of plain consecutive ones."""
    d = X.unlabelled_corpus(spark, sf).select("row_id", F.coalesce("n_chars", F.lit(0)).alias("n_chars"))
    grouped = C.length_grouped_batches(d, "n_chars", batch_size=8, mega=20)
    share = lambda df, name: C.padding_share(df, "n_chars").select(F.col("share").alias(name))
    plain = C.batch_assignment(d, 8)
    return round_doubles(grouped.withColumns({"share": share(grouped, "share").scalar(), "plain_share": share(plain, "plain_share").scalar()}))


@register("own_test_split")
def q_own_test_split(spark, sf):
    """Documents of one source bring their own test part; the others are cut into train and validation."""
    d = X.unlabelled_corpus(spark, sf).select("row_id", "split")
    return C.random_split(d, val_ratio=0.2, out="part", own_test=F.col("split") == "test").select("row_id", "part")


@register("best_checkpoint")
def q_best_checkpoint(spark, sf):
    from ..operators.training import best_checkpoint
    return round_doubles(best_checkpoint(X.epoch_metrics(spark, sf)))


@register("early_stop_epoch")
def q_early_stop_epoch(spark, sf):
    from ..operators.training import early_stop_epoch
    return early_stop_epoch(X.epoch_metrics(spark, sf), patience=5)


# ---------------------------------------------------------------- §2.6 / §2.9 run tables

from ..operators import runs as R  # noqa: E402

CLASS_NAMES = ["0", "1"]


def results_table(spark, sf):
    """One wide row per (dataset, experiment) from the full metric records."""
    ev = M.evaluate_runs(X.binary_predictions(spark, sf), KEYS)
    return R.flatten_metric_maps(ev, KEYS, CLASS_NAMES)


register("flatten_metric_maps")(lambda spark, sf: round_doubles(results_table(spark, sf)))


@register("compare_models")
def q_compare_models(spark, sf):
    r = results_table(spark, sf)
    cols = ["macro_f1", "accuracy", "macro_avg_precision", "roc_auc", "ece"] + \
        [f"f1_{c}" for c in CLASS_NAMES] + [f"ap_{c}" for c in CLASS_NAMES]
    out = R.rank_experiments(r).select("dataset", F.col("experiment").alias("model"), "rank", *cols)
    return round_doubles(out).orderBy("dataset", "rank")


@register("rank_experiments")
def q_rank_experiments(spark, sf):
    return round_doubles(R.rank_experiments(results_table(spark, sf)).select("dataset", "experiment", "rank", "macro_f1"))


@register("best_method_per_metric")
def q_best_method_per_metric(spark, sf):
    return round_doubles(R.best_method_per_metric(results_table(spark, sf)))


@register("metric_statistics")
def q_metric_statistics(spark, sf):
    return round_doubles(R.metric_statistics(results_table(spark, sf)))


@register("minmax_scaled_metrics")
def q_minmax_scaled_metrics(spark, sf):
    return round_doubles(R.minmax_scaled_metrics(results_table(spark, sf)))


@register("melt_class_f1")
def q_melt_class_f1(spark, sf):
    return round_doubles(R.melt_class_f1(results_table(spark, sf)))


@register("select_by_prefix")
def q_select_by_prefix(spark, sf):
    return round_doubles(R.select_by_prefix(results_table(spark, sf), ["f1_", "ap_"], keep=["dataset", "experiment"]))


@register("summary_table")
def q_summary_table(spark, sf):
    return R.summary_table(results_table(spark, sf))


@register("detailed_table")
def q_detailed_table(spark, sf):
    return R.detailed_table(results_table(spark, sf))


@register("class_table")
def q_class_table(spark, sf):
    return R.class_table(results_table(spark, sf))


@register("report_latex_rows")
def q_report_latex_rows(spark, sf):
    return R.report_latex_rows(results_table(spark, sf))


@register("report_markdown_rows")
def q_report_markdown_rows(spark, sf):
    return R.report_markdown_rows(results_table(spark, sf))


@register("compare_two_methods")
def q_compare_two_methods(spark, sf):
    return round_doubles(R.compare_two_methods(results_table(spark, sf), "e3", "e1"))


@register("diff_format")
def q_diff_format(spark, sf):
    c = R.compare_two_methods(results_table(spark, sf), "e3", "e1")
    return c.select("dataset", "metric", T.diff_format("diff").alias("diff"))


@register("metric_display_name")
def q_metric_display_name(spark, sf):
    lm = R.long_metrics(results_table(spark, sf), with_rank=False)
    return lm.select("metric").distinct().select("metric", T.metric_display_name("metric").alias("display"))


@register("filter_experiment")
def q_filter_experiment(spark, sf):
    return round_doubles(R.filter_experiment(results_table(spark, sf), "e3", must_exist=True).select("dataset", "experiment", "macro_f1"))


@register("cross_dataset_eval")
def q_cross_dataset_eval(spark, sf):
    """Train-side dataset fixes a decision threshold (its positive rate); the
    rule is applied to every other dataset's test rows; metrics per pair."""
    c = X.labelled_corpus(spark, sf)
    p = X.binary_predictions(spark, sf).where(F.col("experiment") == "e3").select("dataset", "row_id", "label", "probs")
    rates = c.where(F.col("split") != "test").groupBy(F.col("dataset").alias("train_dataset")).agg(F.avg("label").alias("rate"))
    test = p.join(c.where(F.col("split") == "test").select("row_id"), "row_id", "left_semi") \
        .groupBy(F.col("dataset").alias("test_dataset"), "label", F.col("probs")[1].alias("score")).agg(F.count(F.lit(1)).alias("n"))
    thresholds = rates.agg(F.collect_list(F.struct("train_dataset", "rate"))).scalar()  # one entry per dataset
    pairs = test.withColumn("rule", F.explode(thresholds)).select("*", "rule.*").where(F.col("train_dataset") != F.col("test_dataset"))
    pred = (F.col("score") >= F.lit(1.0) - F.col("rate")).cast("int").alias("pred")
    keys = ["train_dataset", "test_dataset"]
    counts = pairs.groupBy(*keys, "label", pred).agg(F.sum("n").alias("n"))
    return round_doubles(M.summary_metrics(pairs, keys, counts=counts).select(*keys, "accuracy", "macro_f1"))


# ---------------------------------------------------------------- §2.1 sources and sinks
# Each query writes Spark-derived data to a fresh folder under the shared
# checkpoint folder, then returns the lazy read of it.

from pyspark.sql import types as TT  # noqa: E402

from ..session import scratch_path  # noqa: E402
from ..sources import readers as SR  # noqa: E402
from ..sources import writers as SW  # noqa: E402


def _write_splits(spark, sf, ext: str):
    base = scratch_path(spark, "splits")
    c = X.labelled_corpus(spark, sf).select("row_id", "text", "label", "split")
    paths = {}
    for split in ("train", "validation", "test"):
        p = os.path.join(base, f"{split}{ext}")
        SW.write_split_csv(c.where(F.col("split") == split).drop("split"), p, sep=SR.SEPARATORS[ext])
        paths[split] = p
    return paths


import os  # noqa: E402


@register("read_corpus_csv")
def q_read_corpus_csv(spark, sf):
    p = _write_splits(spark, sf, ".csv")
    c = SR.read_corpus_csv(spark, p["train"], p["validation"], p["test"], schema=SR.CORPUS_SCHEMA)
    return c.select("split", "row_id", "text", "label")


@register("write_split_csv")
def q_write_split_csv(spark, sf):
    base = scratch_path(spark, "split-csv")
    c = X.labelled_corpus(spark, sf).select("row_id", "text", "label", "split")
    SW.write_split_csv(c, base, partition_by="split")
    schema = TT.StructType(SR.CORPUS_SCHEMA.fields + [TT.StructField("split", TT.StringType())])
    return spark.read.options(**SR.CSV_OPTIONS).schema(schema).csv(base).select("split", "row_id", "text", "label")


@register("read_delimited")
def q_read_delimited(spark, sf):
    path = os.path.join(scratch_path(spark, "tsv"), "corpus.tsv")
    SW.write_split_csv(X.labelled_corpus(spark, sf).select("row_id", "text", "label"), path, sep="\t")
    return SR.read_delimited(spark, path, SR.CORPUS_SCHEMA)


@register("read_json_corpus")
def q_read_json_corpus(spark, sf):
    base = scratch_path(spark, "json-corpus")
    X.labelled_corpus(spark, sf).select("row_id", "text", "label").write.mode("overwrite").json(base)
    return SR.read_json_corpus(spark, base, type_split=1).select("split", "row_id", "text", "label")


@register("read_named_split")
def q_read_named_split(spark, sf):
    base = scratch_path(spark, "named-split")
    X.labelled_corpus(spark, sf).select("row_id", "label", "split").write.mode("overwrite") \
        .partitionBy("split").parquet(base)
    return SR.read_named_split(spark, base, "test").select("row_id", "label")


def _write_records(spark, sf):
    base = scratch_path(spark, "records")
    ev = M.evaluate_runs(X.binary_predictions(spark, sf), KEYS)
    SW.write_metric_json(ev, base, partition_by=("dataset", "experiment"))
    return base


@register("write_metric_json")
def q_write_metric_json(spark, sf):
    base = _write_records(spark, sf)
    recs = spark.read.schema(SR.RECORD_SCHEMA).json(base)
    return round_doubles(recs.select("dataset", "experiment", "macro_f1", "accuracy", "macro_avg_precision",
                                     "roc_auc", F.col("expected_calibration_error").alias("ece")))


@register("scan_result_records")
def q_scan_result_records(spark, sf):
    base = _write_records(spark, sf)
    s = SR.scan_result_records(spark, os.path.join(base, "*", "*", "*.json"), CLASS_NAMES)
    return round_doubles(s.withColumnRenamed("group", "dataset"))


@register("broken_result_records")
def q_broken_result_records(spark, sf):
    """Records as single files, those of one run cut in the middle: the run is reported, the others are read."""
    base = scratch_path(spark, "cut-records")
    ev = M.evaluate_runs(X.binary_predictions(spark, sf), KEYS)
    line = F.to_json(F.struct("macro_f1", "accuracy"))
    cut = F.when(F.col("experiment") == "e2", F.expr("left(value, length(value) div 2)")).otherwise(F.col("value"))
    ev.select(*KEYS, line.alias("value")).withColumn("value", cut).write.partitionBy(*KEYS).text(base)
    pattern = os.path.join(base, "*", "*", "*.txt")
    bad = SR.broken_result_records(spark, pattern).select("group", "experiment", "error", F.lit(None).cast("double").alias("macro_f1"))
    good = SR.scan_result_records(spark, pattern, CLASS_NAMES).select("group", "experiment", F.lit(None).cast("string").alias("error"), "macro_f1")
    return round_doubles(bad.unionByName(good).withColumnRenamed("group", "dataset"))


@register("file_order_ids")
def q_file_order_ids(spark, sf):
    """Split files in several parts and without ids: rows are numbered by split, file and line."""
    base = scratch_path(spark, "plain-splits")
    c = X.labelled_corpus(spark, sf).select("row_id", "text", "label", "split")
    paths = []
    for split, n in (("train", 5), ("validation", 2), ("test", 1)):
        paths.append(os.path.join(base, f"{split}.csv"))
        part = c.where(F.col("split") == split).repartitionByRange(n, "row_id").sortWithinPartitions("row_id")
        SW.write_split_csv(part.select("text", "label"), paths[-1])
    schema = TT.StructType([f for f in SR.CORPUS_SCHEMA if f.name != "row_id"])
    return SR.read_corpus_csv(spark, *paths, schema=schema).select("split", "row_id", "text", "label")


@register("write_submission_jsonl")
def q_write_submission_jsonl(spark, sf):
    base = scratch_path(spark, "submission")
    idx = C.add_row_index(X.binary_predictions(spark, sf).where(F.col("experiment") == "e3").select("row_id", "pred"))
    SW.write_submission_jsonl(idx, base, pred_col="pred")
    schema = TT.StructType([TT.StructField("index", TT.LongType()), TT.StructField("prediction", TT.IntegerType())])
    return spark.read.schema(schema).json(base)


@register("write_prediction_csv")
def q_write_prediction_csv(spark, sf):
    base = scratch_path(spark, "pred-csv")
    p = X.binary_predictions(spark, sf).where(F.col("experiment") == "e3")
    s = M.summary_metrics(p, ["experiment"]).select(
        F.col("macro_f1").alias("Macro_F1"), F.col("micro_f1").alias("Micro_F1"),
        F.col("accuracy").alias("Accuracy"), F.col("mcc").alias("MCC"))
    SW.write_prediction_csv(p, s, base)
    read = lambda name, schema: spark.read.options(**SR.CSV_OPTIONS).schema(schema).csv(os.path.join(base, name))
    cells = read("predictions", "`True` int, Prediction int").groupBy("True", "Prediction").agg(F.count(F.lit(1)).alias("n"))
    metrics = read("metrics", "Macro_F1 double, Micro_F1 double, Accuracy double, MCC double")
    return round_doubles(cells.unionByName(metrics, allowMissingColumns=True))


@register("write_result_tables")
def q_write_result_tables(spark, sf):
    base = scratch_path(spark, "result-tables")
    r = results_table(spark, sf)
    SW.write_result_tables(r, base, R.summary_table(r), R.detailed_table(r))
    tables = []
    for name, columns in (("all_results", r.columns), ("summary_results", R.summary_table(r).columns), ("detailed_results", R.detailed_table(r).columns)):
        t = spark.read.options(**SR.CSV_OPTIONS).schema(", ".join(f"`{c}` string" for c in columns)).csv(os.path.join(base, name))
        values = [c for c in columns if c not in KEYS]
        t = t.select(F.lit(name).alias("table"), *KEYS, *values).unpivot(["table", *KEYS], values, "column", "value")
        tables.append(t)
    raw = tables[0].withColumn("value", R.fmt(F.col("value").cast("double")))  # full doubles in the file, compared at 4 places
    return raw.unionByName(tables[1]).unionByName(tables[2])


# ---------------------------------------------------------------- §2.9 model-facing jobs

from ..operators import scoring as S  # noqa: E402


@register("score_batches")
def q_score_batches(spark, sf):
    c = X.unlabelled_corpus(spark, sf)
    s = S.score_batches(c, S.length_scorer_factory, id_cols=["row_id"])
    return s.select("row_id", "pred", r6(F.col("probs")[1]).alias("p1"))


@register("train_weighted_classifier")
def q_train_weighted_classifier(spark, sf):
    c = X.labelled_corpus(spark, sf).withColumn("text", T.clean_text("text"))
    model = S.train_weighted_classifier(c.where(F.col("split") == "train"))
    p = S.predict(model, c.where(F.col("split") == "test"), keep=["row_id", "label"]).withColumn("experiment", F.lit("tfidf_lr"))
    return round_doubles(M.summary_metrics(p, ["experiment"]).select("experiment", "accuracy", "macro_f1"))


@register("select_model")
def q_select_model(spark, sf):
    c = X.labelled_corpus(spark, sf).withColumn("text", T.clean_text("text"))
    part = lambda name: c.where(F.col("split") == name)
    _, table = S.select_model(part("train"), part("validation"), test=part("test"))
    return round_doubles(table)


@register("train_by_epochs")
def q_train_by_epochs(spark, sf):
    """Epoch table of two runs, with the best and the stopping epoch that the epoch operators read from it."""
    from ..operators.epochs import Config, train_by_epochs
    from ..operators.training import best_checkpoint, early_stop_epoch
    c = X.labelled_corpus(spark, sf).withColumn("text", T.clean_text("text"))
    part = lambda name: c.where(F.col("split") == name)
    _, epochs = train_by_epochs(part("train"), part("validation"), [Config("steady", 0.02), Config("fast", 0.1, 0.01)], epochs=4, batches=4)
    best = best_checkpoint(epochs).select("run", "best_epoch")
    stop = early_stop_epoch(epochs, patience=2).select("run", "stop_epoch")
    return round_doubles(epochs.drop("live").join(best, "run").join(stop, "run"))


# ---------------------------------------------------------------- §2.8 token ids

from ..operators import tokens as TK  # noqa: E402


# Fixed value: the sequence length of the reference.
MAX_LENGTH = 256


def _vocab(spark, sf):
    from ..functions.text import verbalize_label
    train = X.labelled_corpus(spark, sf).where(F.col("split") == "train")
    return TK.vocabulary(train.select(F.concat_ws(" ", "text", verbalize_label("label")).alias("text")))


@register("encode_tokens")
def q_encode_tokens(spark, sf):
    docs = X.unlabelled_corpus(spark, sf).select("row_id", "text")  # vocabulary from train, every document encoded
    ids = TK.token_ids(docs, _vocab(spark, sf), max_length=MAX_LENGTH)  # once, padded to either side
    right, mask = TK.padded("_ids", F.lit(MAX_LENGTH))
    left, _ = TK.padded("_ids", F.lit(MAX_LENGTH), "left")
    return ids.select("row_id", F.array_join(right, " ").alias("input_ids"), F.array_join(left, " ").alias("left_ids"),
                      F.aggregate(mask, F.lit(0), lambda a, x: a + x).alias("n_tokens"))


@register("corpus_vocabulary")
def q_corpus_vocabulary(spark, sf):
    """The vocabulary of all documents (``encode_tokens`` builds its own from the train split)."""
    return TK.vocabulary(X.table(spark, sf, "documents"))


@register("align_target_labels")
def q_align_target_labels(spark, sf):
    from ..functions.prompts import build_instruction_pairs
    test = build_instruction_pairs(X.labelled_corpus(spark, sf))
    enc = TK.encode_tokens(test.select("row_id", F.col("target_text").alias("text")), _vocab(spark, sf), max_length=8)
    return enc.select("row_id", F.array_join(TK.align_target_labels("input_ids", MAX_LENGTH), " ").alias("labels"))


# ---------------------------------------------------------------- §2.7 Python helpers, streaming

@register("emoji_to_text")
def q_emoji_to_text(spark, sf):
    from ..functions.emoji import emoji_to_text
    return X.posts(spark, sf).select("row_id", emoji_to_text("text", "words").alias("out"), emoji_to_text("text", "tokens").alias("out_tokens"))


@register("segment_hashtags")
def q_segment_hashtags(spark, sf):
    from ..operators.hashtags import segment_hashtags
    return segment_hashtags(X.posts(spark, sf)).select("row_id", "text")


@register("stream_clean_text")
def q_stream_clean_text(spark, sf):
    from ..streaming.text_stream import run_to_completion, start_text_job, text_stream
    schema = X.table(spark, sf, "documents").schema
    src = text_stream(spark, sf, schema, glob="documents.parquet")
    sink, ckpt = scratch_path(spark, "stream-sink"), scratch_path(spark, "stream-ckpt")
    row_id, out = F.col("doc_id").alias("row_id"), T.clean_text(F.col("text"))
    run_to_completion(start_text_job(src, {"out": out}, [row_id], sink, ckpt))
    return spark.read.schema(src.select(row_id, out.alias("out")).schema).parquet(sink)  # a table without files leaves an empty sink


# ---------------------------------------------------------------- workflow entry points

@register("load_data")
def q_load_data(spark, sf):
    from ..api import load_data
    p = _write_splits(spark, sf, ".csv")
    corpus, _ = load_data(spark, p["train"], p["validation"], p["test"], schema=SR.CORPUS_SCHEMA)
    return corpus


@register("load_synthetic")
def q_load_synthetic(spark, sf):
    from ..api import load_synthetic
    conv = X.table(spark, sf, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("row_id"), "text", "role")
    return load_synthetic(conv, "text", "role", "assistant").select("row_id", "text", "label", "split")


@register("prompted_classification")
def q_prompted_classification(spark, sf):
    """Zero-shot prompts over every labelled row -> one generation pass -> parsed
    answers and sliced next-token probabilities -> metrics per dataset."""
    from ..functions.prompts import format_prompt_zero
    test = X.labelled_corpus(spark, sf)
    prompts = test.select("row_id", "dataset", "label", format_prompt_zero(ZERO_TEMPLATE, "text").alias("prompt"))
    p = S.prompted_predictions(prompts, S.length_generator_factory, 2, id_cols=["row_id", "dataset", "label"])
    p = p.withColumn("experiment", F.lit("prompted"))
    cells = M.metric_cells(p, KEYS)
    summ = M.summary_metrics(p, KEYS, counts=M.counts_from_cells(cells, KEYS)).select(*KEYS, "accuracy", "macro_f1")
    auc = M.roc_auc_binary(p, KEYS)
    return round_doubles(summ.join(auc, KEYS, "left").join(M.ece(p, KEYS, cells=cells), KEYS, "left"))
