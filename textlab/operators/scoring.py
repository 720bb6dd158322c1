"""Model-facing jobs: batch scoring with an injected scorer, a class-weighted
classifier trained with MLlib, and validation-based model selection.

The scorer is the only Python on the row path: Arrow batches go through
``mapInPandas`` (batch size = ``spark.sql.execution.arrow.maxRecordsPerBatch``),
the scorer is built once per worker process, and softmax / argmax run in the JVM.
"""

from __future__ import annotations

import os
import sys
import types
import uuid
from collections import OrderedDict
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.arrays import argmax_label, softmax

def _materialize(df: DataFrame) -> DataFrame:
    """Model output is the expensive part: write it once to the shared checkpoint
    folder so every downstream metric reads it instead of re-running the model."""
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


MODELS_KEPT = 2  # models that a worker process holds at once


def worker_model(key: str, factory: Callable, keep: int = MODELS_KEPT):
    """The model of ``key``, built once per worker process and used by all its tasks.

    ``key`` is made on the driver and travels with the task (an ``id()`` would differ between processes or be
    used again). The models live in a module of the worker's own, as functions that travel by value bring their
    own globals; the one used longest ago is released (its ``close()`` called, if any) before a further one is built."""
    store = sys.modules.setdefault("_worker_models", types.ModuleType("_worker_models"))
    models = store.__dict__.setdefault("models", OrderedDict())
    if key in models:
        models.move_to_end(key)
        return models[key]
    while len(models) >= keep:
        _, old = models.popitem(last=False)
        close = getattr(old, "close", None)
        if close:
            close()
        del old
    models[key] = factory()
    return models[key]


def model_key(name: str | None = None) -> str:
    """The key of a model: ``name`` (say a path and version) to share it between jobs, else one of its own."""
    return name or uuid.uuid4().hex


def shipped_file(spark, path: str) -> Callable[[], str]:
    """Sends a weights file to every node once; the returned function gives its local path inside a task."""
    from pyspark import SparkFiles
    spark.sparkContext.addFile(path)
    name = os.path.basename(path)
    return lambda: SparkFiles.get(name)


def score_batches(df: DataFrame, scorer_factory: Callable[[], Callable[[list[str]], np.ndarray]],
                  text_col: str = "text", id_cols: Sequence[str] = ("row_id",), materialize: bool = True,
                  model_name: str | None = None) -> DataFrame:
    """Apply ``scorer_factory()`` (text list -> [n, k] logits) to Arrow batches;
    adds ``logits``, ``probs`` (softmax) and ``pred`` (first argmax). The scorer is built once per worker
    process; calls that give the same ``model_name`` share it."""
    key = model_key(model_name)
    id_cols = list(id_cols)
    in_schema = df.select(*id_cols).schema
    out_schema = T.StructType(list(in_schema.fields) + [T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        score = worker_model(key, scorer_factory)
        for pdf in batches:
            texts = pdf[text_col].fillna("").astype(str).tolist()
            logits = np.asarray(score(texts), dtype=np.float64)
            out = pdf[id_cols].copy()
            out["logits"] = list(logits)
            yield out

    scored = df.select(*id_cols, text_col).mapInPandas(run, out_schema)
    if materialize:
        scored = _materialize(scored)
    return scored.withColumn("probs", softmax("logits")).withColumn("pred", argmax_label("probs"))


class LengthScorer:
    """Deterministic stand-in model: logits [0, (len(text) mod 11 - 5) / 2]."""

    def __call__(self, texts: list[str]) -> np.ndarray:
        n = np.fromiter((len(t) for t in texts), dtype=np.int64, count=len(texts))
        return np.stack([np.zeros(len(texts)), ((n % 11) - 5) / 2.0], axis=1)


def length_scorer_factory():
    return LengthScorer()


# ---------------------------------------------------------------- training

def featurize_stages(text_col: str = "text", num_features: int = 1 << 16):
    from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
    tok = RegexTokenizer(inputCol=text_col, outputCol="_tokens", pattern=r"[\p{L}\p{N}_]+", gaps=False,
                         toLowercase=True)
    tf = HashingTF(inputCol="_tokens", outputCol="_tf", numFeatures=num_features)
    idf = IDF(inputCol="_tf", outputCol="features")
    return [tok, tf, idf]


def with_class_weights(train: DataFrame, label_col: str = "label") -> DataFrame:
    """Attach balanced weights n / (k * n_c); the weight table has one row per class."""
    from .corpus import class_weights
    w = class_weights(train, label_col, "balanced").select(F.col("label").alias("_wl"), F.col("weight"))
    return train.join(w, F.col(label_col) == F.col("_wl")).drop("_wl")


def train_weighted_classifier(train: DataFrame, text_col: str = "text", label_col: str = "label",
                              reg_param: float = 0.0, max_iter: int = 20, num_features: int = 1 << 16):
    """Class-weighted TF-IDF + logistic regression pipeline (weighted cross-entropy)."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    lr = LogisticRegression(featuresCol="features", labelCol=label_col, weightCol="weight",
                            regParam=reg_param, maxIter=max_iter, family="multinomial")
    data = with_class_weights(train.withColumn(label_col, F.col(label_col).cast("double")), label_col)
    model = Pipeline(stages=featurize_stages(text_col, num_features) + [lr]).fit(data)
    return model


def predict(model, df: DataFrame, keep: Sequence[str] = ("row_id", "label")) -> DataFrame:
    """Predictions table: keep columns + ``pred`` and ``probs`` array."""
    from pyspark.ml.functions import vector_to_array
    out = model.transform(df)
    return out.select(*keep, F.col("prediction").cast("int").alias("pred"),
                      vector_to_array("probability").alias("probs"))


def select_model(train: DataFrame, validation: DataFrame, reg_params: Sequence[float] = (0.0, 0.01, 0.1),
                 text_col: str = "text", label_col: str = "label", max_iter: int = 10,
                 num_features: int = 1 << 14, test: DataFrame | None = None, learning_rate: float = 0.05,
                 halve_every: int | None = 4, folder: str | None = None):
    """Train one configuration per weight decay, score macro-F1 on validation, keep the best (first on ties)
    and score it on ``test``. All configurations share every pass over the data (``train_by_epochs``, ``max_iter``
    epochs); every ``halve_every`` epochs the worse half stops.
    Returns (best model, table of configs and scores; ``test_macro_f1`` is null but for the selected one)."""
    from .epochs import Config, train_by_epochs
    from .metrics import summary_metrics
    from .training import best_checkpoint
    configs = [Config(f"config{i:04d}", learning_rate, float(rp)) for i, rp in enumerate(reg_params)]
    models, epochs = train_by_epochs(train, validation, configs, epochs=max_iter, text_col=text_col, label_col=label_col,
                                     features=num_features, halve_every=halve_every, folder=folder)
    best = {r["run"]: r for r in best_checkpoint(epochs).collect()}  # one row per configuration
    rows = [(i, float(rp), float(best[c.run]["best_value"]), int(best[c.run]["best_epoch"]), int(best[c.run]["epochs"]))
            for i, (c, rp) in enumerate(zip(configs, reg_params))]
    chosen = max(range(len(rows)), key=lambda i: (rows[i][2], -i))
    spark = train.sparkSession
    table = spark.createDataFrame(rows, "config bigint, reg_param double, val_macro_f1 double, best_epoch bigint, epochs bigint")
    table = table.withColumn("selected", F.col("config") == F.lit(chosen))
    tested, model = None, models[configs[chosen].run]
    if test is not None:
        p = model.transform(test, keep=[F.col(label_col).cast("int").alias("label")])
        row = summary_metrics(p.withColumn("config", F.lit(chosen)), ["config"]).first()
        tested = row["macro_f1"] if row else None
    table = table.withColumn("test_macro_f1", F.when(F.col("selected"), F.lit(tested).cast("double")))
    return model, table


# ---------------------------------------------------------------- prompted classification

def generate_batches(df: DataFrame, generator_factory: Callable[[], Callable], prompt_col: str = "prompt",
                     id_cols: Sequence[str] = ("row_id",), materialize: bool = True, model_name: str | None = None) -> DataFrame:
    """One pass of an injected generator over Arrow batches of prompts:
    ``generator(list[str]) -> (list[str] answers, [n, V] next-token logits)``.
    Adds ``generated`` and ``logits``."""
    key = model_key(model_name)
    id_cols = list(id_cols)
    in_schema = df.select(*id_cols).schema
    out_schema = T.StructType(list(in_schema.fields) + [T.StructField("generated", T.StringType()),
                                                        T.StructField("logits", T.ArrayType(T.DoubleType()))])

    def run(batches):
        gen = worker_model(key, generator_factory)
        for pdf in batches:
            answers, logits = gen(pdf[prompt_col].fillna("").astype(str).tolist())
            out = pdf[id_cols].copy()
            out["generated"] = list(answers)
            out["logits"] = list(np.asarray(logits, dtype=np.float64))
            yield out

    out = df.select(*id_cols, prompt_col).mapInPandas(run, out_schema)
    return _materialize(out) if materialize else out


def prompted_predictions(df: DataFrame, generator_factory: Callable[[], Callable], num_classes: int,
                         label_names: Sequence[str] | None = None, prompt_col: str = "prompt",
                         id_cols: Sequence[str] = ("row_id",), renormalize: bool = False) -> DataFrame:
    """Prompted run in a single generation pass: ``pred`` parsed from the answer
    (``extract_label`` cascade), ``probs`` = softmax over the whole next-token
    vector, first ``num_classes`` entries (not re-normalised by default)."""
    from ..functions.answers import extract_label
    from ..functions.arrays import prob_slice
    g = generate_batches(df, generator_factory, prompt_col, id_cols)
    return (g.withColumn("pred", extract_label("generated", num_classes, label_names))
            .withColumn("probs", prob_slice(softmax("logits"), num_classes, renormalize)))


class LengthGenerator:
    """Deterministic stand-in generator: the answer names ``len(prompt) mod 3``;
    next-token logits are [len mod 5 / 2, len mod 7 / 3, len mod 11 / 4]."""

    def __call__(self, prompts: list[str]):
        n = np.fromiter((len(p) for p in prompts), dtype=np.int64, count=len(prompts))
        answers = [f"Classe: {int(x % 3)}" for x in n]
        logits = np.stack([(n % 5) / 2.0, (n % 7) / 3.0, (n % 11) / 4.0], axis=1)
        return answers, logits


def length_generator_factory():
    return LengthGenerator()
