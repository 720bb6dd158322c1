"""Training by epochs: a class-weighted linear text classifier, many configurations in one pass.

The corpus is tokenized once into rows (label, hashed token ids, slot) in a state
folder. An epoch deals the slots to mini-batches in a seeded order, and a mini-batch
is one Spark job that reads only its slots: every task adds up the gradients of all
live configurations, a partial aggregate adds the tasks, and the driver (which holds
``features x classes x configurations`` numbers, whatever the corpus) takes one AdamW
step with warm-up and linear decay. Sums are fixed-point, so their order does not show.

After each epoch one pass scores the validation rows of all configurations; the best
epoch of each is kept. The state of every epoch is a Parquet folder beside the rows,
so a run that was lost goes on from its last whole epoch and ends with the same weights.
Configurations that fall behind can be stopped by successive halving, and all stop
after ``patience`` epochs without a better value.

A text is the sum of its tokens' idf, scaled by the root of their squares; a text
without tokens has only the bias. Rows without a label are left out; null texts are empty.
"""

from __future__ import annotations

import os
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from .metrics import summary_metrics
from .tokens import tokens

SLOTS = 64  # parts of the corpus that mini-batches are made of
UNIT = 2.0 ** 28  # gradients and losses are added as whole multiples of 1/UNIT: exact in any order of rows and tasks
BETA1, BETA2, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Config:
    """One run: its name, peak learning rate and weight decay."""
    run: str
    learning_rate: float = 0.05
    weight_decay: float = 0.0


@dataclass
class State:
    """Weights (configs, classes, features + bias) and moments after ``epoch`` epochs, and the best so far."""
    epoch: int
    step: int
    weights: np.ndarray
    first: np.ndarray
    second: np.ndarray
    best: np.ndarray
    best_value: list[float]
    best_epoch: list[int]
    live: list[bool]
    history: list[dict] = field(default_factory=list)


# ------------------------------------------------------------------------ rows

def encoded(df: DataFrame, text_col: str, label_col: str, features: int, seed: int) -> DataFrame:
    """(label, feats, slot): hashed token ids with repeats, and a random part of the corpus."""
    feats = F.transform(tokens(text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(features)).cast("int"))
    return (df.where(F.col(label_col).isNotNull())
            .select(F.col(label_col).cast("int").alias("label"), feats.alias("feats"), F.monotonically_increasing_id().alias("_row"))
            .withColumn("slot", F.pmod(F.xxhash64(F.lit(seed), "_row"), F.lit(SLOTS)).cast("int")).drop("_row"))


class Rows:
    """Arrays of one Arrow batch: labels, flat token ids, and the row of each token."""

    def __init__(self, batch: pa.RecordBatch, idf: np.ndarray):
        self.label = batch.column("label").to_numpy()
        lists = batch.column("feats")
        sizes = np.asarray(lists.value_lengths()).astype(np.int64)
        self.flat = lists.flatten().to_numpy().astype(np.int64)
        self.row = np.repeat(np.arange(len(sizes)), sizes)
        self.idf = idf[self.flat]
        square = np.bincount(self.row, self.idf ** 2, len(sizes))
        self.scale = np.divide(1.0, np.sqrt(square), out=np.zeros(len(sizes)), where=square > 0)

    def logits(self, w: np.ndarray) -> np.ndarray:
        """(rows, classes) of one configuration's weights (classes, features + bias)."""
        n = len(self.label)
        return np.stack([np.bincount(self.row, self.idf * c[self.flat], n) * self.scale + c[-1] for c in w], axis=1)

    def loss_and_error(self, w: np.ndarray, class_weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weighted cross-entropy of each row, and its derivative by the logits."""
        z = self.logits(w)
        z -= z.max(axis=1, keepdims=True)
        log_p = z - np.log(np.exp(z).sum(axis=1, keepdims=True))
        at, weight = np.arange(len(z)), class_weight[self.label]
        error = np.exp(log_p)
        error[at, self.label] -= 1.0
        return -log_p[at, self.label] * weight, error * weight[:, None]

    def gradient(self, error: np.ndarray, size: int) -> np.ndarray:
        """(classes, features + bias) in units."""
        return np.stack([np.append(np.bincount(self.flat, np.rint(self.idf * (e * self.scale)[self.row] * UNIT), size - 1), np.rint(e * UNIT).sum())
                         for e in error.T])


def gradients(rows: DataFrame, weights: np.ndarray, live: Sequence[int], idf: np.ndarray, class_weight: np.ndarray):
    """Weighted mean gradient and loss of the live configurations over ``rows``: one pass, partial sums per task.

    The weights are a Spark broadcast of ``features x classes x configurations`` doubles, a size set by parameters."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast((weights[list(live)], idf, class_weight))
    size = weights.shape[2]

    def run(batches):
        w, idf_, cw = shared.value
        total, loss, weight = np.zeros(w.shape, np.int64), np.zeros(len(w), np.int64), 0
        for batch in batches:
            part = Rows(batch, idf_)
            weight += int(np.rint(cw[part.label] * UNIT).sum())
            for i, one in enumerate(w):
                losses, error = part.loss_and_error(one, cw)
                loss[i] += int(np.rint(losses * UNIT).sum())
                total[i] += part.gradient(error, size).astype(np.int64)
        flat = total.ravel()
        at = np.flatnonzero(flat)
        where = np.concatenate([at, -2 - np.arange(len(w)), [-1]])
        yield pa.RecordBatch.from_arrays([pa.array(where), pa.array(np.concatenate([flat[at], loss, [weight]]))], ["at", "g"])

    summed = (rows.select("label", "feats").mapInArrow(run, "at bigint, g bigint")
              .groupBy("at").agg((F.sum(F.col("g").cast("decimal(20,0)")).cast("double") / UNIT).alias("g")).toPandas())
    shared.unpersist()
    at, g = summed["at"].to_numpy(), summed["g"].to_numpy()
    grad, loss = np.zeros(weights[list(live)].size), np.zeros(len(live))
    grad[at[at >= 0]] = g[at >= 0]
    weight = float(g[at == -1].sum())
    loss[-2 - at[at <= -2]] = g[at <= -2]
    return grad.reshape(weights[list(live)].shape) / max(weight, 1e-300), loss / max(weight, 1e-300), weight


def scored(rows: DataFrame, weights: np.ndarray, names: Sequence[str], live: Sequence[int], idf: np.ndarray, class_weight: np.ndarray) -> dict:
    """run -> (macro-F1, weighted loss) over encoded rows, all configurations in one pass."""
    shared = rows.sparkSession.sparkContext.broadcast((weights[list(live)], idf, class_weight))
    named = [names[i] for i in live]

    def run(batches):
        w, idf_, cw = shared.value
        cells: dict = {}
        for batch in batches:
            part = Rows(batch, idf_)
            inside = part.label < len(cw)  # a label that training never saw has no loss
            for name, one in zip(named, w):
                pred = part.logits(one).argmax(axis=1)
                losses = np.zeros(len(pred))
                if inside.all():
                    losses = np.rint(part.loss_and_error(one, cw)[0] * UNIT)
                pairs, back, n = np.unique(np.stack([part.label, pred], axis=1), axis=0, return_inverse=True, return_counts=True)
                lost = np.bincount(back.ravel(), losses, len(pairs))
                for (label, p), c, x in zip(pairs.tolist(), n.tolist(), lost.tolist()):
                    held = cells.setdefault((name, label, p), [0, 0])
                    held[0] += c
                    held[1] += int(x)
        rows_ = [(*k, *v) for k, v in cells.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows_], t) for i, t in enumerate(
            (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64()))], ["run", "label", "pred", "n", "loss"])

    cells = (rows.select("label", "feats").mapInArrow(run, "run string, label int, pred int, n bigint, loss bigint")
             .groupBy("run", "label", "pred").agg(F.sum("n").alias("n"), F.sum(F.col("loss").cast("decimal(20,0)")).alias("loss")))
    cells = cells.checkpoint(eager=True)  # classes x classes x runs rows
    f1 = {r["run"]: r["macro_f1"] for r in summary_metrics(None, ["run"], counts=cells.drop("loss")).collect()}
    weight = F.element_at(F.array(*[F.lit(float(x)) for x in class_weight]), F.least(F.col("label") + 1, F.lit(len(class_weight))))
    loss = {r["run"]: r["v"] for r in cells.groupBy("run").agg((F.sum("loss").cast("double") / UNIT / F.sum(weight * F.col("n"))).alias("v")).collect()}
    shared.unpersist()
    return {n: (f1.get(n, 0.0), loss.get(n, 0.0)) for n in named}


# ----------------------------------------------------------------------- state

def save_state(spark: SparkSession, folder: str, state: State) -> None:
    """One Parquet folder per epoch; a folder appears only when it is whole."""
    def raw(x: np.ndarray, i: int) -> bytearray:
        return bytearray(np.ascontiguousarray(x[i], np.float64).tobytes())

    rows = [(i, state.epoch, state.step, raw(state.weights, i), raw(state.first, i), raw(state.second, i), raw(state.best, i),
             float(state.best_value[i]), int(state.best_epoch[i]), bool(state.live[i])) for i in range(len(state.live))]
    spark.createDataFrame(rows, "config int, epoch int, step int, weights binary, first binary, second binary, best binary, "
                                "best_value double, best_epoch int, live boolean").write.mode("overwrite").parquet(f"{folder}/weights/{state.epoch}")
    spark.createDataFrame(state.history, HISTORY).coalesce(1).write.mode("overwrite").parquet(f"{folder}/epochs/{state.epoch}")


HISTORY = "run string, epoch int, value double, loss double, train_loss double, live boolean"


def load_state(spark: SparkSession, folder: str, shape: tuple, epochs: int) -> State | None:
    """The last whole epoch in the folder, at most ``epochs``."""
    for epoch in range(epochs, 0, -1):
        try:
            history = [r.asDict() for r in spark.read.schema(HISTORY).parquet(f"{folder}/epochs/{epoch}").collect()]
            rows = sorted(spark.read.parquet(f"{folder}/weights/{epoch}").collect(), key=lambda r: r["config"])
        except AnalysisException:  # this epoch was not reached
            continue
        if len(rows) != shape[0]:
            raise ValueError(f"{folder} holds a run of {len(rows)} configurations, not {shape[0]}")
        get = lambda c: np.stack([np.frombuffer(bytes(r[c]), np.float64).reshape(shape[1:]) for r in rows])
        return State(epoch, rows[0]["step"], get("weights"), get("first"), get("second"), get("best"), [r["best_value"] for r in rows],
                     [r["best_epoch"] for r in rows], [r["live"] for r in rows], history)
    return None


# -------------------------------------------------------------------- training

def batch_slots(epoch: int, batches: int, seed: int) -> list[list[int]]:
    """The epoch's seeded order of slots, dealt to its mini-batches."""
    order = np.random.default_rng([seed, epoch]).permutation(SLOTS).tolist()
    return [order[i::batches] for i in range(batches)]


def learning_rate(peak: float, step: int, steps: int, warmup: float) -> float:
    """Linear warm-up over the first share of the steps, then linear to zero."""
    rise = int(np.ceil(warmup * steps))
    return peak * (step + 1) / rise if step < rise else peak * max(steps - step, 0) / max(steps - rise, 1)


def adamw(state: State, at: int, grad: np.ndarray, rate: float, decay: float) -> None:
    m, v, w = state.first[at], state.second[at], state.weights[at]
    m += (1 - BETA1) * (grad - m)
    v += (1 - BETA2) * (grad ** 2 - v)
    t = state.step + 1
    w -= rate * (m / (1 - BETA1 ** t) / (np.sqrt(v / (1 - BETA2 ** t)) + EPSILON) + decay * w)


class EpochModel:
    """The best epoch's weights; ``transform`` adds ``pred`` and ``probs``."""

    def __init__(self, run: str, weights: np.ndarray, idf: np.ndarray, text_col: str):
        self.run, self.weights, self.idf, self.text_col = run, weights, idf, text_col

    def transform(self, df: DataFrame, keep: Sequence = ("row_id", "label")) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast((self.weights, self.idf))
        rows = df.select(*keep, F.transform(tokens(self.text_col), lambda t: F.pmod(F.xxhash64(t), F.lit(len(self.idf))).cast("int")).alias("feats"))
        kept = rows.drop("feats").schema
        columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept]

        def run(batches):
            w, idf = shared.value
            for batch in batches:
                part = Rows(pa.RecordBatch.from_arrays([pa.array(np.zeros(len(batch), np.int32)), batch.column("feats")], ["label", "feats"]), idf)
                z = part.logits(w)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns[:-1], pa.array(p.argmax(axis=1).astype(np.int32)), pa.array(p.tolist(), pa.list_(pa.float64()))],
                    [*batch.schema.names[:-1], "pred", "probs"])

        return rows.mapInArrow(run, ", ".join([*columns, "pred int", "probs array<double>"]))


def train_by_epochs(train: DataFrame, validation: DataFrame, configs: Sequence[Config], epochs: int = 5, batches: int = 8,
                    text_col: str = "text", label_col: str = "label", features: int = 1 << 14, warmup: float = 0.1, seed: int = 42,
                    class_weighted: bool = True, patience: int | None = None, halve_every: int | None = None,
                    folder: str | None = None) -> tuple[dict[str, EpochModel], DataFrame]:
    """Models of all runs (their best epochs) and the epoch table: run, epoch, value (validation macro-F1),
    loss, train_loss, live. ``folder`` (shared; a fresh one without it) holds rows and states; a second call with the
    same folder goes on where the first ended. ``halve_every`` epochs, the worse half of the live runs stops."""
    spark = train.sparkSession
    folder = folder or scratch_path(spark, "epochs")
    for name, df in (("train", train), ("validation", validation)):
        path = os.path.join(folder, "rows", name)
        try:
            spark.read.parquet(path)
        except AnalysisException:  # first call; slots become folders that a mini-batch's scan is pruned to
            encoded(df, text_col, label_col, features, seed).repartition("slot").write.mode("overwrite").partitionBy("slot").parquet(path)
    rows, check = (spark.read.schema("label int, feats array<int>, slot int").parquet(os.path.join(folder, "rows", n)) for n in ("train", "validation"))

    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row per class
    if not counts or min(counts) < 0:
        raise ValueError("training needs rows with class ids from 0 on")
    classes, n = max(counts) + 1, sum(counts.values())
    class_weight = np.array([n / (len(counts) * counts[c]) if class_weighted and c in counts else 1.0 for c in range(classes)])
    seen = rows.select(F.explode(F.array_distinct("feats")).alias("f")).groupBy("f").agg(F.count(F.lit(1)).alias("n")).toPandas()  # one row per feature
    idf = np.full(features, np.log(n + 1.0))
    idf[seen["f"].to_numpy()] = np.log((n + 1.0) / (seen["n"].to_numpy() + 1.0))

    shape = (len(configs), classes, features + 1)
    names = [c.run for c in configs]
    zeros = lambda: np.zeros(shape)
    state = load_state(spark, folder, shape, epochs) or State(0, 0, zeros(), zeros(), zeros(), zeros(), [-1.0] * len(configs), [0] * len(configs), [True] * len(configs))
    steps = epochs * batches
    while state.epoch < epochs and any(state.live):
        live = [i for i, on in enumerate(state.live) if on]
        losses, weights = np.zeros(len(live)), 0.0
        for slots in batch_slots(state.epoch, batches, seed):
            grad, loss, weight = gradients(rows.where(F.col("slot").isin(slots)), state.weights, live, idf, class_weight)
            if weight:  # a batch may be empty
                for at, g in zip(live, grad):
                    adamw(state, at, g, learning_rate(configs[at].learning_rate, state.step, steps, warmup), configs[at].weight_decay)
                losses, weights = losses + loss * weight, weights + weight
            state.step += 1
        state.epoch += 1
        told = scored(check, state.weights, names, live, idf, class_weight)
        for i, at in enumerate(live):
            value, loss = told[names[at]]
            if value > state.best_value[at]:
                state.best_value[at], state.best_epoch[at] = value, state.epoch
                state.best[at] = state.weights[at]
            if patience is not None and state.epoch - state.best_epoch[at] >= patience:
                state.live[at] = False
            state.history.append({"run": names[at], "epoch": state.epoch, "value": float(value), "loss": float(loss),
                                  "train_loss": float(losses[i] / max(weights, 1e-300)), "live": True})
        if halve_every and state.epoch % halve_every == 0 and state.epoch < epochs:
            order = sorted((i for i in live if state.live[i]), key=lambda i: (-state.best_value[i], i))
            for i in order[(len(order) + 1) // 2:]:
                state.live[i] = False
        for row in state.history[-len(live):]:
            row["live"] = state.live[names.index(row["run"])]
        save_state(spark, folder, state)
    models = {c.run: EpochModel(c.run, state.best[i], idf, text_col) for i, c in enumerate(configs)}
    return models, spark.createDataFrame(state.history, HISTORY)
