"""Training by epochs: gradients, schedule, resume, many configurations a pass."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import epochs as E
from textlab.operators.training import best_checkpoint, early_stop_epoch


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(1)
    words = {0: ["bad", "awful", "poor", "sad"], 1: ["good", "fine", "nice", "glad"], 2: ["blue", "red", "green"]}
    rows = []
    for i in range(240):
        label = rng.choice([0, 0, 0, 1, 2])
        text = " ".join(rng.choice(words[label] + ["the", "a", "of"]) for _ in range(rng.randint(0, 8)))
        rows.append((i, text if i % 50 else None, label if i % 70 else None, "x"))
    df = spark.createDataFrame(rows, "row_id long, text string, label int, slot string")
    return df.where("row_id < 160").cache(), df.where("row_id >= 160").cache()


def plain(rows, w, idf, cw):
    """Loss and gradient by loops."""
    grad, loss, weight = np.zeros_like(w), 0.0, 0.0
    for label, feats in rows:
        x = np.zeros(w.shape[1])
        for f in feats:
            x[f] += idf[f]
        norm = math.sqrt(sum(idf[f] ** 2 for f in feats))
        x = x / norm if norm else x
        x[-1] = 1.0
        z = w @ x
        p = np.exp(z - z.max())
        p /= p.sum()
        loss -= cw[label] * math.log(p[label])
        p[label] -= 1
        grad += cw[label] * np.outer(p, x)
        weight += cw[label]
    return grad / weight, loss / weight


def test_gradient_equals_loops(spark, corpus):
    rows = E.encoded(corpus[0], "text", "label", 32, 7).cache()
    held = [(r["label"], r["feats"]) for r in rows.collect()]
    rng = np.random.default_rng(0)
    w, idf, cw = rng.normal(size=(2, 3, 33)), rng.random(32) + 0.1, np.array([0.5, 2.0, 1.0])
    grad, loss, weight = E.gradients(rows, w, [0, 1], idf, cw)
    for i in range(2):
        want, want_loss = plain(held, w[i], idf, cw)
        assert np.allclose(grad[i], want, atol=1e-7) and abs(loss[i] - want_loss) < 1e-7
    assert abs(weight - sum(cw[label] for label, _ in held)) < 1e-5
    only, _, _ = E.gradients(rows, w, [1], idf, cw)
    assert np.array_equal(only[0], grad[1])


def test_learns_and_feeds_the_epoch_operators(corpus):
    models, table = E.train_by_epochs(*corpus, [E.Config("one", 0.1)], epochs=4, batches=2, features=256)
    rows = table.orderBy("epoch").collect()
    assert [r["epoch"] for r in rows] == [1, 2, 3, 4] and rows[-1]["train_loss"] < rows[0]["train_loss"]
    best = best_checkpoint(table).first()
    assert best["best_value"] == max(r["value"] for r in rows) > 0.8
    assert early_stop_epoch(table, patience=2).count() == 1
    got = models["one"].transform(corpus[1].where("label IS NOT NULL AND length(text) > 20"))
    assert got.where("pred = label").count() / got.count() > 0.9
    assert got.select(F.max(F.abs(F.aggregate("probs", F.lit(0.0), lambda a, b: a + b) - 1))).first()[0] < 1e-9


def test_resume_gives_the_same_weights(spark, corpus, tmp_path):
    configs = [E.Config("a", 0.05), E.Config("b", 0.1, 0.01)]
    args = dict(batches=2, features=64, epochs=4)
    whole, table = E.train_by_epochs(*corpus, configs, folder=str(tmp_path / "whole"), **args)
    lost, calls = E.save_state, []

    def dies(spark_, folder, state):
        if state.epoch == 3:
            raise RuntimeError("driver lost")
        calls.append(state.epoch)
        lost(spark_, folder, state)

    E.save_state = dies
    try:
        with pytest.raises(RuntimeError):
            E.train_by_epochs(*corpus, configs, folder=str(tmp_path / "cut"), **args)
    finally:
        E.save_state = lost
    again, table2 = E.train_by_epochs(*corpus, configs, folder=str(tmp_path / "cut"), **args)
    assert calls == [1, 2]
    assert sorted(map(tuple, table.collect())) == sorted(map(tuple, table2.collect()))
    for name in whole:
        assert np.array_equal(whole[name].weights, again[name].weights)


def test_many_configurations_equal_single_fits_in_as_many_passes(corpus, monkeypatch):
    passes = []
    real = E.gradients
    monkeypatch.setattr(E, "gradients", lambda *a: passes.append(len(a[2])) or real(*a))
    configs = [E.Config(f"c{i}", r, d) for i, (r, d) in enumerate([(0.1, 0.0), (0.02, 0.1), (0.05, 0.01)])]
    args = dict(epochs=2, batches=2, features=64)
    _, together = E.train_by_epochs(*corpus, configs, **args)
    assert passes == [3] * 4
    alone = [tuple(r) for c in configs for r in E.train_by_epochs(*corpus, [c], **args)[1].collect()]
    assert sorted(map(tuple, together.collect())) == sorted(alone)


def test_halving_and_patience(corpus):
    configs = [E.Config(f"c{i}", r) for i, r in enumerate([0.1, 1e-6, 0.05, 1e-7])]
    _, table = E.train_by_epochs(*corpus, configs, epochs=4, batches=1, features=64, halve_every=1)
    last = {r["run"]: r["e"] for r in table.groupBy("run").agg(F.max("epoch").alias("e")).collect()}
    assert sorted(last.values()) == [1, 1, 2, 4]
    _, table = E.train_by_epochs(*corpus, [E.Config("still", 0.0)], epochs=6, batches=1, features=64, patience=2)
    assert table.agg(F.max("epoch")).first()[0] == 3  # no epoch beats the first


def test_schedule_and_order():
    rates = [E.learning_rate(1.0, s, 20, 0.1) for s in range(20)]
    assert rates[0] == 0.5 and rates[1] == 1.0 and rates[2] == 1.0 and rates[-1] == pytest.approx(1 / 18)
    dealt = E.batch_slots(3, 5, 42)
    assert sorted(s for b in dealt for s in b) == list(range(E.SLOTS)) and dealt == E.batch_slots(3, 5, 42) != E.batch_slots(4, 5, 42)


def test_empty_training_is_refused(spark, corpus):
    with pytest.raises(ValueError):
        E.train_by_epochs(corpus[0].limit(0), corpus[1], [E.Config("x")], epochs=1)
