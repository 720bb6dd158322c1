"""Token ids of rows that share an id, length-grouped batches, the union of splits, own test splits, models per worker."""

import os
import random
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from textlab.operators import corpus as C
from textlab.operators import scoring as S
from textlab.operators.tokens import encode_tokens, token_ids, vocabulary


@pytest.mark.parametrize("frequent", [1 << 16, 3, 0])
def test_ids_of_rows_that_share_an_id(spark, frequent):
    """The same ids whether tokens are looked up in place or shuffled, and whatever the rows' own ids."""
    train = spark.createDataFrame([("a a a b b c d e " + "long" * 30,)], "text string")
    vocab = vocabulary(train)
    word = {r["token"]: r["id"] for r in vocab.collect()}
    rows = [(1, "a b c"), (1, "d e zz a"), (None, "b zz b"), (None, None), (2, ""), (2, "long" * 30 + " a a"), (3, "a b c")]
    df = spark.createDataFrame([(*r, 5, "t") for r in rows], "row_id long, text string, pos int, token string")
    got = sorted((str(r.row_id), str(r.text), list(r["_ids"])) for r in token_ids(df, vocab, max_length=3, frequent=frequent).collect())
    want = sorted((str(i), str(t), [word.get(w, 1) for w in (t or "").split()][:3]) for i, t in rows)
    assert got == want
    padded = encode_tokens(df, vocab, max_length=4).collect()
    assert len(padded) == len(rows) and all(len(r.input_ids) == 4 == len(r.attention_mask) for r in padded)
    assert token_ids(df.limit(0), vocab, frequent=frequent).count() == 0


def test_a_hot_rare_token(spark):
    df = spark.createDataFrame([(i, "rare " * 50 + f"w{i % 7}") for i in range(200)], "row_id long, text string")
    vocab = vocabulary(df)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    got = token_ids(df, vocab, frequent=0).collect()
    assert all(r["_ids"] == [ids["rare"]] * 50 + [ids[f"w{r.row_id % 7}"]] for r in got) and len(got) == 200


def grouped(rows, batch_size, mega, spark):
    df = spark.createDataFrame(rows, "row_id long, n long")
    return {r.row_id: (r.batch, r.place) for r in C.length_grouped_batches(df, "n", batch_size, mega=mega).collect()}


def test_length_grouped_batches(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([None, 5, 10, rng.randrange(1000)])) for i in range(517)]
    got = grouped(rows, 4, 10, spark)
    assert sorted(p for _, p in got.values()) == list(range(517)) and all(b == p // 4 for b, p in got.values())
    by_place = sorted(rows, key=lambda r: got[r[0]][1])
    lengths = [n or 0 for _, n in by_place]
    assert lengths[0] == max(lengths)
    swapped = 0
    for at in range(0, 517, 40):
        part = lengths[at:at + 40]
        swapped += part[1:] != sorted(part[1:], reverse=True) or part[0] < part[1]
    assert swapped <= 1  # the mega-batch that gave its longest row away
    assert got == grouped(rows[::-1], 4, 10, spark)
    assert [r[0] for r in by_place[:20]] != sorted(r[0] for r in by_place[:20])
    assert grouped([], 4, 10, spark) == {}


def test_padding_share(spark):
    df = spark.createDataFrame([(0, 4), (0, 2), (1, 5)], "batch long, n long")
    r = C.padding_share(df, "n").first()
    assert (r.tokens, r.padding) == (11, 2) and abs(r.share - 2 / 13) < 1e-12


def test_token_lengths_of_splits_and_their_union(spark):
    df = spark.createDataFrame([("train", "a b c"), ("train", "a"), ("test", "a b"), (None, None)], "split string, text string")
    got = {r.split: (r.max_tokens, r.min_tokens, r.mean_tokens, r.texts) for r in C.token_length_stats(df, by=["split"]).collect()}
    assert got == {"train": (3, 1, 2.0, 2), "test": (2, 2, 2.0, 1), None: (0, 0, 0.0, 1), "all": (3, 0, 1.5, 4)}
    assert C.token_length_stats(df).first().texts == 4


def test_own_test_split_stays(spark):
    df = spark.createDataFrame([(i, {0: True, 1: None}.get(i % 5, False)) for i in range(100)], "row_id long, mine boolean")
    got = {r.row_id: r.split for r in C.random_split(df, val_ratio=0.25, own_test=F.col("mine")).collect()}
    assert {i for i, s in got.items() if s == "test"} == {i for i in range(100) if i % 5 == 0}
    assert sum(s == "validation" for s in got.values()) == 20 and len(got) == 100


def test_one_load_per_worker(spark, tmp_path):
    """Two models over many tasks: each worker process builds each of them once, also for a second job that shares the name."""
    def factory(name, shift):
        folder = str(tmp_path)

        def build():
            open(os.path.join(folder, f"{name}-{os.getpid()}-{uuid.uuid4().hex}"), "w").close()
            return lambda texts: np.array([[0.0, len(t) + shift] for t in texts])
        return build

    df = spark.createDataFrame([(i, "x" * (i % 9)) for i in range(400)], "row_id long, text string").repartition(24)
    run = lambda name, shift: S.score_batches(df, factory(name, shift), model_name=f"{tmp_path}/{name}")
    one, two, again = run("one", 0.5), run("two", -0.5), run("one", 0.5)
    loads = [f.split("-")[:2] for f in os.listdir(tmp_path)]
    assert len(loads) == len({tuple(x) for x in loads}) and {x[0] for x in loads} == {"one", "two"}
    assert len(loads) < 24
    value = lambda d: {r.row_id: r.logits[1] for r in d.collect()}
    assert value(one) == value(again) == {i: i % 9 + 0.5 for i in range(400)} and value(two)[3] == 2.5


def test_oldest_model_is_released():
    closed = []

    class Model:
        def __init__(self, name):
            self.name = name

        def close(self):
            closed.append(self.name)

    keys = [uuid.uuid4().hex for _ in range(4)]
    for k in (keys[0], keys[1], keys[0], keys[2]):  # the second was used longest ago when the third comes
        S.worker_model(k, lambda k=k: Model(k), keep=2)
    assert closed[-1] == keys[1] and S.worker_model(keys[0], lambda: None).name == keys[0]
    S.worker_model(keys[3], lambda: Model(keys[3]), keep=1)
    assert set(closed[-3:]) >= {keys[0], keys[2]}


def test_shipped_file(spark, tmp_path):
    path = tmp_path / f"weights-{uuid.uuid4().hex}.txt"
    path.write_text("7")
    local = S.shipped_file(spark, str(path))

    def build():
        w = float(open(local()).read())
        return lambda texts: np.array([[0.0, w]] * len(texts))

    df = spark.createDataFrame([(1, "a"), (2, "b")], "row_id long, text string")
    assert {r.logits[1] for r in S.score_batches(df, build).collect()} == {7.0}
