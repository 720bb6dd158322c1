"""Corpus operators: dedup, exact splits, quotas, sampling, epochs."""
from pyspark.sql import functions as F

from textlab.operators import corpus as C
from textlab.operators import training as TR


def test_dedup_keeps_first_and_null_group(spark):
    rows = [(1, "train", "a"), (2, "train", "a"), (3, "train", None), (4, "train", None),
            (5, "test", "a"), (6, "test", "a"), (7, "validation", "a")]
    df = spark.createDataFrame(rows, "row_id long, split string, text string")
    kept = sorted(r.row_id for r in C.dedup_keep_first(df).collect())
    assert kept == [1, 3, 5, 6, 7]


def test_random_split_sizes(spark):
    df = spark.range(1, 1001).withColumnRenamed("id", "row_id")
    out = C.random_split(df)
    counts = {r.split: r["count"] for r in out.groupBy("split").count().collect()}
    assert counts == {"test": 250, "validation": 150, "train": 600}
    again = {r.row_id: r.split for r in C.random_split(df).collect()}
    assert again == {r.row_id: r.split for r in out.collect()}


def test_stratified_quotas_and_split(spark):
    assert C.stratified_quotas({0: 10, 1: 3}, 0.25) == {0: 3, 1: 1}
    df = spark.range(0, 400).select(F.col("id").alias("row_id"), (F.col("id") % 4 == 0).cast("int").alias("label"))
    out = C.stratified_split(df)
    c = {(r.label, r.split): r["count"] for r in out.groupBy("label", "split").count().collect()}
    assert c[(0, "test")] == 75 and c[(1, "test")] == 25


def test_few_shot_sample_caps_per_class(spark):
    df = spark.createDataFrame([(i, i % 2 if i < 10 else 0, f"t{i}") for i in range(20)], "row_id long, label int, text string")
    s = C.few_shot_sample(df, 3)
    assert {(r.label, r["count"]) for r in s.groupBy("label").count().collect()} == {(0, 3), (1, 3)}
    s = C.few_shot_sample(df.where("label = 1 or row_id < 2"), 8)
    assert {(r.label, r["count"]) for r in s.groupBy("label").count().collect()} == {(0, 1), (1, 5)}


def test_class_weights_sum(spark):
    df = spark.createDataFrame([(0,)] * 30 + [(1,)] * 10, "label int")
    w = {r.label: (r.weight, r.n_c) for r in C.class_weights(df).collect()}
    assert abs(sum(wt * n for wt, n in w.values()) - 40) < 1e-9
    assert abs(w[1][0] - 2.0) < 1e-12


def test_early_stop_and_best(spark):
    vals = [0.5, 0.6, 0.6, 0.55, 0.7, 0.1, 0.2, 0.3]
    df = spark.createDataFrame([("r", i + 1, v) for i, v in enumerate(vals)], "run string, epoch int, value double")
    assert TR.early_stop_epoch(df, patience=3).first().stop_epoch == 8
    assert TR.early_stop_epoch(df, patience=4).first().stop_epoch is None
    b = TR.best_checkpoint(df).first()
    assert (b.best_epoch, b.best_value) == (5, 0.7)
    ties = spark.createDataFrame([("r", 1, 0.6), ("r", 2, 0.6)], "run string, epoch int, value double")
    assert TR.best_checkpoint(ties).first().best_epoch == 1


def test_batches(spark):
    df = spark.range(0, 50).withColumnRenamed("id", "row_id")
    b = C.batch_assignment(df, 16)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [2, 16, 16, 16]


def test_exact_quantiles_match_percentile(spark):
    import random
    from textlab.operators.rank import exact_quantiles
    rnd = random.Random(3)
    rows = [(float(rnd.randint(0, 50)),) for _ in range(997)] + [(None,)] * 3
    df = spark.createDataFrame(rows, "v double")
    got = exact_quantiles(df, "v", [0.0, 0.1, 0.25, 0.5, 0.9, 1.0], n_buckets=7)
    want = df.agg(*[F.percentile("v", p) for p in [0.0, 0.1, 0.25, 0.5, 0.9, 1.0]]).first()
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))


def test_early_stop_matches_python_on_random_runs(spark):
    """Single-pass early stopping against a plain loop (nulls and ties included)."""
    import random

    from textlab.operators.training import early_stop_epoch

    def py_stop(vals, patience, sign):
        prev, last_imp = None, 0
        for e, v in enumerate(vals, 1):
            x = None if v is None else v * sign
            if prev is None or (x is not None and x > prev):
                last_imp = e
            if x is not None:
                prev = x if prev is None else max(prev, x)
            if e - last_imp >= patience:
                return e
        return None

    rnd = random.Random(5)
    runs = {r: [None if rnd.random() < 0.15 else float(rnd.randint(0, 6)) for _ in range(rnd.randint(1, 25))]
            for r in range(200)}
    df = spark.createDataFrame([(r, e, v) for r, vals in runs.items() for e, v in enumerate(vals, 1)],
                               "run int, epoch int, value double")
    for gib in (True, False):
        for pat in (1, 3):
            got = {r.run: (r.stop_epoch, r.epochs) for r in early_stop_epoch(df, patience=pat,
                                                                             greater_is_better=gib).collect()}
            want = {r: (py_stop(vals, pat, 1.0 if gib else -1.0), len(vals)) for r, vals in runs.items()}
            assert got == want


def test_table_profile_covers_every_column(spark):
    df = spark.createDataFrame([(1, "ab", None), (2, "ab", None), (4, "", 1.5), (None, None, None)], "n long, t string, x double")
    got = {r["column"]: r.asDict() for r in C.table_profile(df).collect()}
    assert got["n"]["count"] == 3 and got["n"]["nulls"] == 1 and got["n"]["p50"] == 2.0 and got["n"]["min_length"] is None
    assert got["t"] == {"column": "t", "count": 3, "nulls": 1, "distinct_values": 2, "top_count": 2, "mean_length": 4 / 3, "min_length": 0,
                        "max_length": 2, **dict.fromkeys(["mean", "stddev", "min", "p25", "p50", "p75", "max"])}
    assert got["x"]["count"] == 1 and got["x"]["stddev"] is None and got["x"]["top_count"] == 1
    assert {r["column"]: r["count"] for r in C.table_profile(df.where("false")).collect()} in ({}, {"n": 0, "t": 0, "x": 0})
