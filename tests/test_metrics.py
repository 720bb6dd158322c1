"""Golden confusion matrices against the published numbers, textbook cases,
and properties of the distributed ranking metrics."""
import itertools
import random

import pytest
from pyspark.sql import functions as F

from textlab.operators import metrics as M
from textlab.operators import rank as RK

# Derived confusion matrices (rows = true class) and the published
# macro-F1 / accuracy / F1(0) / F1(1) of the same runs.
GOLDEN = [
    ("set_a", "run_1", 786, 60, 63, 841, 0.9296, 0.9297, 0.9274, 0.9319),
    ("set_a", "run_2", 785, 61, 68, 836, 0.9262, 0.9263, 0.9241, 0.9284),
    ("set_a", "run_3", 773, 73, 79, 825, 0.9131, 0.9131, 0.9105, 0.9156),
    ("set_a", "run_4", 761, 85, 98, 806, 0.8954, 0.8954, 0.8927, 0.8981),
    ("set_a", "run_5", 552, 294, 127, 777, 0.7554, 0.7594, 0.7239, 0.7868),
    ("set_a", "run_6", 537, 309, 207, 697, 0.7027, 0.7051, 0.6755, 0.7298),
    ("set_a", "run_7", 407, 439, 158, 746, 0.6456, 0.6589, 0.5769, 0.7142),
    ("set_a", "run_8", 96, 750, 31, 873, 0.4441, 0.5537, 0.1973, 0.6909),
    ("set_b", "run_1", 120, 134, 117, 1367, 0.7024, 0.8556, 0.4888, 0.9159),
    ("set_b", "run_2", 135, 119, 160, 1324, 0.6982, 0.8395, 0.4918, 0.9047),
    ("set_b", "run_3", 117, 137, 129, 1355, 0.6893, 0.847, 0.468, 0.9106),
    ("set_b", "run_4", 95, 159, 311, 1173, 0.5605, 0.7296, 0.2879, 0.8331),
    ("set_b", "run_5", 35, 219, 111, 1373, 0.5339, 0.8101, 0.175, 0.8927),
    ("set_b", "run_6", 18, 236, 72, 1412, 0.5032, 0.8228, 0.1047, 0.9017),
    ("set_b", "run_7", 19, 235, 85, 1399, 0.5018, 0.8159, 0.1061, 0.8974),
    ("set_b", "run_8", 9, 245, 46, 1438, 0.4832, 0.8326, 0.0583, 0.9081),
    ("set_c", "run_1", 103, 151, 177, 1307, 0.6371, 0.8113, 0.3858, 0.8885),
    ("set_c", "run_2", 102, 152, 187, 1297, 0.6301, 0.8049, 0.3757, 0.8844),
    ("set_c", "run_3", 92, 162, 168, 1316, 0.6233, 0.8101, 0.358, 0.8886),
    ("set_c", "run_4", 93, 161, 209, 1275, 0.6039, 0.7871, 0.3345, 0.8733),
    ("set_c", "run_5", 92, 162, 231, 1253, 0.5917, 0.7739, 0.3189, 0.8644),
    ("set_c", "run_6", 95, 159, 311, 1173, 0.5605, 0.7296, 0.2879, 0.8331),
    ("set_c", "run_7", 64, 190, 214, 1270, 0.5517, 0.7675, 0.2406, 0.8628),
    ("set_c", "run_8", 19, 235, 85, 1399, 0.5018, 0.8159, 0.1061, 0.8974),
]


def expand(spark, rows):
    data = []
    for ds, exp, a, b, c, d, *_ in rows:
        for (t, p), n in zip([(0, 0), (0, 1), (1, 0), (1, 1)], [a, b, c, d]):
            data += [(ds, exp, t, p)] * n
    return spark.createDataFrame(data, "dataset string, experiment string, label int, pred int")


def test_golden_confusion(spark):
    df = expand(spark, GOLDEN)
    s = {(r.dataset, r.experiment): r for r in M.summary_metrics(df, ["dataset", "experiment"]).collect()}
    f1 = {(r.dataset, r.experiment, r.cls): r.f1 for r in M.per_class_report(df, ["dataset", "experiment"]).collect()}
    for ds, exp, *_cm, mf1, acc, f0, f1v in GOLDEN:
        r = s[(ds, exp)]
        assert round(r.macro_f1, 4) == mf1 and round(r.accuracy, 4) == acc
        assert round(f1[(ds, exp, 0)], 4) == f0 and round(f1[(ds, exp, 1)], 4) == f1v
        assert abs(r.micro_f1 - r.accuracy) < 1e-12


def binary_frame(spark, scores, labels, key="k"):
    rows = [(key, i, y, [1.0 - s, s]) for i, (s, y) in enumerate(zip(scores, labels))]
    return spark.createDataFrame(rows, "g string, row_id long, label int, probs array<double>")


def test_textbook_ap_auc(spark):
    df = binary_frame(spark, [0.1, 0.4, 0.35, 0.8], [0, 0, 1, 1])
    ap = {r.cls: r.average_precision for r in M.average_precision(df, ["g"]).collect()}
    assert abs(ap[1] - 0.8333333333) < 1e-9
    auc = M.roc_auc_binary(df, ["g"]).first().roc_auc
    assert abs(auc - 0.75) < 1e-12


def test_auc_equals_pair_count(spark):
    rnd = random.Random(7)
    scores = [rnd.choice([0.1, 0.2, 0.3, 0.5, 0.7, 0.9]) for _ in range(300)]
    labels = [rnd.randint(0, 1) for _ in range(300)]
    pos = [s for s, y in zip(scores, labels) if y == 1]
    neg = [s for s, y in zip(scores, labels) if y == 0]
    brute = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg)) / (len(pos) * len(neg))
    auc = M.roc_auc_binary(binary_frame(spark, scores, labels), ["g"]).first().roc_auc
    assert abs(auc - brute) < 1e-12


def test_ece_bins_and_argmax(spark):
    edges = M.bin_edges(10)
    assert edges[3] == 0.30000000000000004 and edges[6] == 0.6000000000000001 and edges[10] == 1.0
    df = spark.createDataFrame([(0.0,), (0.3,), (0.30000000000000004,), (0.6,), (1.0,)], "c double")
    assert [r[0] for r in df.select(M.bin_index("c")).collect()] == [None, 2, 2, 5, 9]
    from textlab.functions.arrays import argmax_label
    assert spark.createDataFrame([([0.5, 0.5],)], "p array<double>").select(argmax_label("p")).first()[0] == 0
    e = M.ece(binary_frame(spark, [0.9, 0.8, 0.2], [1, 0, 0]), ["g"]).first().ece
    # bins: 0.9 (hit), 0.8 (miss), conf 0.8 for 0.2 (hit) -> |0.8-0.5|*2/3 + |0.9-1|*1/3
    assert abs(e - (abs(0.8 - 0.5) * 2 / 3 + abs(0.9 - 1.0) / 3)) < 1e-12


def test_zero_division(spark):
    df = spark.createDataFrame([("g", 0, 0), ("g", 1, 0)], "g string, label int, pred int")
    r0 = {r.cls: r.precision for r in M.per_class_report(df, ["g"], 0.0).collect()}
    r1 = {r.cls: r.precision for r in M.per_class_report(df, ["g"], 1.0).collect()}
    assert r0[1] == 0.0 and r1[1] == 1.0


@pytest.mark.parametrize("n_buckets", [2, 5, 16])
def test_exact_rank_helpers_match_plain_windows(spark, n_buckets):
    from pyspark.sql import Window
    rnd = random.Random(n_buckets)
    rows = [(rnd.choice(["a", "b", "c"]), i, rnd.random(), rnd.randint(0, 3)) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, id long, v double, x long")
    got = RK.global_row_number(df, "v", [F.col("v"), F.col("id")], ["g"], n_buckets=n_buckets)
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    assert sorted(map(tuple, got.select("id", "rn").collect())) == sorted(map(tuple, want.select("id", "rn").collect()))
    cum = RK.running_sums(df, ["g"], "v", ["x"], descending=True, n_buckets=n_buckets)
    w = Window.partitionBy("g").orderBy(F.col("v").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ref = df.withColumn("c", F.sum("x").over(w))
    assert sorted(map(tuple, cum.select("id", "cum_x").collect())) == sorted(map(tuple, ref.select("id", "c").collect()))
    mx = RK.running_max(df, ["g"], "v", ["x"], exclusive=True, n_buckets=n_buckets)
    w2 = Window.partitionBy("g").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ref2 = df.withColumn("m", F.max("x").over(w2))
    assert sorted(map(tuple, mx.select("id", "runmax_x").collect()), key=repr) == \
        sorted(map(tuple, ref2.select("id", "m").collect()), key=repr)


def test_hot_group_is_spread_over_ranges(spark):
    """A group holding most rows is cut into balanced (group, range) windows."""
    df = spark.range(0, 20000).select(
        F.when(F.col("id") % 10 < 9, F.lit("hot")).otherwise(F.lit("cold")).alias("g"),
        F.xxhash64("id").alias("k"), F.col("id"))
    b = RK.range_buckets(df, "k", n_buckets=32)
    sizes = [r["count"] for r in b.where("g = 'hot'").groupBy(RK.BUCKET).count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 2 * 18000 / 32


def test_hash_key_ranges_need_no_sketch_and_stay_balanced(spark):
    """md5-prefix order keys are uniform: equal-width ranges hold equal shares of
    a hot class, and the exact stratified ranks match a plain window."""
    from pyspark.sql import Window

    from textlab.operators.corpus import stratified_split
    df = spark.range(0, 30000).select(F.col("id").alias("row_id"),
                                      F.when(F.col("id") % 3 == 0, 1).otherwise(0).alias("label"))
    h, prefix = RK.hash_order_key(42)
    x = df.withColumn("_hp", prefix)
    b = RK.range_buckets(x, "_hp", n_buckets=32, key_range=RK.HASH_KEY_RANGE)
    sizes = [r["count"] for r in b.where("label = 0").groupBy(RK.BUCKET).count().collect()]
    assert len(sizes) == 32 and max(sizes) <= 1.3 * 20000 / 32
    got = {r.row_id: r.split for r in stratified_split(df, 0.25).collect()}
    w = Window.partitionBy("label").orderBy(h, F.col("row_id"))
    ref = df.withColumn("rn", F.row_number().over(w)).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    quotas = {r.label: r.n for r in ref.collect()}
    plain = df.withColumn("rn", F.row_number().over(w)).collect()
    from textlab.operators.corpus import stratified_quotas
    q = stratified_quotas(quotas, 0.25)
    assert all(got[r.row_id] == ("test" if r.rn <= q[r.label] else "train") for r in plain)


def _py_metrics(rows, k):
    """Plain-Python record for one group: rows of (label, probs, pred)."""
    import numpy as np
    labels = [r[0] for r in rows]
    preds = [r[2] for r in rows]
    n = len(rows)
    classes = sorted(set(labels) | set(preds))
    f1s = []
    for c in classes:
        tp = sum(1 for y, p in zip(labels, preds) if y == c and p == c)
        sup, prd = labels.count(c), preds.count(c)
        f1s.append(2 * tp / (sup + prd) if sup + prd else 0.0)
    acc = sum(1 for y, p in zip(labels, preds) if y == p) / n
    edges = np.linspace(0, 1, 11)
    conf = [max(r[1]) for r in rows]
    hit = [int(r[1].index(max(r[1])) == r[0]) for r in rows]
    ece = 0.0
    for b in range(10):
        idx = [i for i, c in enumerate(conf) if edges[b] < c <= edges[b + 1]]
        if idx:
            ece += len(idx) / n * abs(sum(conf[i] for i in idx) / len(idx) - sum(hit[i] for i in idx) / len(idx))
    aps, aucs = [], []
    for c in range(k):
        s = [r[1][c] for r in rows]
        pos = [int(y == c) for y in labels]
        P, N = sum(pos), n - sum(pos)
        ap, prev_r = 0.0, 0.0
        if P:
            for t in sorted(set(s), reverse=True):
                tp = sum(p for x, p in zip(s, pos) if x >= t)
                fp = sum(1 - p for x, p in zip(s, pos) if x >= t)
                ap += (tp / P - prev_r) * tp / (tp + fp)
                prev_r = tp / P
        aps.append(ap)
        if P and N:
            w = sum((a > b) + 0.5 * (a == b) for a, pa in zip(s, pos) if pa for b, pb in zip(s, pos) if not pb)
            aucs.append(w / (P * N))
        else:
            aucs.append(None)
    auc = aucs[1] if k == 2 else (None if None in aucs else sum(aucs) / k)
    return dict(macro_f1=sum(f1s) / len(f1s), accuracy=acc, macro_avg_precision=sum(aps) / k,
                roc_auc=auc, expected_calibration_error=ece)


def test_evaluate_runs_matches_python_on_random_groups(spark):
    """40 random groups (binary and 3-class, tied scores, one-class groups) in
    one job, each record checked against plain-Python formulas."""
    import random

    rnd = random.Random(11)
    data, groups = [], {}
    for g in range(40):
        k = 2 if g % 2 == 0 else 3
        rows = []
        for i in range(rnd.randint(1, 30)):
            w = [rnd.randint(0, 4) for _ in range(k)]
            w = w if sum(w) else [1] * k
            probs = [x / sum(w) for x in w]
            label = 0 if g == 4 else rnd.randrange(k)  # group 4: one class only
            pred = probs.index(max(probs))
            rows.append((label, probs, pred))
            data.append((f"g{g:02d}", g * 100 + i, label, probs, pred))
        groups[f"g{g:02d}"] = (rows, k)
    df = spark.createDataFrame(data, "g string, row_id long, label int, probs array<double>, pred int")
    got = {r.g: r.asDict() for r in M.evaluate_runs(df, ["g"]).collect()}
    assert set(got) == set(groups)
    for g, (rows, k) in groups.items():
        want = _py_metrics(rows, k)
        for name, v in want.items():
            x = got[g][name]
            assert (x is None and v is None) or abs(x - v) < 1e-9, (g, name, x, v)
