"""Hard negatives against a plain search over all pairs."""

import math
import random

import numpy as np
import pytest

from textlab.llm import hard_negatives as H

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, positives=5, negatives=10):
    good = []
    for vec_id, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        good.append((vec_id, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda pair: (-pair[0], pair[1] is None, pair[1] or 0)
    out = []
    for i, (vec_id, label, v) in enumerate(good):
        if vec_id is None or vec_id % 100:
            continue
        scored = [(dot(v, w), j, k, l) for k, (j, l, w) in enumerate(good)]
        pos = sorted([(s, j) for s, j, k, l in scored if l == label and k != i], key=order)[:positives]
        far = sorted([(s, j) for s, j, k, l in scored if l != label], key=order)
        for ps, pid in pos:
            kept = [(s, j) for s, j in far if 30 * ps <= 100 * s <= 90 * ps][:negatives]
            out += [(vec_id, pid, r, j, ps, s) for r, (s, j) in enumerate(kept, 1)]
    return sorted(out, key=str)


def run(spark, rows, **args):
    df = spark.createDataFrame([(*r, 7, "x") for r in rows], SCHEMA + ", block int, score string")
    got = H.hard_negatives(df, H.F.col("id") % 100 == 0, **args)
    return sorted([tuple(r)[:6] for r in got.collect()], key=str)


def made(n, d, seed, step=5):
    rng = random.Random(seed)
    return [(i * step, [rng.gauss(0, 0.3) * rng.choice([1, 1, 4]) for _ in range(d)], rng.randrange(4)) for i in range(n)]


def test_random_vectors(spark):
    rows = made(400, 6, 1)
    assert run(spark, rows) == brute(rows)


def test_small_blocks_rounds_and_buckets(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCKS", 2)
    monkeypatch.setattr(H, "BLOCK", 30)
    monkeypatch.setattr(H, "GROWTH", 2)
    monkeypatch.setattr(H, "BUCKET", 7)
    rows = made(350, 3, 2)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = made(150, 4, 3)
    rows += [(None, [0.5, 0.5, 0.1, 0.0], 1), (None, None, 1), (100, [1.0, 2.0], 2), (100, [1.0, 2.0], 2), (200, [], 3),
             (300, [None, 1.0, 1.0, 1.0], 0), (400, [float("nan"), 1.0, 1.0, 1.0], 0), (500, [float("inf")] * 4, 0),
             (600, [0.1, 0.2, 0.3, 0.4], None), (700, [0.0] * 4, 1), (-100, [0.9, 0.1, 0.2, 0.3], 0)]
    rows += [(7_000 + i, [0.5, 0.5, 0.5, 0.5], i % 2) for i in range(120)]  # one vector held by many rows: ties by id
    assert run(spark, rows) == brute(rows)


def test_huge_components(spark):
    rows = [(100 * i, [s * 3e38, 1e30 * i, 1.0], i % 2) for i, s in enumerate([1, -1, 0.5, 1, 0.25, 0.1])]
    assert all(abs(r[4]) <= 2 ** 63 for r in run(spark, rows))


def test_empty_and_lonely(spark):
    assert run(spark, []) == []
    assert run(spark, [(100, [1.0], 1)]) == []
    assert run(spark, [(100, [1.0], 1), (3, [2.0], 2)]) == []


@pytest.mark.parametrize("share", [0.2, 0.6, 0.95, 1.0])
def test_no_candidate_is_missed(share):
    rng = np.random.default_rng(4)
    v = np.floor(256 * rng.normal(size=(500, 5))).astype(np.int64)
    length = np.sqrt((v.astype(float) ** 2).sum(axis=1))
    bucket = H.Bucket(v, length)
    for q in v[:40]:
        scores, size = v @ q, float(np.sqrt(q @ q))
        least = share * scores.max()
        found = bucket.candidates(q, size, least)
        if found is not None:
            assert set(np.flatnonzero(scores >= least)) <= set(found.tolist())


def test_pruning_happens():
    rng = np.random.default_rng(5)
    v = np.floor(256 * rng.normal(size=(4000, 8))).astype(np.int64)
    bucket = H.Bucket(v, np.sqrt((v.astype(float) ** 2).sum(axis=1)))
    q = v[0]
    found = bucket.candidates(q, float(np.sqrt(q @ q)), 0.98 * float(np.sqrt(q @ q)) * bucket.longest)
    assert found is not None and len(found) < 400
