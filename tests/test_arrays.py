"""Softmax and its relatives: values, odd arrays, and work that grows with the array's length alone."""
import math
import time

import numpy as np
from pyspark.sql import functions as F

from textlab.functions.arrays import log_softmax_at, max_confidence, prob_slice, softmax


def test_odd_arrays(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0, 4.0]), (1, []), (2, None), (3, [1.0, None]), (4, [1000.0, 0.0])], "i int, a array<double>")
    got = {r.i: r for r in df.select("i", softmax("a").alias("p"), max_confidence(softmax("a")).alias("m"),
                                     prob_slice("a", 2, renormalize=True).alias("s")).collect()}
    e = [math.exp(x - 4.0) for x in (1.0, 2.0, 4.0)]
    assert got[0].p == [x / sum(e) for x in e] and got[0].m == 1.0 / sum(e) and got[0].s == [1 / 3, 2 / 3]
    assert got[1].p == [] and got[1].m is None and got[2].p is None and got[2].s is None
    assert got[3].p == [None, None] and got[4].p == [1.0, 0.0]


def test_long_arrays_take_time_in_proportion(spark):
    n = 3000
    a = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda x: F.sqrt(x.cast("double")))
    start = time.time()
    row = spark.range(4).select(softmax(a).alias("p"), log_softmax_at(a, F.lit(5)).alias("l"), prob_slice(a, n, renormalize=True).alias("s")).first()
    assert time.time() - start < 30
    x = np.sqrt(np.arange(1, n + 1))
    p = np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    assert np.allclose(row.p, p, rtol=1e-12) and abs(row.l - math.log(p[5])) < 1e-9 and np.allclose(row.s, x / x.sum(), rtol=1e-12)
