"""SimHash components against brute force over all pairs."""
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.simhash import anchors, compared, components, fingerprint, forest, links, replicas, simhash_components

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("fp", T.StringType()), T.StructField("root", T.IntegerType())])


def brute_fingerprint(text):
    lower = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lower)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(values, most=4):
    root = list(range(len(values)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i
    for i in range(len(values)):
        for j in range(i):
            if (values[i] ^ values[j]).bit_count() <= most:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(len(values))]


def test_fingerprint_matches_brute_force(spark):
    texts = ["", " \n", "one", "a b c", "A b C d", "a b c d e f a b c d", "É é straße ABC x y", "w " * 9000, "a\x0bb\x0cc\rd\te"]
    for t in texts:
        assert fingerprint(t.encode()) & (2**64 - 1) == brute_fingerprint(t), t[:30]
    row = spark.sql("SELECT xxhash64('a b c d') AS h").first()  # the same hash as the built-in function
    assert fingerprint(b"a b c d") == row.h


def test_anchors_are_all_code_words_within_two_bits():
    def syndrome(v):
        s = 0
        for i in range(1, 32):
            if v >> (i - 1) & 1:
                s ^= i
        return s
    rng = random.Random(4)
    for v in [0, 2**32 - 1, *(rng.getrandbits(32) for _ in range(6))]:
        flips = [0, *(1 << i for i in range(32)), *((1 << i) | (1 << j) for i in range(32) for j in range(i))]
        want = sorted(v ^ f for f in flips if not syndrome((v ^ f) & 0x7FFFFFFF))
        got = anchors(np.array([v], np.uint64))[1].tolist()
        assert set(got) <= set(want) and len(got) == len(set(got))
        # of the words at two bits over the top bit only the nearest code word is needed
        assert sorted(got) == want, (v, len(got), len(want))


def test_every_pair_within_the_bits_shares_an_anchor():
    rng = random.Random(6)
    for _ in range(800):
        x = rng.getrandbits(64)
        y = x
        for b in rng.sample(range(64), rng.randint(1, 4)):
            y ^= 1 << b
        shared = False
        for shift in (0, 32):
            of = [set(anchors(np.array([v >> shift & 0xFFFFFFFF], np.uint64))[1].tolist()) for v in (x, y)]
            shared |= bool(of[0] & of[1])
        assert shared


def test_forest_links_whole_components():
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(5)]
    values = list({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(40)})
    a, b = forest(np.array(values, np.uint64), 4)
    assert len(a) < len(values) and all(int(x ^ y).bit_count() <= 4 for x, y in zip(a, b))
    comp = brute_components(values)
    assert len(values) - len(a) == len(set(comp))


def test_links_and_components_match_brute_force(spark):
    rng = random.Random(9)
    values = {rng.getrandbits(64) for _ in range(300)}
    for seed in list(values)[:12]:  # dense groups and long chains
        v = seed
        for _ in range(30):
            v ^= 1 << rng.randrange(64)
            values.add(v)
            if rng.random() < 0.5:
                v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
                values.add(v)
    values = sorted(np.array(list(values), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    got = {r.node: r.root for r in components(links(df)).collect()}
    want = brute_components([v & (2**64 - 1) for v in values])
    least = {}
    for v, w in zip(values, want):
        least[w] = min(least.get(w, v), v)
    assert [got.get(v, v) for v in values] == [least[w] for w in want]


@pytest.mark.parametrize("large", [3, 40])
def test_large_anchors_are_compared_block_by_block(spark, large):
    rng = random.Random(11)
    half = rng.getrandbits(32)
    values = {half << 32 | rng.getrandbits(32) for _ in range(300)}  # one half is shared, so one anchor covers all
    values |= {half | rng.getrandbits(32) << 32 for _ in range(100)} | {rng.getrandbits(64) for _ in range(50)}
    for v in list(values)[:40]:
        for _ in range(3):
            v ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(v)
    values = sorted(np.array(list(values), np.uint64).view(np.int64).tolist())
    df = spark.createDataFrame([(v,) for v in values], "fp long").repartition(4)
    found = links(df, large=large)
    got = {r.node: r.root for r in components(found).collect()}
    want = brute_components([v & (2**64 - 1) for v in values])
    least = {}
    for v, w in zip(values, want):
        least[w] = min(least.get(w, v), v)
    assert [got.get(v, v) for v in values] == [least[w] for w in want]
    sizes = Counter(r.anchor for r in compared(replicas(df), 4, large).where("anchor IS NOT NULL").collect())
    assert sizes and min(sizes.values()) > large  # some were too large, and those came whole
    want_sizes = Counter(r.anchor for r in replicas(df).collect())
    assert sizes == {a: n for a, n in want_sizes.items() if n > large}


@pytest.mark.parametrize("large", [1000, 15_000, 29_999])
def test_an_anchor_over_many_batches_is_streamed(spark, large):
    n = 30_000  # three Arrow batches of one anchor, small ones around it
    df = spark.range(n).select(F.lit(5).cast("long").alias("anchor"), (F.col("id") * 64).alias("fp")).unionByName(
        spark.createDataFrame([(1, 7), (1, 6), (9, 15), (9, 14), (9, 31 * 2**40)], "anchor long, fp long")).coalesce(1)
    got = compared(df, 4, large).collect()
    assert sorted((r.a, r.b) for r in got if r.anchor is None) == [(7, 6), (15, 14)]
    assert sorted(r.a for r in got if r.anchor == 5) == [64 * i for i in range(n)]


def test_rows_are_told_apart_by_their_own_column(spark):
    text = "one text that several rows share word for word"
    rows = [(None, text, 1), (None, text, 2), (3, text, 3), (3, text, 4), (3, "a different text with the same id here", 5),
            (None, "nobody else says this at all", 6), (None, "nobody else says this at all", 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long").repartition(3)
    got = {r.row: (r.doc_id, r.component_id, r.kept) for r in simhash_components(df, row_col="n").collect()}
    assert got == {1: (None, 3, False), 2: (None, 3, False), 3: (3, 3, True), 4: (3, 3, False), 5: (3, 3, True),
                   6: (None, None, True), 7: (None, None, False)}


def test_documents(spark):
    rng = random.Random(10)
    words = [f"w{i}" for i in range(400)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 300]))) for _ in range(60)]
    for t in texts[:20]:
        parts = t.split(" ")
        for _ in range(4):
            copy = list(parts)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["one hot text of many copies"] * 60 + [None, "", " ", texts[0].upper(), "long " * 30_000]
    rows = [(1000 - i, t) for i, t in enumerate(texts)] + [(5, "one hot text of many copies"), (5, "one hot text of many copies"), (None, "no id at all")]
    df = spark.createDataFrame([(i, t, "z", 3) for i, t in rows], DOCS).repartition(6)
    got = sorted([(r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in simhash_components(df).collect()], key=repr)
    values = [brute_fingerprint(t) for _, t in rows]
    comp = brute_components(values)
    least = {c: min((rows[i][0] for i in range(len(rows)) if comp[i] == c and rows[i][0] is not None), default=None) for c in set(comp)}
    assert got == sorted([(i, v, least[c]) for (i, _), v, c in zip(rows, values, comp)], key=repr)
    assert simhash_components(df.limit(0)).collect() == []


def test_more_bits_than_the_code_covers(spark):
    with pytest.raises(ValueError):
        links(spark.createDataFrame([(1,)], "fp long"), 5)
