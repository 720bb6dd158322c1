"""Mixing: targets against repeated resharing, taken words and the splitting tree against their promises."""
import random
from collections import defaultdict

from pyspark.sql import types as T

from textlab.llm.mixing import Mix, shards_of

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("size", T.StringType()), T.StructField("block", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], DOCS)


def brute_targets(sizes):
    """Targets by resharing the excess again and again."""
    sources = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(sources)}
    target, left, open_ = dict.fromkeys(sources, 0.0), 1.5 * sum(sizes.values()), set(sources)
    while open_ and left > 1e-9:
        total = sum(weight[s] for s in open_)
        for s in sorted(open_, key=str):
            target[s] += left * weight[s] / total
        left = 0.0
        for s in list(open_):
            if target[s] >= 2 * sizes[s]:
                left += target[s] - 2 * sizes[s]
                target[s] = 2.0 * sizes[s]
                open_.discard(s)
    return target


def corpus(rng, n=400):
    rows = []
    for i in range(n):
        source = "hot" if i % 3 == 0 else rng.choice(["a", "B", "é", "src10", "src2", "", None, "\U0001F642", "￮"])
        rows.append((i, "w " * rng.choice([0, 1, 3, 30, 400]), source))
    return rows


def check(rows, got):
    size = {i: len((t or "").split()) for i, t, _ in rows}
    by = defaultdict(int)
    for i, _, s in rows:
        by[s] += size[i]
    want = brute_targets(by)
    taken = defaultdict(int)
    for r in got:
        assert r.size == size[r.doc_id] and r.source_size == by[r.source]
        assert abs(r.target - want[r.source]) < 1e-6 * max(1, want[r.source])
        assert r.taken in (0, r.size, 2 * r.size)
        taken[r.source] += r.taken
    biggest = max(size.values(), default=0)
    assert all(abs(taken[s] - want[s]) <= biggest / 2 + 1 for s in by), {s: (taken[s], want[s]) for s in by}


def test_targets_and_taken_words(spark):
    for seed in range(3):
        rows = corpus(random.Random(seed))
        check(rows, Mix(frame(spark, rows).repartition(5)).per_document().collect())


def test_reruns_agree_whatever_the_partitioning(spark):
    rows = corpus(random.Random(8))
    runs = [sorted((r.doc_id, r.taken) for r in Mix(frame(spark, rows).repartition(n)).per_document().collect()) for n in (1, 7)]
    assert runs[0] == runs[1]


def test_splitting_tree_gives_every_block_once_and_halves_nodes(spark):
    rows = corpus(random.Random(2), 900)
    mix = Mix(frame(spark, rows))
    shards = shards_of(mix.sources, mix.blocks, 8).collect()
    per = defaultdict(int)
    turns = defaultdict(list)
    for r in shards:
        per[r.shard] += 1
        turns[r.key].append(r.turn)
    assert set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 3
    assert all(sorted(t) == list(range(1, len(t) + 1)) for t in turns.values())
    # in proportion: the hot source's share of any shard is near its share of the blocks
    hot = len(turns["shot"]) / len(shards)
    for s in range(8):
        assert abs(sum(r.shard == s and r.key == "shot" for r in shards) / per[s] - hot) < 0.15


def test_stream_holds_every_copy_once(spark):
    rows = corpus(random.Random(5), 300)
    mix = Mix(frame(spark, rows))
    copies = {r.doc_id: r.copies for r in mix.per_document().collect()}
    stream = mix.stream().collect()
    assert sorted((r.doc_id, r.copy) for r in stream) == sorted((i, c) for i, n in copies.items() for c in range(1, n + 1))
    assert len({(r.shard, r.position) for r in stream}) == len(stream)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "one two", None), (3, "one two", None), (None, "x y z", None), (4, "w " * 20_000, "z"), (5, "é", "z")]
    got = Mix(frame(spark, rows)).per_document().collect()
    assert len(got) == len(rows) and sum(r.taken for r in got if r.source == "a") == 0
    assert all(r.taken <= 2 * r.size for r in got)
    assert Mix(frame(spark, [])).per_document().collect() == []
    nothing = Mix(frame(spark, [(1, None, "a"), (2, " ", None)])).per_document().collect()
    assert [(r.target, r.taken) for r in nothing] == [(0.0, 0), (0.0, 0)]


def test_copies_are_the_rows_that_shards_hold(spark):
    """Without a shard's turns, the documents of their blocks are not taken."""
    class Lost(Mix):
        def stream(self, shards=8):
            return super().stream(shards).where("shard <> 0")

    rows = corpus(random.Random(6), 300)
    mix, lost = Mix(frame(spark, rows)), Lost(frame(spark, rows))
    in_first = defaultdict(int)
    for r in mix.stream().where("shard = 0").collect():
        in_first[r.doc_id] += 1
    copies = {r.doc_id: r.copies for r in mix.per_document().collect()}
    got = {r.doc_id: (r.copies, r.taken, r.size) for r in lost.per_document().collect()}
    assert in_first and set(got) == set(range(300))
    assert all(got[i] == (n - in_first[i], (n - in_first[i]) * got[i][2], got[i][2]) for i, n in copies.items())


def test_repeated_and_nameless_rows_are_taken_by_themselves(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "x"), (1, "d e", "y"), (None, "f g h i", "y"), (None, "f g h i", "y"), (2, "k " * 9, "x")]
    mix = Mix(frame(spark, rows))
    stream = mix.stream().collect()
    assert len({(r.row, r.copy) for r in stream}) == len(stream)
    assert sum(r.copies for r in mix.per_document().collect()) == len(stream)
