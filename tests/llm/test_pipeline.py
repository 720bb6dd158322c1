"""The pipeline's stages: each against a brute-force version on its own input, and run() as their chain."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

import __spark_entry__ as E
import corpus_pipeline as P
from tests.llm.test_line_dedup import brute as brute_lines
from tests.llm.test_mixing import brute_targets
from tests.llm.test_packing import PATH, check_places
from tests.llm.test_quality_rules import brute as brute_statistics
from tests.llm.test_simhash import brute_components, brute_fingerprint
from textlab.llm.line_dedup import GRAM, LEAST, REACH

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("copies", T.StringType())])


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(n))


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(12)
    passage = [words(rng, 30), words(rng, 35)]
    rows = []
    for i in range(160):
        lines = [words(rng, rng.randint(10, 45)) for _ in range(rng.randint(2, 6))]
        if i % 8 == 1:
            lines[1:1] = passage
        text = "\n".join(lines)
        if i % 5 == 2:
            text = " ".join(w + "###" for w in text.split(" "))
        rows.append((i, text, "en", "hot" if i % 3 else f"s{i % 4}"))
    rows += [(200 + i, rows[0][1], "en", "hot") for i in range(40)]  # exact copies
    rows += [(300 + i, rows[3][1].replace(" ", f" new{i} ", 1), "en", "s1") for i in range(10)]  # near copies
    rows += [(400, None, None, None), (401, "", "en", ""), (402, "short one", "en", None), (403, words(rng, 9000), "en", "s2"),
             (404, rows[6][1], "en", "hot"), (404, rows[6][1], "en", "hot"), (None, words(rng, 40), "en", "hot")]
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame([(i, t, lang, s, len(t or ""), "x") for i, t, lang, s in rows], DOCS).repartition(3) \
        .write.parquet(str(folder / "documents.parquet"))
    spark.createDataFrame([(i, int(not (t and "###" in t)), 0) for i, t, *_ in rows if i is not None and i < 160],
                          "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
    docs, steps = spark.read.parquet(str(folder / "documents.parquet")), []
    for n, (name, stage) in enumerate(P.STAGES):
        stage(spark, docs, str(folder)).write.parquet(str(folder / f"step{n}"))
        after = spark.read.parquet(str(folder / f"step{n}"))
        steps.append((docs, after))
        docs = after
    return str(folder), steps


def held(df):
    return [r.asDict() for r in df.collect()]


def test_stages_keep_the_columns_of_documents(tables):
    _, steps = tables
    assert all(after.columns == steps[0][0].columns for _, after in steps[:-1]) and len(P.STAGES) == 5


def test_quality_stage(tables):
    before, after = tables[1][0]
    bad = set()
    for r in held(before):
        n, chars, symbols, _, repeat = brute_statistics(r["text"])
        if n < 10 or 100 * repeat > 20 * n or symbols > 0.2 * chars:  # the planted fault: symbols
            bad.add(r["text"])
    assert Counter(str(r) for r in held(after)) == Counter(str(r) for r in held(before) if r["text"] not in bad)


def test_line_stage(spark, tables):
    before, after = tables[1][1]
    rows = [(r["doc_id"], r["text"]) for r in held(before)]
    want = brute_lines(spark, rows, GRAM, REACH, LEAST)
    expected = Counter((i, want.get((i is None, i or 0, t))) for i, t in rows)
    assert Counter((r["doc_id"], r["text"]) for r in held(after)) == expected
    assert all(r["n_chars"] == len(r["text"]) for r in held(after)) and any(r["text"] == "" for r in held(after))


def test_simhash_stage(tables):
    before, after = tables[1][2]
    rows = held(before)
    comp = brute_components([brute_fingerprint(r["text"]) for r in rows])
    late = lambda r: (r["doc_id"] is None, r["doc_id"] or 0)
    want = Counter(min(late(r) for r, d in zip(rows, comp) if d == c) for c in set(comp))  # one row of each group
    assert Counter(late(r) for r in held(after)) == want
    assert not Counter(str(r) for r in held(after)) - Counter(str(r) for r in rows)


def test_filters_judge_rows_that_share_an_id_or_have_none(spark, tables):
    folder, _ = tables
    rng = random.Random(17)
    good, other, bad = words(rng, 60), words(rng, 60), "too short"
    rows = [(1, good), (1, bad), (1, bad), (None, bad), (None, other), (2, None), (2, other + " x"), (None, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", n, "x") for n, (i, t) in enumerate(rows)], DOCS).repartition(3)
    assert sorted(r["n_chars"] for r in held(P.quality_rules(spark, docs, folder))) == [0, 4, 6]
    near = [(5, good), (5, other), (None, good), (None, words(rng, 50)), (6, other), (5, good)]
    docs = spark.createDataFrame([(i, t, "en", "s", n, "x") for n, (i, t) in enumerate(near)], DOCS).repartition(3)
    got = sorted((r["n_chars"] for r in held(P.simhash_stage(spark, docs, folder))), key=lambda n: n % 5)
    assert got in ([0, 1, 3], [5, 1, 3])  # one of two equal rows, the other text of id 5, and the row without an id


def test_mixing_stage(tables):
    before, after = tables[1][3]
    rows = held(before)
    size = defaultdict(int)
    for r in rows:
        size[r["source"]] += len(r["text"].split())
    want = brute_targets(size)
    taken = defaultdict(int)
    for r in held(after):
        taken[r["source"]] += len(r["text"].split())
    biggest = max(len(r["text"].split()) for r in rows)
    for s in size:  # rows without an id are not mixed in
        assert abs(taken[s] - want[s]) <= biggest / 2 + 1 + 2 * 40 * (s == "hot")
    copies = Counter(str(r) for r in held(after))
    there = Counter(str(r) for r in rows)
    assert all(n <= 2 * there[r] for r, n in copies.items())


def test_packing_stage(tables):
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(PATH)
    before, after = tables[1][4]
    want = Counter()
    for r in held(before):
        ids = tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[(r["doc_id"], piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    got = held(after)
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == want
    check_places([(r["length"], r["sequence_id"], r["offset"]) for r in got], 4096)


def test_run_is_the_chain_of_stages(spark, tables):
    folder, steps = tables
    pieces = lambda df: Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in held(df))
    assert pieces(P.run(spark, folder)) == pieces(steps[-1][1])
    assert E.queries()["pipeline"] is P.run and P.ORACLE_SQL is None


def test_empty_tables(spark, tables, tmp_path):
    folder, steps = tables
    for name, source in (("documents", steps[0][0]), ("labels", spark.read.parquet(f"{folder}/labels.parquet"))):
        source.limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert P.run(spark, str(tmp_path)).collect() == []


def test_mixing_stage_gives_the_stream_in_order(spark):
    from textlab.llm.mixing import Mix
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, words(rng, rng.randint(5, 60)), "en", f"s{i % 3}", 1, "x") for i in range(300)], DOCS)
    want = [r.doc_id for r in Mix(docs).stream().orderBy("shard", "position").collect()]
    got = [r.doc_id for r in P.mixing_stage(spark, docs, "").collect()]
    assert got == want and got != sorted(got)


def test_mixing_stage_takes_nameless_and_repeated_rows_one_by_one(spark):
    rng = random.Random(9)
    rows = [(None if i % 3 == 0 else i % 20, words(rng, rng.randint(5, 60)), "en", f"s{i % 2}", i, "x") for i in range(300)]
    size, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        size[r[3]] += len(r[1].split())
    got = held(P.mixing_stage(spark, spark.createDataFrame(rows, DOCS), ""))
    for r in got:
        taken[r["source"]] += len(r["text"].split())
    want = brute_targets(size)
    assert all(abs(taken[s] - want[s]) <= 31 for s in size)
    assert max(Counter(r["n_chars"] for r in got).values()) <= 2 and any(r["doc_id"] is None for r in got)
