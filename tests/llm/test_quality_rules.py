"""Quality rules: statistics against brute force, the learned list against its planted truth."""
import random
import re
from collections import Counter

from pyspark.sql import types as T

from textlab.llm.quality_rules import FEATURES, STATISTICS, Condition, Rule, learn, low_quality, quality_verdicts, with_statistics

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("n_words", T.StringType()), T.StructField("kept", T.IntegerType())])
LABELS = "doc_id long, quality int, toxic int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    seen, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if seen[w] > 1:
            covered.update(range(i, i + 5))
    lines, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in lines
            lines.add(line)
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered))


def test_statistics_match_brute_force(spark):
    rng = random.Random(4)
    texts = [None, "", " \n\t", "a", "a b c d e", "a b c d e a b c d e", "a a a a a a", "a a a a a", "x\ny\nx\n \n \nx ", "é🙂 ##\x0b*$%&|<>\r\n",
             "w " * 30_000, " ".join(str(i) for i in range(20_000))]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", "cc", "é"]) + rng.choice([" ", " ", "\n", "  "]) for _ in range(rng.randint(0, 60))))
    got = {r.doc_id: tuple(r[c] for c in STATISTICS) for r in with_statistics(frame(spark, list(enumerate(texts)))).collect()}
    for i, t in enumerate(texts):
        assert got[i] == brute(t), (t or "")[:60]


def holds(condition, stats):
    n, chars, symbols, dup, repeat = stats
    value = {"words": n, "word_length": chars / n if n else 0, "symbol_share": symbols / chars if chars else 0,
             "symbols_per_word": symbols / n if n else 0, "repeat_share": repeat / n if n else 0, "dup_lines": dup}[condition.feature]
    return value >= condition.threshold if condition.at_least else value < condition.threshold


def test_case_expression_is_the_ordered_list(spark):
    rules = [Rule((Condition("words", False, 20.0), Condition("dup_lines", True, 2.0))), Rule((Condition("symbol_share", True, 0.2),))]
    rng = random.Random(5)
    rows = [(i, "\n".join(rng.choice(["a b", "## a", "c"]) for _ in range(rng.randint(0, 12)))) for i in range(80)]
    got = with_statistics(frame(spark, rows)).withColumn("rule", low_quality(rules)).collect()
    for r in got:
        stats = brute(dict(rows)[r.doc_id])
        assert r.rule == next((k for k, rule in enumerate(rules, 1) if all(holds(c, stats) for c in rule.conditions)), None)
    assert set(FEATURES) == {"words", "word_length", "symbol_share", "symbols_per_word", "repeat_share", "dup_lines"}


def make(rng, kind):
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(40, 90))]
    if kind == "symbols":
        words = [w + rng.choice(["###", "$$", "%"]) for w in words]
    if kind == "long":
        words = [w * 6 for w in words]
    return " ".join(words)


def test_learned_rules_find_planted_faults_and_keep_clean_documents(spark):
    rng = random.Random(6)
    kinds = [rng.choice(["clean", "clean", "clean", "symbols", "long"]) for _ in range(600)]
    rows = [(i, make(rng, k)) for i, k in enumerate(kinds)]
    labels = spark.createDataFrame([(i, int(k == "clean"), 0) for i, k in enumerate(kinds) if i < 400], LABELS)
    got = {r.doc_id: r for r in quality_verdicts(frame(spark, rows), labels).collect()}
    held_out = [(kinds[i] == "clean", got[i].kept) for i in range(400, 600)]
    assert sum(a == b for a, b in held_out) / len(held_out) > 0.97
    for i, t in rows:
        assert tuple(got[i][c] for c in STATISTICS) == brute(t)


def test_learning_refuses_noise_and_missing_labels(spark):
    rng = random.Random(7)
    rows = [(i, make(rng, "clean")) for i in range(200)]
    stats = with_statistics(frame(spark, rows)).selectExpr("doc_id AS key", *STATISTICS, "CAST(xxhash64(doc_id) % 2 = 0 AS BIGINT) AS low")
    assert learn(stats) == []
    none = quality_verdicts(frame(spark, rows[:20]), spark.createDataFrame([], LABELS)).collect()
    assert all(r.kept and r.rule is None for r in none)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "one two three four five six seven eight nine ten"), (3, "one two three four five six seven eight nine ten"),
            (None, "w " * 5000), (4, "a b c d e f g h i")]
    labels = spark.createDataFrame([(1, 0, 0), (2, None, 0), (None, 1, 1), (3, 1, 0), (3, 1, 0), (4, 7, 0)], LABELS)
    got = sorted([(r.doc_id or 0, r.n_words, r.base_failed, r.kept) for r in quality_verdicts(frame(spark, rows), labels).collect()])
    assert got == [(0, 5000, True, False), (1, 0, True, False), (2, 0, True, False), (3, 10, False, True), (3, 10, False, True), (4, 9, True, False)]
    assert quality_verdicts(frame(spark, []), labels).collect() == []
