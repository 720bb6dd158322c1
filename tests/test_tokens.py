"""Vocabulary, token-id encoding, weighted loss and hot-text dedup against
plain-Python brute force on small fixtures."""
import math
from collections import Counter

import regex

from pyspark.sql import functions as F

from textlab.operators.corpus import dedup_keep_first
from textlab.operators.metrics import weighted_cross_entropy
from textlab.operators.tokens import PAD_ID, SPECIALS, TOKEN_PATTERN, UNK_ID, encode_tokens, vocabulary

TEXTS = [
    "Não gosto disso!!", "gosto de você", "VOCÊ não", None, "", "a a a b b c", "ça va? ça va.",
    "x_y 12 12", "tab\tsep  spaces", "émoji-free, ok", "b c a", "zz",
]


# the Java pattern's \x{hex} escapes written as Python \U escapes (same code points)
PY_PATTERN = regex.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), TOKEN_PATTERN)


def py_tokens(t):
    return regex.findall(PY_PATTERN, (t or "").lower())


def py_vocab(texts):
    c = Counter(tok for t in texts for tok in py_tokens(t))
    order = sorted(c.items(), key=lambda kv: (-kv[1], kv[0].encode("utf-8")))
    return {tok: i + len(SPECIALS) for i, (tok, _) in enumerate(order)}, c


def corpus(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "row_id long, text string")


def test_vocabulary_ids_match_brute_force(spark):
    v = {r.token: (r.id, r["count"]) for r in vocabulary(corpus(spark)).collect()}
    ids, counts = py_vocab(TEXTS)
    assert v == {tok: (ids[tok], counts[tok]) for tok in ids}


def test_encode_tokens_match_brute_force(spark):
    df = corpus(spark)
    train = df.where(F.col("row_id") % 2 == 0)
    vocab = vocabulary(train)
    ids, _ = py_vocab([t for i, t in enumerate(TEXTS) if i % 2 == 0])
    for padding in ("right", "left"):
        got = {r.row_id: (list(r.input_ids), list(r.attention_mask))
               for r in encode_tokens(df, vocab, max_length=5, padding=padding).collect()}
        for i, t in enumerate(TEXTS):
            seq = [ids.get(tok, UNK_ID) for tok in py_tokens(t)][:5]
            pad = [PAD_ID] * (5 - len(seq))
            ones, zeros = [1] * len(seq), [0] * (5 - len(seq))
            want = (seq + pad, ones + zeros) if padding == "right" else (pad + seq, zeros + ones)
            assert got[i] == want, (padding, t)


def test_encode_tokens_pad_to_longest(spark):
    df = corpus(spark)
    vocab = vocabulary(df)
    rows = encode_tokens(df, vocab, max_length=64, pad_to="longest").collect()
    longest = max(len(py_tokens(t)) for t in TEXTS)
    assert {len(r.input_ids) for r in rows} == {longest}


def test_weighted_cross_entropy_matches_numpy(spark):
    rows = [("a", 0, [2.0, -1.0]), ("a", 1, [0.5, 0.5]), ("a", 1, [-3.0, 4.0]), ("b", 0, [0.0, 9.0]),
            ("b", 2, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "run string, label int, logits array<double>")
    weights = spark.createDataFrame([(0, 0.75), (1, 1.5), (2, 3.0)], "label int, weight double")
    got = {r.run: r.weighted_cross_entropy for r in weighted_cross_entropy(df, ["run"], weights).collect()}
    w = {0: 0.75, 1: 1.5, 2: 3.0}
    for run in ("a", "b"):
        num = den = 0.0
        for r, y, z in rows:
            if r != run:
                continue
            m = max(z)
            nll = -(z[y] - m - math.log(sum(math.exp(x - m) for x in z)))
            num += w[y] * nll
            den += w[y]
        assert abs(got[run] - num / den) < 1e-12


def test_dedup_hot_text_keeps_first_per_split(spark):
    # one text holds a third of all rows in every split
    rows = []
    for i in range(600):
        split = ("train", "validation", "test")[i % 3]
        text = "same hot text" if i % 3 == (i // 3) % 3 else f"text {i % 50}"
        rows.append((i, split, text))
    df = spark.createDataFrame(rows, "row_id long, split string, text string")
    got = sorted(r.row_id for r in dedup_keep_first(df).collect())
    seen, want = set(), []
    for rid, split, text in sorted(rows):
        if split == "test":
            want.append(rid)
        elif (split, text) not in seen:
            seen.add((split, text))
            want.append(rid)
    assert got == sorted(want)
    plan = dedup_keep_first(df)._jdf.queryExecution().executedPlan().toString()
    assert "partial_min" in plan  # hot text combined map-side before the shuffle
