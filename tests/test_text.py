"""Hand-made cases for the cleaners and answer parsing (quirks kept on purpose)."""
from pyspark.sql import functions as F

from textlab.functions import answers as A
from textlab.functions import text as T


def run(spark, fn, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("s"))).collect()]


def test_clean_text_order_and_unicode(spark):
    cases = {
        "joe@ex.com z": "joe<user>.com z",
        "a@.b c": "<email> c",
        "oi @joão": "oi <user>",
        "AT&T &amp; &lt;": "AT and T and and lt;",
        "www.x.y/á?b httpfoo": "<url> <url>",
        "a b c\u000bd\u001ce\u0085f": "a b c d e f",
        "#Olá mundo": "Olá mundo",
        "  lead  ": "lead",
    }
    assert run(spark, T.clean_text, list(cases)) == list(cases.values())
    assert run(spark, T.clean_text, [None]) == [""]


def test_simple_and_generic(spark):
    assert run(spark, T.simple_preprocess, ["a &amp; b\r\n\nc"]) == ["a and b c"]
    # whitespace collapsed before non-ASCII runs become spaces: double spaces may remain
    assert run(spark, T.generic_preprocess, ["x é y @u http://a #tag &lt;"]) == ["x   y tag <"]


def test_social_normalize(spark):
    assert run(spark, T.social_normalize, ["Hi @bob, see http://x.y #Big!"]) == ["Hi <user> , see <url> Big !"]


def test_extract_label_cascade(spark):
    f = lambda c: A.extract_label(c, 2)
    assert run(spark, f, ["1", "classe: 0", "x1 7", "non-hate", "não é ódio", "99999999999999999999",
                          "hate no \n", "nothing here"]) == [1, 0, 1, 1, 0, 0, 1, 0]
    named = lambda c: A.extract_label(c, 2, ["0", "1"])
    assert run(spark, named, ["21", "10", "7 x1"]) == [1, 0, 1]


def test_extraction_outcome_and_simple(spark):
    f = lambda c: A.extraction_outcome(c, 2)
    assert run(spark, f, ["1", "x1 7", "yes", "no way", "zzz"]) == \
        ["isolated_number", "digit_run", "keyword_positive", "keyword_negative", "fallback"]
    assert run(spark, lambda c: A.extract_label_simple(c, 2), ["a 5 1", "b 1", "c"]) == [0, 1, 0]


def test_display_and_verbalize(spark):
    assert run(spark, T.metric_display_name, ["macro_f1", "roc_auc", "ece", "f1_0", "precision_1"]) == \
        ["Macro-F1", "ROC-AUC", "ECE ↓", "F1-0", "Prec-1"]
    df = spark.createDataFrame([(1,), (0,), (None,)], "l int")
    assert [r[0] for r in df.select(T.verbalize_label("l")).collect()] == ["Yes", "No", "No"]


def test_unicode_strip_matches_python_strip(spark):
    import random
    import re

    from textlab.functions.text import STRIP_CHARS, WS, unicode_strip
    # the trim set is exactly the regex whitespace class
    py_ws = re.sub(r"\\x\{([0-9a-fA-F]+)\}", lambda m: "\\U%08x" % int(m.group(1), 16), WS)
    assert [c for c in range(0x110000) if re.fullmatch(py_ws, chr(c))] == [ord(c) for c in STRIP_CHARS]
    rnd = random.Random(7)
    pool = list(STRIP_CHARS) + list("ab é😀ç\u200b\ufeff")
    texts = ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 12))) for _ in range(2000)]
    texts += [None, "", "\x85x\x85", "\u3000\u3000"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = {r.i: r.s for r in df.select("i", unicode_strip("t").alias("s")).collect()}
    assert all(got[i] == (None if t is None else t.strip()) for i, t in enumerate(texts))


def test_text_queries_read_only_needed_columns(spark):
    """Column pruning reaches the Parquet scans of the text queries."""
    import os
    import re

    import pytest

    import __spark_entry__ as E
    sf = "/root/testdata/sf0.001"
    if not os.path.isdir(sf):
        pytest.skip("test tables not present")
    want = {"clean_text": {"struct<doc_id:bigint,text:string>"},
            "extract_label": {"struct<conv_id:bigint,turn:bigint,text:string>"}}
    for key, schemas in want.items():
        plan = E.queries()[key](spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"ReadSchema: (struct<[^>]*>)", plan)) == schemas, key
