"""Cleaners and answer parsing on tables of inputs and the results the rules ask for."""
import pytest
from pyspark.sql import functions as F

from textlab.functions import answers as A
from textlab.functions import text as T

CLEAN = [
    (None, ""), ("", ""), ("  a \n b  ", "a b"), ("see http://x.y/z?q=1 now", "see <url> now"), ("www.a.b c", "<url> c"),
    ("@joe hi", "<user> hi"), ("joe@ex.com", "joe<user>.com"), ("#Tag_1 x", "Tag_1 x"), ("a &amp; b & c", "a and b and c"),
    ("a 　b", "a b"), ("@Jóe", "<user>"), ("#", "#"), ("a@ b", "a@ b"),
]
SIMPLE = [(None, ""), ("a&b", "a and b"), ("a\r\n\r\nb", "a b"), ("x &amp; y", "x and y"), (" \t ", "")]
# answer, binary class, simple class, outcome tag
ANSWERS = [
    ("Classe: 1", 1, 1, "isolated_number"), ("0", 0, 0, "isolated_number"), ("x1y", 1, 1, "digit_run"), ("7 or 1", 0, 0, "fallback"),
    ("classe ١", 1, 1, "isolated_number"), ("classe ६ e १", 0, 0, "fallback"), ("x１y", 1, 1, "digit_run"),
    ("Sim, contém ódio", 1, 0, "keyword_positive"), ("this is hate", 1, 0, "keyword_positive"),
    ("não tem", 0, 0, "keyword_negative"), ("non-hate", 1, 0, "keyword_positive"), ("no hate", 0, 0, "keyword_negative"),
    ("???", 0, 0, "fallback"), ("", 0, 0, "fallback"), (None, 0, 0, "fallback"), ("99999999999999999999", 0, 0, "fallback"),
]
NAMES = [("f1_non-hate", "F1-Non-Hate"), ("macro_f1", "Macro-F1"), ("roc_auc", "ROC-AUC"), ("llama_3b", "Llama 3B"), ("ece", "ECE ↓"),
         ("precision_noção", "Prec-Noção")]


def outputs(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t string")
    return [tuple(r)[1:] for r in df.select("i", *columns).orderBy("i").collect()]


@pytest.mark.parametrize("table, fn", [(CLEAN, T.clean_text), (SIMPLE, T.simple_preprocess), (NAMES, T.metric_display_name)])
def test_text_tables(spark, table, fn):
    got = outputs(spark, [a for a, _ in table], fn("t").alias("o"))
    assert [(a, o) for (a, _), (o,) in zip(table, got)] == table


def test_answers(spark):
    got = outputs(spark, [a[0] for a in ANSWERS], A.extract_label("t", 2).alias("a"), A.extract_label_simple("t").alias("b"),
                  A.extraction_outcome("t", 2).alias("c"))
    assert [(a[0], *g) for a, g in zip(ANSWERS, got)] == ANSWERS


def test_class_names_and_more_classes(spark):
    values = ["it is Neutral", "class 2", "5", " 3 "]
    got = outputs(spark, values, A.extract_label("t", 3, ["bad", "neutral", "good"]).alias("a"))
    assert got == [(1,), (2,), (0,), (0,)]


def test_cleaning_twice_changes_nothing_more(spark):
    once = [o for (o,) in outputs(spark, [a for a, _ in CLEAN], T.simple_preprocess("t").alias("o"))]
    assert [o for (o,) in outputs(spark, once, F.trim(T.collapse_whitespace("t")).alias("o"))] == once
