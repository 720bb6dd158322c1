"""Answer parsing: turn generated text into a class id, as Column expressions."""

from __future__ import annotations

import unicodedata

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import DIGIT, NON_WORD, unicode_strip

# Isolated number (RE2 has no look-around, so the neighbours are
# matched and group 1 is taken) and any digit run.
ISOLATED_NUMBER = f"(?:^|{NON_WORD})({DIGIT}+)(?:$|{NON_WORD})"
DIGIT_RUN = f"{DIGIT}+"

# Keyword lists of the binary strategy, in the reference order.
POSITIVE_KEYWORDS = ["ódio", "hate", "sim", "yes", "contém", "tem", "possui",
                     "verdadeiro", "true", "positivo", "positive"]
NEGATION_KEYWORDS = ["não", "nao", "sem", "no ", "not", "isn't", "falso", "false"]
NEGATIVE_KEYWORDS = ["não", "nao", "sem", "no ", "not", "isn't", "falso", "false",
                     "negativo", "negative"]

# Outcome tags of the cascade.
OUTCOMES = ["isolated_number", "digit_run", "keyword_positive", "keyword_negative",
            "class_name", "short_numeric", "fallback"]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _in_range(num: Column, k: int) -> Column:
    # null (no number) gives a null condition, which no CASE branch takes
    return num.between(0, k - 1)


# The decimal digits of the Basic Multilingual Plane and the ASCII digit of each.
DECIMALS = [chr(c) for c in range(0x80, 0x10000) if unicodedata.category(chr(c)) == "Nd"]
DECIMAL_FROM, DECIMAL_TO = "".join(DECIMALS), "".join(str(unicodedata.digit(c)) for c in DECIMALS)


def _as_long(s: Column) -> Column:
    # null for '' and for numbers that overflow (both count as out of range)
    plain = F.when(s.rlike(r"[^\x{00}-\x{7f}]"), F.translate(s, DECIMAL_FROM, DECIMAL_TO)).otherwise(s)
    return plain.try_cast("bigint")


def _any_contains(text: Column, words: Sequence[str]) -> Column:
    """Substring test for any of ``words`` as one literal alternation, so the
    (stripped, lower-cased) text is computed once per list, not once per word."""
    return text.rlike("|".join(f"\\Q{w}\\E" for w in words))


def _strategies(col, num_classes: int, label_names: Sequence[str] | None) -> list[tuple[str, Column, Column]]:
    """(tag, condition, value) in cascade order."""
    text = F.coalesce(_c(col), F.lit(""))
    stripped = unicode_strip(text)
    lowered = F.lower(stripped)
    n1 = _as_long(F.regexp_extract(text, ISOLATED_NUMBER, 1))
    n2 = _as_long(F.regexp_extract(text, DIGIT_RUN, 0))
    steps: list[tuple[str, Column, Column]] = [
        ("isolated_number", _in_range(n1, num_classes), n1.cast("int")),
        ("digit_run", _in_range(n2, num_classes), n2.cast("int")),
    ]
    if num_classes == 2:
        pos = _any_contains(lowered, POSITIVE_KEYWORDS) & ~_any_contains(lowered, NEGATION_KEYWORDS)
        steps.append(("keyword_positive", pos, F.lit(1)))
        steps.append(("keyword_negative", _any_contains(lowered, NEGATIVE_KEYWORDS), F.lit(0)))
    for i, name in enumerate(label_names or []):
        steps.append(("class_name", F.contains(lowered, F.lit(name.lower())), F.lit(i)))
    n5 = _as_long(stripped)
    steps.append(("short_numeric", (F.length(stripped) <= 3) & _in_range(n5, num_classes), n5.cast("int")))
    return steps


def extract_label(col, num_classes: int = 2, label_names: Sequence[str] | None = None) -> Column:
    """Cascade, first hit wins; 0 when nothing fires."""
    expr = None
    for _, cond, value in _strategies(col, num_classes, label_names):
        expr = F.when(cond, value) if expr is None else expr.when(cond, value)
    return expr.otherwise(F.lit(0)).cast("int")


def extraction_outcome(col, num_classes: int = 2, label_names: Sequence[str] | None = None) -> Column:
    """Tag of the strategy that fired (``fallback`` when none)."""
    expr = None
    for tag, cond, _ in _strategies(col, num_classes, label_names):
        expr = F.when(cond, F.lit(tag)) if expr is None else expr.when(cond, F.lit(tag))
    return expr.otherwise(F.lit("fallback"))


def extract_label_simple(col, num_classes: int = 2) -> Column:
    """First digit run if it is a class id, else 0."""
    n = _as_long(F.regexp_extract(F.coalesce(_c(col), F.lit("")), DIGIT_RUN, 0))
    return F.when(_in_range(n, num_classes), n.cast("int")).otherwise(F.lit(0)).cast("int")
