"""Array and probability helpers as higher-order Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import once


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def softmax(col) -> Column:
    """Max-shifted softmax of a logit array (double precision); maximum and total are found once an array, not once an entry."""
    shifted = lambda a: once(F.array_max(a), lambda m: F.transform(a, lambda x: F.exp(x - m)))
    shares = lambda e: once(F.aggregate(e, F.lit(0.0), lambda acc, x: acc + x), lambda t: F.transform(e, lambda x: x / t))
    return once(once(F.transform(_c(col), lambda x: x.cast("double")), shifted), shares)


def log_softmax_at(col, index) -> Column:
    """log softmax(logits)[index] = logits[index] - logsumexp(logits)."""
    logits = F.transform(_c(col), lambda x: x.cast("double"))
    lse = lambda a: once(F.array_max(a), lambda m: m + F.log(F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m))))
    return F.element_at(logits, _c(index) + 1) - once(logits, lse)


def argmax_label(col) -> Column:
    """Index of the maximum, first one on ties."""
    p = _c(col)
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def max_confidence(col) -> Column:
    return F.array_max(_c(col))


def prob_slice(col, k: int, renormalize: bool = False) -> Column:
    """First ``k`` entries of a probability vector, by default not re-normalised."""
    s = F.slice(_c(col), 1, k)
    if not renormalize:
        return s
    return once(F.aggregate(s, F.lit(0.0), lambda acc, x: acc + x), lambda t: F.transform(s, lambda x: x / t))


def binary_probs(p1) -> Column:
    """[1 - p, p] from P(class 1)."""
    p = _c(p1).cast("double")
    return F.array(F.lit(1.0) - p, p)


def align_target_labels(target_ids, length) -> Column:
    """Target ids right-aligned in a row of -100 of the input length."""
    t = _c(target_ids)
    n = _c(length) if not isinstance(length, int) else F.lit(length)
    m = F.least(F.size(t), n)
    pad = F.array_repeat(F.lit(-100), n - m)  # fixed value: the ignored label id
    return F.concat(pad, F.slice(t, F.size(t) - m + 1, m))
