"""Quality rules: a decision list learned by sequential covering.

Statistics of every text are built-in expressions. Rules are learned from labelled
statistics: grow a conjunction of threshold conditions that covers low-quality rows
(one condition at a time, by FOIL gain), prune it on rows kept aside, keep it if it
is precise there, remove what it covers, repeat. Every step is an aggregation over
all labelled rows; only counts per (feature, bin) reach the driver. The learned
list becomes one ordered ``CASE WHEN`` expression.

Defined results: a null text counts as empty; statistics of an empty text are zero;
without labels the list is empty and keeps what the base rule keeps; an empty table
gives an empty result; repeated rows are judged each; further columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_SPACE, let, n_words, saved, text_or_empty

# The base rule and the symbols it counts.
LEAST_WORDS, MOST_REPEATED_PERCENT, WINDOW = 10, 20, 5
SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"

# Learning parameters.
BINS = 256             # candidate thresholds per feature
MOST_RULES = 8
MOST_CONDITIONS = 3
LEAST_PRECISION = 0.9  # of a rule, on the rows kept aside
LEAST_COVER = 4        # low-quality rows a rule must cover, in either part
ASIDE = 3              # every third labelled row (by hash) prunes and proves

STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


# ------------------------------------------------------------------ statistics

def repeated_words(words: Column) -> Column:
    """Words inside 5-word windows that occur twice or more in the text.

    Windows are compared by a 64-bit hash. Sorted (hash, place) pairs show which
    places repeat; the union of their windows is summed from the gaps between them."""
    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (WINDOW - 1), F.lit(1))),
                           lambda i: F.xxhash64(*[F.try_element_at(w, i + j) for j in range(WINDOW)]))

    def count(h: Column) -> Column:
        paired = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(paired, lambda s: let(F.sort_array(F.transform(
            F.filter(s, lambda x, k: (x["h"] == F.try_element_at(s, k + 2)["h"]) | ((k > 0) & (x["h"] == F.try_element_at(s, F.greatest(k, F.lit(1)))["h"]))),
            lambda x: x["i"])), covered))

    def covered(places: Column) -> Column:
        return F.aggregate(F.transform(places, lambda p, k: F.least(
            F.lit(WINDOW), F.coalesce(F.try_element_at(places, k + 2) - p, F.lit(WINDOW)))), F.lit(0), lambda a, x: a + x)

    some = let(words, lambda w: F.when(F.size(w) > WINDOW, let(hashes(w), lambda h: F.when(
        F.size(F.array_distinct(h)) < F.size(h), count(h)).otherwise(0))).otherwise(0))
    return some.cast("long")


def with_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the five statistics of the whole text."""
    text = F.col("_text")
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(NOT_SPACE))
    return (df.withColumn("_text", text_or_empty(text_col))
            .withColumn("n_words", n_words(text))
            .withColumn("word_chars", F.length(F.translate(text, WHITE, "")).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
            .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
            .withColumn("n_repeat_words", repeated_words(words)).drop("_text"))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))


# Ratios that the rules test, over statistics named above.
FEATURES = {
    "words": "CAST(n_words AS DOUBLE)",
    "word_length": "coalesce(try_divide(word_chars, n_words), 0)",
    "symbol_share": "coalesce(try_divide(n_symbols, word_chars), 0)",
    "symbols_per_word": "coalesce(try_divide(n_symbols, n_words), 0)",
    "repeat_share": "coalesce(try_divide(n_repeat_words, n_words), 0)",
    "dup_lines": "CAST(n_dup_lines AS DOUBLE)",
}


# -------------------------------------------------------------------- learning

@dataclass(frozen=True)
class Condition:
    feature: str
    at_least: bool  # value >= threshold, else value < threshold
    threshold: float

    def sql(self) -> str:
        return f"({FEATURES[self.feature]}) {'>=' if self.at_least else '<'} {self.threshold!r}D"


@dataclass(frozen=True)
class Rule:
    conditions: tuple[Condition, ...]

    def sql(self) -> str:
        return " AND ".join(c.sql() for c in self.conditions)


def thresholds(rows: DataFrame, bins: int) -> dict[str, list[float]]:
    """Cut points of every feature: halfway between neighbouring quantiles of its distinct values."""
    out = {}
    for name, sql in FEATURES.items():
        values = rows.select(F.round(F.expr(sql), 4).alias("v")).distinct()
        cuts = sorted(set(values.approxQuantile("v", [i / bins for i in range(bins + 1)], 0.25 / bins)))
        out[name] = [(a + b) / 2 for a, b in zip(cuts, cuts[1:])]
    return out


def binned(rows: DataFrame, cuts: dict[str, list[float]]) -> DataFrame:
    """The bin of every feature: how many cut points are at most the value."""
    def of(name: str) -> Column:
        edges = F.array(*[F.lit(c) for c in cuts[name]]) if cuts[name] else F.array().cast("array<double>")
        return F.size(F.filter(edges, lambda c: c <= F.expr(FEATURES[name])))
    return rows.select("*", F.array(*[F.struct(F.lit(n).alias("feature"), of(n).alias("bin")) for n in FEATURES]).alias("bins"))


def best_condition(rows: DataFrame, cuts: dict[str, list[float]]) -> tuple[float, Condition, int, int] | None:
    """The condition of greatest FOIL gain over the rows, from counts per (feature, bin)."""
    counts = rows.select("low", F.explode("bins").alias("b")).groupBy("b.feature", "b.bin").agg(
        F.sum("low").alias("bad"), F.sum(1 - F.col("low")).alias("good")).collect()
    by: dict[str, dict[int, tuple[int, int]]] = {n: {} for n in FEATURES}
    for r in counts:
        by[r["feature"]][r["bin"]] = (r["bad"], r["good"])
    best = None
    for name in FEATURES:
        bad, good = (sum(x[i] for x in by[name].values()) for i in (0, 1))
        if not bad:
            return None
        for at, cut in enumerate(cuts[name], 1):
            over = [sum(x[i] for b, x in by[name].items() if b >= at) for i in (0, 1)]
            for at_least, (p, n) in ((True, over), (False, (bad - over[0], good - over[1]))):
                if p < LEAST_COVER or p + n == bad + good:
                    continue
                gain = p * (math.log2(p / (p + n)) - math.log2(bad / (bad + good)))
                if gain > 1e-9 and (best is None or gain > best[0] + 1e-9):
                    best = gain, Condition(name, at_least, cut), p, n
    return best


def learn(labelled: DataFrame, bins: int = BINS, most_rules: int = MOST_RULES) -> list[Rule]:
    """Rules for low quality, in order. ``labelled``: the statistics, key, low (1: low quality).

    Candidate thresholds come from the rows that grow rules; rules are pruned and
    proved on the rows kept aside. All labelled rows take part."""
    part = labelled.withColumn("aside", F.pmod(F.xxhash64("key"), F.lit(ASIDE)) == 0)
    cuts = thresholds(part.where("NOT aside"), bins)
    left = saved(binned(part, cuts), "labelled-statistics")
    rules: list[Rule] = []
    while len(rules) < most_rules:
        conditions: list[Condition] = []
        covered = left.where("NOT aside")
        while len(conditions) < MOST_CONDITIONS:
            found = best_condition(covered, cuts)
            if found is None:
                break
            conditions.append(found[1])
            covered = covered.where(found[1].sql())
            if not found[3]:
                break
        if not conditions:
            break
        # every prefix of the conjunction, on the rows kept aside
        held = [Rule(tuple(conditions[:i])).sql() for i in range(1, len(conditions) + 1)]
        kept_aside = left.where("aside").agg(*[F.coalesce(F.sum(F.when(F.expr(h), v)), F.lit(0)).alias(f"{n}{i}")
                                               for i, h in enumerate(held) for n, v in (("bad", F.col("low")), ("good", 1 - F.col("low")))]).first()
        score = [(r["bad"] + 1) / (r["bad"] + r["good"] + 2) for r in
                 ({n: kept_aside[f"{n}{i}"] for n in ("bad", "good")} for i in range(len(held)))]
        best = max(range(len(held)), key=lambda i: (score[i], -i))
        rule = Rule(tuple(conditions[:best + 1]))
        bad, good = kept_aside[f"bad{best}"], kept_aside[f"good{best}"]
        if bad < LEAST_COVER or bad < LEAST_PRECISION * (bad + good):
            break
        rules.append(rule)
        left = left.where(f"NOT ({rule.sql()})")
    return rules


def low_quality(rules: list[Rule]) -> Column:
    """The number of the first rule that fits, as one ordered CASE expression; null if none does."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(rule.sql()), i).otherwise(out)
    return out


# -------------------------------------------------------------------- operator

def labelled_statistics(statistics: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of the labelled rows: key, low. Labels without 0 or 1 are left out."""
    marks = labels.where("quality IN (0, 1)").select(F.col("doc_id").alias("key"), (1 - F.col("quality")).cast("long").alias("low"))
    return statistics.select(F.col("doc_id").alias("key"), *STATISTICS).join(marks, "key")


def quality_verdicts(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, the statistics, base_failed, rule, kept.

    ``row_col`` names a column (a struct of all columns, say) to carry along as ``row``, so that
    rows that share an id or have none keep their own verdict without a join."""
    carried = [F.col(row_col).alias("row")] if row_col else []
    rows = saved(with_statistics(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), *carried))
                 .select("doc_id", *STATISTICS, *(["row"] if row_col else [])), "text-statistics")
    rules = learn(labelled_statistics(rows, labels).where(~base_failed()))
    judged = rows.withColumn("base_failed", base_failed()).withColumn("rule", low_quality(rules))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull())
