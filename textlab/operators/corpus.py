"""Corpus operators: joins, projections, profiling, dedup, splits, sampling, weights.

Corpus schema: ``row_id long, dataset string, split string, text string, label int``
(``row_id`` replaces pandas row order; every order-sensitive rule uses it).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import token_count
from .rank import HASH_KEY_RANGE, global_row_number, hash_order_key, written

# ---------------------------------------------------------------- joins / projections


def join_text_labels(texts: DataFrame, labels: DataFrame, key: str = "index") -> DataFrame:
    """Inner equi join of a text table and a label table on ``key``."""
    return texts.join(labels, on=key, how="inner")


def align_predictions(truth: DataFrame, preds: DataFrame, key: str = "row_id") -> DataFrame:
    """Ids, truths and predictions side by side: equi join on the row key."""
    return truth.join(preds, on=key, how="inner")


def union_corpora(*frames: DataFrame) -> DataFrame:
    """UNION ALL by column name; missing columns become null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def project_text_label(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    return df.select(text_col, label_col)


def canonical_rename(df: DataFrame, text_col: str, label_col: str) -> DataFrame:
    return df.withColumnsRenamed({text_col: "text", label_col: "label"})


def binarize_label(col, positive: str):
    """1 when the value equals ``positive``, else 0 (null -> 0)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.eqNullSafe(F.lit(positive)), F.lit(1)).otherwise(F.lit(0))


def drop_null_rows(df: DataFrame, subset: Sequence[str] = ("text", "label")) -> DataFrame:
    return df.dropna(how="any", subset=list(subset))


def cast_label(df: DataFrame, text_col: str = "text", label_col: str = "label") -> DataFrame:
    return df.withColumns({text_col: F.col(text_col).cast("string"), label_col: F.col(label_col).cast("int")})


def drop_all_null_columns(df: DataFrame) -> DataFrame:
    """Drop the *columns* that hold only nulls (one aggregation pass)."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns]).first()
    return df.drop(*[c for c in df.columns if counts[c] == 0])


def add_row_index(df: DataFrame, order_col: str = "row_id", out: str = "index") -> DataFrame:
    """0-based consecutive index in ``order_col`` order, without a one-task sort."""
    return global_row_number(df, order_col, [F.col(order_col)], out=out).withColumn(out, F.col(out) - 1)


def label_name_lookup(col, names: Sequence[str]):
    """id -> name through a literal map (unknown id -> null)."""
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(i), F.lit(n))])
    c = F.col(col) if isinstance(col, str) else col
    return F.element_at(m, c)


def label_id_lookup(col, names: Sequence[str]):
    m = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    c = F.col(col) if isinstance(col, str) else col
    return F.element_at(m, c)


# ---------------------------------------------------------------- profiling


def class_distribution(df: DataFrame, label_col: str = "label", names: Sequence[str] | None = None) -> DataFrame:
    """count and percent per label (ordered by label), with its name."""
    g = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("count"))
    total = F.sum("count").over(Window.partitionBy())  # tiny: one row per class
    out = g.withColumn("percent", F.col("count") * 100.0 / total)
    name = label_name_lookup("label", names) if names else F.col("label").cast("string")
    return out.withColumn("name", name).orderBy("label")


def class_weights(df: DataFrame, label_col: str = "label", mode: str = "balanced") -> DataFrame:
    """``balanced``: n / (k * n_c), k = labels present; ``inverse``: n / n_c."""
    g = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n_c"))
    w = Window.partitionBy()  # one row per class
    n = F.sum("n_c").over(w)
    k = F.count(F.lit(1)).over(w)
    weight = n / (k * F.col("n_c")) if mode == "balanced" else n / F.col("n_c")
    return g.select("label", "n_c", weight.cast("double").alias("weight"))


def minority_class(df: DataFrame, label_col: str = "label") -> DataFrame:
    """Label with the smallest count; ties -> smallest label."""
    g = df.groupBy(F.col(label_col).alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.min_by(F.col("label"), F.struct("n", "label")).alias("minority_label"),
                 F.min("n").alias("minority_count"))


def null_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Per column null count, plus any-null flag and total null cells (one pass)."""
    cols = list(cols or df.columns)
    per = [F.coalesce(F.sum(F.when(F.col(f"`{c}`").isNull(), 1).otherwise(0)), F.lit(0)).cast("long").alias(c) for c in cols]
    g = df.agg(*per)
    total = sum((F.col(f"`{c}`") for c in cols), F.lit(0))
    return g.select(*cols, total.cast("long").alias("total_nulls"), (total > 0).alias("has_nulls"))


def text_digest(col):
    """32-byte SHA-256 of a text (null stays null): a compact exact shuffle key."""
    c = F.col(col) if isinstance(col, str) else col
    return F.unhex(F.sha2(c, 256))


def duplicate_count(df: DataFrame, cols: Sequence[str] = ("text",)) -> DataFrame:
    """Rows beyond the first per value (null equals null); partial aggregation
    first. A single string column is grouped by its digest, not its full text."""
    cols = list(cols)
    if len(cols) == 1 and df.schema[cols[0]].dataType.typeName() == "string":
        keys = [text_digest(cols[0]).alias("_d")]
    else:
        keys = cols
    g = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return g.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"),
                 F.count(F.lit(1)).alias("distinct_values"))


def column_profile(df: DataFrame, col: str) -> DataFrame:
    """count, nulls, mean, sample stddev, min, exact quartiles and max of a numeric column.

    The quartiles come from an exact distributed rank (``exact_quantiles``), not
    from an aggregate that buffers every distinct value of the column."""
    from .rank import exact_quantiles
    c = F.col(col).cast("double")
    q = exact_quantiles(df, col, [0.25, 0.5, 0.75])
    return df.agg(
        F.count(c).alias("count"),
        F.sum(F.when(c.isNull(), 1).otherwise(0)).cast("long").alias("nulls"),
        F.avg(c).alias("mean"), F.stddev_samp(c).alias("stddev"), F.min(c).alias("min"),
        F.lit(q[0]).cast("double").alias("p25"), F.lit(q[1]).cast("double").alias("p50"),
        F.lit(q[2]).cast("double").alias("p75"), F.max(c).alias("max"),
    )


def table_profile(df: DataFrame) -> DataFrame:
    """One row per column of ``df``: count, nulls, distinct values, count of the most frequent value, text lengths
    (of strings) and mean, deviation, range and exact quartiles (of numbers).

    Values of all columns are counted in one pass by (column, digest), combined map-side."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.sha2(F.col(f"`{c}`").cast("string"), 256).alias("digest"),
                               F.length(F.col(f"`{c}`").cast("string")).cast("long").alias("length")) for c in df.columns])
    counted = (df.select(F.explode(cells).alias("cell")).select("cell.*").groupBy("column", "digest")
               .agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("chars"), F.min("length").alias("low"), F.max("length").alias("high")))
    present = F.col("digest").isNotNull()
    general = counted.groupBy("column").agg(
        F.coalesce(F.sum(F.when(present, F.col("n"))), F.lit(0)).alias("count"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls"),
        F.count("digest").alias("distinct_values"), F.max(F.when(present, F.col("n"))).alias("top_count"),
        F.sum("chars").alias("_chars"), F.min("low").alias("_low"), F.max("high").alias("_high"))
    texts = [f.name for f in df.schema.fields if f.dataType.typeName() == "string"]
    numbers = [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]
    is_text = F.col("column").isin(texts)
    general = general.select(
        "column", "count", "nulls", "distinct_values", "top_count", F.when(is_text, F.col("_chars") / F.col("count")).alias("mean_length"),
        F.when(is_text, F.col("_low")).alias("min_length"), F.when(is_text, F.col("_high")).alias("max_length"))
    if not numbers:
        return general
    measured = None
    for c in numbers:
        one = column_profile(df, c).drop("count", "nulls").withColumn("column", F.lit(c))
        measured = one if measured is None else measured.unionByName(one)
    return general.join(measured, "column", "left")


def token_length_stats(df: DataFrame, text_col: str = "text", by: Sequence[str] = ()) -> DataFrame:
    """max / min / mean whitespace-token count per text, for each group of ``by`` and, in the row whose ``by``
    columns read ``all``, for the union of the groups: one pass with grouping sets. A null group stays null."""
    by = list(by)
    t = df.select(*by, token_count(text_col).cast("long").alias("tokens"))
    stats = [F.max("tokens").alias("max_tokens"), F.min("tokens").alias("min_tokens"),
             F.avg("tokens").alias("mean_tokens"), F.count(F.lit(1)).alias("texts")]
    if not by:
        return t.agg(*stats)
    sets = t.groupingSets([[F.col(c) for c in by], []], *[F.col(c) for c in by]).agg(*stats, F.grouping_id().alias("_all"))
    union = F.col("_all") > 0
    return sets.select(*[F.when(union, "all").otherwise(F.col(c).cast("string")).alias(c) for c in by], "max_tokens", "min_tokens", "mean_tokens", "texts")


def split_conservation(df: DataFrame, split_col: str = "split") -> DataFrame:
    """Rows per split and the total; ``conserved`` says the parts add up."""
    g = df.groupBy(split_col).agg(F.count(F.lit(1)).alias("n"))
    piv = g.agg(
        F.sum(F.when(F.col(split_col) == "train", F.col("n")).otherwise(0)).alias("train"),
        F.sum(F.when(F.col(split_col) == "validation", F.col("n")).otherwise(0)).alias("validation"),
        F.sum(F.when(F.col(split_col) == "test", F.col("n")).otherwise(0)).alias("test"),
        F.sum("n").alias("total"),
    )
    return piv.withColumn("conserved", F.col("train") + F.col("validation") + F.col("test") == F.col("total"))


def corpus_unigrams(df: DataFrame, text_col: str = "text", min_count: int = 1) -> DataFrame:
    """Word counts (lower-cased Unicode word runs); partial aggregation before the shuffle."""
    words = df.select(F.explode(F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(r"[\p{L}\p{N}_]+"), 0)).alias("word"))
    g = words.groupBy("word").agg(F.count(F.lit(1)).alias("count"))
    return g.where(F.col("count") >= min_count)


# ---------------------------------------------------------------- dedup


def dedup_keep_first(df: DataFrame, text_col: str = "text", splits: Sequence[str] | None = ("train", "validation"),
                     split_col: str = "split", order_col: str = "row_id") -> DataFrame:
    """First row (smallest ``order_col``) per raw text within each split listed in
    ``splits``; other splits pass untouched; null texts collapse to one row.

    A hot text is combined map-side (min per digest), never sent whole to one
    task; survivors are then kept by a semi join on the unique row key.
    """
    digest = text_digest(text_col)
    scope = F.col(split_col).isin(list(splits)) if splits is not None else F.lit(True)
    cand = df.where(scope)
    firsts = (cand.groupBy(split_col, digest.alias("_d"))
              .agg(F.min(order_col).alias("_first")).select(F.col(split_col).alias("_split"), "_first"))
    # the key is (split, row): files that number their rows alike stay apart
    kept = cand.join(firsts, F.col(split_col).eqNullSafe(F.col("_split")) & (F.col(order_col) == F.col("_first")), "left_semi")
    if splits is None:
        return kept
    rest = df.where(~scope | F.col(split_col).isNull())
    return kept.unionByName(rest)


# ---------------------------------------------------------------- splits / sampling


def few_shot_sample(df: DataFrame, n: int, seed: int = 42, label_col: str = "label",
                    classes: Sequence[int] | None = None) -> DataFrame:
    """``min(n, class size)`` rows per class without replacement, seeded order.

    ``row_number() <= n`` over a label window is planned by Spark with a
    per-partition group limit before the shuffle, so each class ships at most
    ``n`` rows per input partition.
    """
    h, _ = hash_order_key(seed)
    src = df if classes is None else df.where(F.col(label_col).isin(list(classes)))
    w = Window.partitionBy(label_col).orderBy(h, F.col("row_id"))
    return src.withColumn("shot", F.row_number().over(w).cast("long")).where(F.col("shot") <= n)


def _ceil_count(n: int, ratio: float) -> int:
    return int(math.ceil(n * ratio))


def random_split(df: DataFrame, test_ratio: float = 0.25, val_ratio: float = 0.20, seed: int = 42,
                 order_col: str = "row_id", out: str = "split", own_test: Column | None = None) -> DataFrame:
    """Exact-size shuffle split: ``ceil(n*test)`` test rows, ``ceil(rest*val)``
    validation rows, the remainder train; order = md5 of (seed, row_id).

    A source that brings its own test split names its rows by ``own_test``: they are the
    test part as they are, and only the others are cut, into train and validation."""
    if own_test is not None:
        mine = F.coalesce(own_test, F.lit(False))
        rest = random_split(df.where(~mine), 0.0, val_ratio, seed, order_col, out)
        return rest.unionByName(df.where(mine).withColumn(out, F.lit("test")))
    n = df.count()
    n_test = _ceil_count(n, test_ratio)
    n_val = _ceil_count(n - n_test, val_ratio)
    # only (hash, id) pairs are ranked; the rows are then labelled by comparison with two cut values
    h, _ = hash_order_key(seed, order_col)
    ranked = _hash_ranked(df, seed, order_col)
    id_type = df.schema[order_col].dataType
    cuts = {r["_rn"]: F.struct(F.lit(r["_h"]).alias("h"), F.lit(r[order_col]).cast(id_type).alias("id"))
            for r in ranked.where(F.col("_rn").isin(n_test, n_test + n_val)).collect()}  # two rows
    place = F.struct(h.alias("h"), F.col(order_col).alias("id"))
    split = F.when(place <= cuts[n_test], "test") if n_test else F.when(F.lit(False), "test")
    if n_val:
        split = split.when(place <= cuts[n_test + n_val], "validation")
    return df.withColumn(out, split.otherwise("train"))


def _hash_ranked(df: DataFrame, seed: int, order_col: str, group_cols: Sequence[str] = ()) -> DataFrame:
    """(groups, id, _h, _rn): exact rank of every row by its seeded hash, without the other columns."""
    h, prefix = hash_order_key(seed, order_col)
    keys = df.select(*group_cols, order_col, h.alias("_h"), prefix.alias("_hp"))
    return global_row_number(keys, "_hp", [F.col("_h"), F.col(order_col)], group_cols=group_cols, out="_rn", key_range=HASH_KEY_RANGE)


def stratified_quotas(counts: dict[int, int], ratio: float) -> dict[int, int]:
    """Largest-remainder quotas of ``ceil(n * ratio)`` rows over the classes;
    ties of the remainder go to the smaller label."""
    n = sum(counts.values())
    if not n:
        return {}
    total = _ceil_count(n, ratio)
    exact = {c: total * k / n for c, k in counts.items()}
    base = {c: int(math.floor(v)) for c, v in exact.items()}
    left = total - sum(base.values())
    order = sorted(counts, key=lambda c: (-(exact[c] - base[c]), c))
    for c in order[:left]:
        base[c] += 1
    return base


def stratified_split(df: DataFrame, test_ratio: float = 0.25, seed: int = 42, label_col: str = "label",
                     order_col: str = "row_id", out: str = "split") -> DataFrame:
    """Two-way split keeping class ratios: per class the first quota rows (by
    seeded hash) go to ``test``; quotas come from the (tiny) class counts."""
    counts = {r[0]: r[1] for r in df.groupBy(label_col).count().collect()  # one row per class
              if r[0] is not None}  # rows without a label go to train
    quotas = stratified_quotas(counts, test_ratio)
    if not quotas:
        return df.withColumn(out, F.lit("train"))
    h, _ = hash_order_key(seed, order_col)
    ranked = _hash_ranked(df.where(F.col(label_col).isNotNull()), seed, order_col, [label_col])
    quota = F.element_at(F.create_map(*[x for c, q in sorted(quotas.items()) for x in (F.lit(c), F.lit(q))]), F.col(label_col))
    # one row per class: the last hash and id that go to the test part
    cuts = ranked.where(F.col("_rn") == quota).select(F.col(label_col).alias("_class"), F.struct("_h", order_col).alias("_cut"))
    cut = df.join(cuts, F.col(label_col) == F.col("_class"), "left")
    inside = F.struct(h.alias("_h"), F.col(order_col)) <= F.col("_cut")
    return cut.withColumn(out, F.when(inside, "test").otherwise("train")).drop("_class", "_cut")


def batch_assignment(df: DataFrame, batch_size: int, order_col: str = "row_id", out: str = "batch") -> DataFrame:
    """Consecutive chunks of ``batch_size`` rows in ``order_col`` order."""
    r = global_row_number(df, order_col, [F.col(order_col)], out="_rn")
    return r.withColumn(out, F.floor((F.col("_rn") - 1) / batch_size).cast("long")).drop("_rn")


def length_bucketed_batches(df: DataFrame, length_col: str, batch_size: int, width: int,
                            order_col: str = "row_id") -> DataFrame:
    """Rows of like length share a batch: bucket = floor(len / width), then
    consecutive chunks inside the bucket."""
    x = df.withColumn("length_bucket", F.floor(F.col(length_col) / width).cast("long"))
    r = global_row_number(x, order_col, [F.col(order_col)], group_cols=["length_bucket"], out="_rn")
    return r.withColumn("batch_in_bucket", F.floor((F.col("_rn") - 1) / batch_size).cast("long")).drop("_rn")


def length_grouped_batches(df: DataFrame, length_col: str, batch_size: int, seed: int = 42, mega: int = 50,
                           order_col: str = "row_id") -> DataFrame:
    """Shuffled batches of rows of like length: a seeded order of all rows is cut into mega-batches of ``mega``
    batches, each is sorted by descending length, and the longest row of all changes places with the first one, so
    that the first batch needs the most memory. Adds ``batch`` and ``place`` (both from 0, in training order).

    The order is an exact rank over hash ranges; a mega-batch is a bounded window. Null lengths count as zero;
    ties go by the seeded order, the longest row is the first such in it."""
    h, prefix = hash_order_key(seed, order_col)
    size = mega * batch_size
    keyed = df.withColumns({"_h": h, "_hp": prefix, "_len": F.coalesce(F.col(length_col).cast("long"), F.lit(0).cast("long"))})
    ranked = global_row_number(keyed, "_hp", ["_h", order_col], out="_rn", key_range=HASH_KEY_RANGE)
    cut = ranked.withColumn("_mega", F.floor((F.col("_rn") - 1) / size).cast("long"))
    inside = Window.partitionBy("_mega").orderBy(F.desc("_len"), "_rn")
    placed = cut.withColumn("_in", F.row_number().over(inside) - 1).withColumn("_at", F.col("_mega") * size + F.col("_in"))
    placed = written(placed.drop("_h", "_hp", "_mega", "_in"), "length-grouped")
    longest = placed.agg(F.min_by("_at", F.struct(-F.col("_len"), "_rn"))).first()[0]  # one number
    if longest is None:
        longest = 0
    place = F.when(F.col("_at") == longest, 0).when(F.col("_at") == 0, longest).otherwise(F.col("_at")).cast("long")
    return placed.withColumn("place", place).withColumn("batch", F.floor(F.col("place") / batch_size).cast("long")).drop("_len", "_rn", "_at")


def padding_share(batches: DataFrame, length_col: str, batch_col: str = "batch") -> DataFrame:
    """(tokens, padding, share): what padding every row to its batch's longest adds."""
    per = batches.groupBy(batch_col).agg(F.max(length_col).alias("longest"), F.count(F.lit(1)).alias("rows"), F.sum(length_col).alias("used"))
    return per.agg(F.sum("used").alias("tokens"), F.sum(F.col("longest") * F.col("rows") - F.col("used")).alias("padding")).withColumn(
        "share", F.col("padding") / (F.col("tokens") + F.col("padding")))
