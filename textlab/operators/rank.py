"""Exact ordered operations without a one-task window.

A window with no (or a low-cardinality) partition key pulls a whole group
into one task. These helpers cut the order key into value ranges from an
approximate-quantile sketch (``n_buckets`` doubles on the driver: a bound we
choose), run the window per (group, range), and add per-range offsets taken
from a small (groups x ranges) table. Results are exact: the sketch only
decides which task a row goes to, never the answer.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch_path

ROW = "_row"  # a row's own number, whatever its id
BUCKET = "_range_bucket"
KEY_TMP = "_range_key"
# Hex digits of the md5 order key used as its numeric prefix; the prefix is
# uniform on HASH_KEY_RANGE.
HASH_PREFIX_DIGITS = 12
HASH_KEY_RANGE = (0.0, float(16 ** HASH_PREFIX_DIGITS))


def written(df: DataFrame, name: str) -> DataFrame:
    """Written once to the shared checkpoint folder: read by several later steps."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def numbered(df: DataFrame, name: str = "numbered") -> DataFrame:
    """``df`` with a number of its own for every row, so rows that share an id or have none stay apart."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), name)


def default_buckets(df: DataFrame) -> int:
    return max(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16)


def range_buckets(df: DataFrame, key: str, n_buckets: int | None = None, rel_err: float | None = None,
                  key_range: tuple[float, float] | None = None) -> DataFrame:
    """Add ``_range_bucket``: equal-count value ranges of the numeric ``key``.

    The sketch's rank error is tied to the bucket count (a quarter of one
    bucket's share), so ranges stay balanced however many buckets a large
    shuffle asks for; the key must be non-null and (nearly) unique — heavy ties
    are combined into (value, count) rows first.

    ``key_range=(lo, hi)``: the key is uniform on [lo, hi) by construction (a
    hash prefix), so equal-width ranges are equal-count ranges and no sketch
    pass over the input is needed."""
    n = n_buckets or default_buckets(df)
    keyd = F.col(key).cast("double")
    if key_range is not None:
        lo, hi = key_range
        splits = [lo + (hi - lo) * i / n for i in range(1, n)]
    else:
        rel_err = rel_err if rel_err is not None else min(1e-3, 0.25 / n)
        probs = [i / n for i in range(1, n)]
        splits = df.select(keyd.alias(KEY_TMP)).approxQuantile(KEY_TMP, probs, rel_err)
    inner = sorted({s for s in splits if s is not None})
    edges = [float("-inf"), *inner, float("inf")]
    out = df.withColumn(KEY_TMP, keyd)
    if len(edges) < 3:
        return out.withColumn(BUCKET, F.lit(0.0)).drop(KEY_TMP)
    bucketizer = Bucketizer(splits=edges, inputCol=KEY_TMP, outputCol=BUCKET, handleInvalid="keep")
    return bucketizer.transform(out).drop(KEY_TMP)


def running_sums(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    sum_cols: Sequence[str],
    descending: bool = True,
    n_buckets: int | None = None,
) -> DataFrame:
    """Inclusive running sums of ``sum_cols`` in ``order_col`` order per group.

    The order key must be unique within a group (pre-aggregate ties first).
    Adds ``cum_<c>`` for every summed column.
    """
    group_cols = list(group_cols)
    b = range_buckets(df, order_col, n_buckets)
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    w_local = (Window.partitionBy(*group_cols, BUCKET).orderBy(order)
               .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = b
    for c in sum_cols:
        local = local.withColumn(f"_loc_{c}", F.sum(c).over(w_local))
    # totals come from the windowed frame, so both branches share one shuffle
    totals = local.groupBy(*group_cols, BUCKET).agg(*[F.sum(c).alias(f"_tot_{c}") for c in sum_cols])
    border = F.col(BUCKET).desc() if descending else F.col(BUCKET).asc()
    w_off = Window.partitionBy(*group_cols).orderBy(border).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *group_cols, BUCKET,
        *[F.coalesce(F.sum(f"_tot_{c}").over(w_off), F.lit(0)).alias(f"_off_{c}") for c in sum_cols],
    )
    joined = local.join(offsets, on=[*group_cols, BUCKET], how="inner")
    for c in sum_cols:
        joined = joined.withColumn(f"cum_{c}", F.col(f"_loc_{c}") + F.col(f"_off_{c}"))
    return joined.drop(BUCKET, *[f"_loc_{c}" for c in sum_cols], *[f"_off_{c}" for c in sum_cols])


def running_max(
    df: DataFrame,
    group_cols: Sequence[str],
    order_col: str,
    max_cols: Sequence[str],
    exclusive: bool = False,
    n_buckets: int | None = None,
) -> DataFrame:
    """Running maximum of ``max_cols`` in ascending ``order_col`` order per group
    (nulls skipped); ``exclusive`` looks only at earlier rows. Adds ``runmax_<c>``.
    The order key must be unique within a group."""
    group_cols = list(group_cols)
    b = range_buckets(df, order_col, n_buckets)
    hi = -1 if exclusive else Window.currentRow
    w_local = (Window.partitionBy(*group_cols, BUCKET).orderBy(F.col(order_col).asc())
               .rowsBetween(Window.unboundedPreceding, hi))
    local = b
    for c in max_cols:
        local = local.withColumn(f"_loc_{c}", F.max(c).over(w_local))
    totals = local.groupBy(*group_cols, BUCKET).agg(*[F.max(c).alias(f"_tot_{c}") for c in max_cols])
    w_off = (Window.partitionBy(*group_cols).orderBy(F.col(BUCKET).asc())
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, BUCKET, *[F.max(f"_tot_{c}").over(w_off).alias(f"_off_{c}") for c in max_cols])
    joined = local.join(offsets, on=[*group_cols, BUCKET], how="inner")
    for c in max_cols:
        joined = joined.withColumn(f"runmax_{c}", F.greatest(F.col(f"_loc_{c}"), F.col(f"_off_{c}")))
    return joined.drop(BUCKET, *[f"_loc_{c}" for c in max_cols], *[f"_off_{c}" for c in max_cols])


def global_row_number(
    df: DataFrame,
    bucket_key: str,
    order_cols: Sequence,
    group_cols: Sequence[str] = (),
    out: str = "rn",
    n_buckets: int | None = None,
    key_range: tuple[float, float] | None = None,
) -> DataFrame:
    """Exact ``row_number() over (partition by group_cols order by order_cols)``
    (1-based) without sending a group to one task.

    ``bucket_key`` is numeric and non-decreasing along ``order_cols`` (usually
    the first order column, or a monotone prefix of it); ``key_range`` as in
    ``range_buckets``.
    """
    group_cols = list(group_cols)
    b = range_buckets(df, bucket_key, n_buckets, key_range=key_range).withColumn("_one", F.lit(1))
    w_local = Window.partitionBy(*group_cols, BUCKET).orderBy(*order_cols)
    local = b.withColumn("_loc", F.row_number().over(w_local))
    totals = local.groupBy(*group_cols, BUCKET).agg(F.max("_loc").alias("_tot"))
    w_off = (Window.partitionBy(*group_cols).orderBy(F.col(BUCKET))
             .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select(*group_cols, BUCKET, F.coalesce(F.sum("_tot").over(w_off), F.lit(0)).alias("_off"))
    joined = local.join(offsets, on=[*group_cols, BUCKET], how="inner")
    return joined.withColumn(out, (F.col("_loc") + F.col("_off")).cast("long")).drop(BUCKET, "_one", "_loc", "_off")


def hash_order_key(seed: int, row_id_col: str = "row_id"):
    """Portable pseudo-random order: md5 of ``'<seed>-<row_id>'`` (same in DuckDB).

    Returns (md5 string column, monotone numeric prefix for bucketing).
    """
    h = F.md5(F.concat(F.lit(f"{seed}-"), F.col(row_id_col).cast("string")))
    prefix = F.conv(F.substring(h, 1, HASH_PREFIX_DIGITS), 16, 10).cast("long")
    return h, prefix


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], n_buckets: int | None = None) -> list:
    """Exact linear-interpolation quantiles (position p * (n - 1), as the SQL
    ``percentile`` / ``quantile_cont``) without holding the column in one buffer.

    Values are first combined into (value, count) — a value holding a third of
    all rows is one partial row per task — then a range-bucketed running sum
    over the distinct values gives each value's rank interval; only the rows
    covering the needed ranks (at most two per probability) reach the driver."""
    vals = df.select(F.col(col).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    # (value, count) is read by the range sketch, the total and the rank lookup:
    # written once to the shared checkpoint folder, not re-aggregated per pass
    from ..session import ensure_checkpoint_dir
    ensure_checkpoint_dir(df.sparkSession)
    counts = vals.groupBy("_v").agg(F.count(F.lit(1)).alias("_n")).checkpoint(eager=True)
    cum = running_sums(counts, [], "_v", ["_n"], descending=False, n_buckets=n_buckets)
    n = cum.agg(F.max("cum__n")).first()[0]
    if not n:
        return [None for _ in probs]
    pos = [p * (n - 1) for p in probs]
    need = sorted({int(x // 1) for x in pos} | {int(-(-x // 1)) for x in pos})
    cond = None
    for r in need:  # 0-based rank r lies in [cum - n, cum)
        c = (F.col("cum__n") - F.col("_n") <= r) & (F.col("cum__n") > r)
        cond = c if cond is None else cond | c
    rows = cum.where(cond).select("_v", "_n", "cum__n").collect()
    at = {}
    for r in need:
        for row in rows:
            if row["cum__n"] - row["_n"] <= r < row["cum__n"]:
                at[r] = row["_v"]
    out = []
    for x in pos:
        lo, hi = int(x // 1), int(-(-x // 1))
        out.append(at[lo] if lo == hi else (hi - x) * at[lo] + (x - lo) * at[hi])
    return out
