"""Hard negatives by inner product, with length buckets and coordinate pruning.

Rows lie in blocks of descending vector length; anchors visit the blocks they
can still profit from. Inside a block, buckets of similar length hold their unit
vectors' coordinates in sorted lists. A row can reach a score of ``t`` with an
anchor ``q`` only if its cosine is at least ``c = t / (|q| longest)``, and then
each coordinate of its unit vector lies within a range around ``c`` times the
anchor's. The ranges of the anchor's largest coordinates are cut out of the
sorted lists, the rows inside all of them are the candidates, and their exact
integer products decide. Where the ranges leave most of a bucket, the bucket's
rows are all candidates and verified by one matrix product.

The threshold ``t`` is the worst result an anchor still needs. It rises from
bucket to bucket, and between rounds of blocks (each eight times as many as the
last) from the best rows so far, so later, shorter blocks are skipped or pruned
and return few rows. Positives are found first; the second scan asks for the
negatives of all positives of an anchor at once, within their score limits.

Rows are dealt to blocks, never by label or id, so a label or a vector that holds
a third of the rows is spread; a task holds one block (``BLOCK`` rows at most) and
a batch of anchors. Thresholds only skip rows that score strictly less.

Defined results: rows with a null label or vector or a null or non-finite
component take no part; shorter vectors count as padded with zeros; a null id is
no anchor and comes last among equal scores; rows that repeat an id are rows of
their own; components and scores beyond the long range are cut to it; an empty
table gives an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

BLOCK = 131_072     # rows of a block at most (one task's index)
BLOCKS = 16         # blocks at least, for parallel work on small tables
GROWTH = 8          # a round has so many times the blocks of the last
BUCKET = 8_192      # rows of a length bucket
FOCUS = 3           # coordinates looked up per anchor
BATCH = 256         # anchors multiplied at once
NO_ID = np.iinfo(np.int64).max
LOWEST = np.iinfo(np.int64).min
LIMITS = (np.iinfo(np.int64).min, np.iinfo(np.int64).max)


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
            scale: int = 256) -> DataFrame:
    """id, label, v (``floor(scale * x)``) and length of the rows that take part."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    rows = df.where(F.col(label_col).isNotNull() & F.col(vector_col).isNotNull() & ~F.coalesce(bad, F.lit(True))).select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("bigint").alias("label"),
        F.transform(vector_col, lambda x: F.floor(x.cast("double") * scale).cast("bigint")).alias("v"))
    return rows.withColumn("length", F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))))


def blocks_of(rows: DataFrame, n_rows: int) -> DataFrame:
    """``vectors`` in blocks of descending length, written once; equal lengths are spread by row number."""
    n = max(BLOCKS, ceil(n_rows / BLOCK))
    return saved(rows.withColumn("row_no", F.monotonically_increasing_id())
                 .repartitionByRange(n, F.desc("length"), "row_no").withColumn("block", F.spark_partition_id().cast("bigint")), "blocks")


# ----------------------------------------------------------------- inside a task

def matrix(lists: pa.Array) -> np.ndarray:
    """Rows of a list<bigint> column, padded with zeros to the longest."""
    flat, ends = lists.flatten().to_numpy(), np.cumsum(sizes := np.asarray(lists.value_lengths()).astype(np.int64))
    if len(sizes) and (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.zeros((len(sizes), sizes.max(initial=0)), np.int64)
    for i, (end, size) in enumerate(zip(ends, sizes)):
        out[i, :size] = flat[end - size:end]
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) if x.shape[1] < width else x for x in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer products of all rows of ``a`` with all of ``b`` (cut to the long range)."""
    most = float(np.abs(a.astype(float)).max(initial=0)) * float(np.abs(b.astype(float)).max(initial=0)) * max(a.shape[1], 1)
    if most < 2 ** 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if most < 2 ** 62:
        return a @ b.T
    return np.clip(a.astype(object) @ b.astype(object).T, *LIMITS).astype(np.int64)


class Bucket:
    """Rows of similar length with sorted lists of their unit vectors' coordinates."""

    def __init__(self, v, length):
        self.v, self.length, self.longest = v, length, float(length.max())
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, f: int) -> tuple[np.ndarray, np.ndarray]:
        if f not in self.lists:
            unit = np.divide(self.v[:, f].astype(float), self.length, out=np.zeros(len(self.v)), where=self.length > 0)
            order = np.argsort(unit, kind="stable")
            self.lists[f] = (unit[order], order)
        return self.lists[f]

    def candidates(self, q: np.ndarray, q_length: float, least: float):
        """Rows that may score ``least`` or more with ``q``: None for all, else their places."""
        reach = q_length * self.longest
        if least > reach * (1 + 1e-9):
            return np.zeros(0, np.int64)
        if least <= 0 or reach == 0:
            return None
        c = min(least / reach, 1.0)
        focus = np.argsort(-np.abs(q), kind="stable")[:FOCUS]
        counts, wanted = None, len(self.v)
        for n, f in enumerate(focus):
            x = q[f] / q_length
            half = np.sqrt(max((1 - c * c) * (1 - min(x * x, 1.0)), 0.0)) + 1e-7
            low = c * x - half if x > -c else -1.0
            high = c * x + half if x < c else 1.0 + 1e-7
            values, order = self.sorted_list(int(f))
            inside = order[np.searchsorted(values, low, "left"):np.searchsorted(values, high, "right")]
            if n == 0 and len(inside) > wanted // 2:
                return None
            counts = np.zeros(wanted, np.int8) if counts is None else counts
            counts[inside] += 1
        return np.flatnonzero(counts == len(focus))


class Index:
    """One block: its rows by descending length, cut into buckets."""

    def __init__(self, parts):
        v = [matrix(p.column("v").combine_chunks() if isinstance(p.column("v"), pa.ChunkedArray) else p.column("v")) for p in parts]
        width = max((m.shape[1] for m in v), default=0)
        self.v = np.concatenate([np.pad(m, ((0, 0), (0, width - m.shape[1]))) for m in v])
        get = lambda name: np.concatenate([p.column(name).to_numpy(zero_copy_only=False) for p in parts])
        length = get("length")
        order = np.argsort(-length, kind="stable")
        self.v, self.length = self.v[order], length[order]
        self.label, self.row_no = get("label")[order], get("row_no")[order]
        self.id = np.concatenate([p.column("id").fill_null(NO_ID).to_numpy() for p in parts])[order]
        self.buckets = [(at, Bucket(self.v[at:at + BUCKET], self.length[at:at + BUCKET])) for at in range(0, len(self.v), BUCKET)]

    def scan(self, q: np.ndarray, q_length: np.ndarray, wants) -> None:
        """Offers every wanted row to the wants: one ``Want`` per anchor."""
        _, q = same_width(self.v[:1], q)
        for at, bucket in self.buckets:
            rows, _ = same_width(bucket.v, q[:1])
            whole = []
            for i, want in enumerate(wants):
                places = bucket.candidates(q[i], q_length[i], float(want.least))
                if places is None:
                    whole.append(i)
                elif len(places):
                    want.offer(self, at + places, products(q[i:i + 1], rows[places])[0])
            for start in range(0, len(whole), BATCH):
                part = whole[start:start + BATCH]
                for i, scores in zip(part, products(q[part], rows)):
                    near = np.flatnonzero(scores >= wants[i].least)
                    if len(near):
                        wants[i].offer(self, at + near, scores[near])


class Best:
    """The best ``k`` rows so far: (score, id, row_no), score descending, then id, then row."""

    def __init__(self, k: int, least: int):
        self.k, self.least, self.rows = k, least, np.zeros((0, 3), np.int64)

    def add(self, index: Index, places, scores) -> None:
        if len(scores) > self.k:
            kth = np.partition(scores, -self.k)[-self.k]
            keep = scores >= kth
            places, scores = places[keep], scores[keep]
        rows = np.concatenate([self.rows, np.stack([scores, index.id[places], index.row_no[places]], axis=1)])
        self.rows = rows[np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0].astype(object) if (rows[:, 0] == LOWEST).any() else -rows[:, 0]))][:self.k]
        if len(self.rows) == self.k:
            self.least = max(self.least, int(self.rows[-1, 0]))


class Positives:
    """Wants the best ``k`` other rows of the anchor's label."""

    def __init__(self, anchor: dict, k: int):
        self.label, self.row_no = anchor["label"], anchor["a_row"]
        self.best = [Best(k, LOWEST if anchor["least"] is None else anchor["least"][0])]

    @property
    def least(self) -> int:
        return self.best[0].least

    def offer(self, index, places, scores) -> None:
        fit = (index.label[places] == self.label) & (index.row_no[places] != self.row_no)
        if fit.any():
            self.best[0].add(index, places[fit], scores[fit])


class Negatives:
    """Wants, for each positive, the best ``k`` rows of other labels whose scores lie within its limits."""

    def __init__(self, anchor: dict, k: int):
        self.label, self.limits = anchor["label"], anchor["limits"]
        known = anchor["least"] or [None] * len(self.limits)
        self.best = [Best(k, lim[0] if least is None else max(lim[0], least)) for lim, least in zip(self.limits, known)]

    @property
    def least(self) -> int:
        return min((b.least for b, lim in zip(self.best, self.limits) if lim[0] <= lim[1]), default=LIMITS[1])

    def offer(self, index, places, scores) -> None:
        other = index.label[places] != self.label
        places, scores = places[other], scores[other]
        for best, (_, high) in zip(self.best, self.limits):
            fit = (scores >= best.least) & (scores <= high)
            if fit.any():
                best.add(index, places[fit], scores[fit])


RESULT = "a_row bigint, want int, score bigint, id bigint, row_no bigint"


def scanned(blocks: DataFrame, anchors: DataFrame, visits: Column, kind, k: int) -> DataFrame:
    """The best rows each visited block has for each anchor. ``anchors``: a_row, label, v, length, least, limits."""
    extra = "least array<bigint>, limits array<array<bigint>>"
    rows = blocks.select("block", F.lit(0).alias("tag"), "row_no", "id", "label", "v", "length",
                         *[F.lit(None).cast(t.split(" ", 1)[1]).alias(t.split(" ")[0]) for t in extra.split(", ")])
    asks = anchors.select(F.explode(visits).alias("block"), F.lit(1).alias("tag"), F.col("a_row").alias("row_no"),
                          F.lit(None).cast("bigint").alias("id"), "label", "v", "length", "least", "limits")
    dealt = rows.unionByName(asks).repartition("block").sortWithinPartitions("block", "tag")

    def found(index, part):
        told = part.select(["label", "row_no", "least", "limits"]).to_pylist()
        wants = [kind({**t, "a_row": t["row_no"]}, k) for t in told]
        index.scan(matrix(part.column("v")), part.column("length").to_numpy(), wants)
        out = [(w.row_no if hasattr(w, "row_no") else t["row_no"], j, best.rows) for t, w in zip(told, wants) for j, best in enumerate(w.best) if len(best.rows)]
        if not out:
            return None
        sizes = [len(r) for _, _, r in out]
        rows = np.concatenate([r for _, _, r in out])
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([a for a, _, _ in out], sizes)), pa.array(np.repeat([j for _, j, _ in out], sizes).astype(np.int32)),
             pa.array(rows[:, 0]), pa.array(rows[:, 1], mask=rows[:, 1] == NO_ID), pa.array(rows[:, 2])],
            ["a_row", "want", "score", "id", "row_no"])

    def run(batches):
        block, parts, index = None, [], None
        for batch in batches:
            keys = batch.column("block").to_numpy() * 2 + batch.column("tag").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:]):
                part = batch.slice(a, b - a)
                if a == b:
                    continue
                if keys[a] // 2 != block:
                    block, parts, index = keys[a] // 2, [], None
                if keys[a] % 2 == 0:
                    parts.append(part)
                elif parts:
                    index = index or Index(parts)
                    for at in range(0, len(part), BATCH):
                        out = found(index, part.slice(at, BATCH))
                        if out is not None:
                            yield out

    return dealt.mapInArrow(run, RESULT)


def best_rows(blocks: DataFrame, anchors: DataFrame, kind, k: int, name: str) -> DataFrame:
    """The best ``k`` rows of every want: a_row, want, rank, score, id, row_no, in rounds of blocks.

    Block lengths (one number per block) come to the driver; they say which blocks an anchor
    whose threshold is known can skip."""
    longest = {r["block"]: r["m"] for r in blocks.groupBy("block").agg(F.max("length").alias("m")).collect()}
    order = sorted(longest, key=lambda b: -longest[b])
    place = Window.partitionBy("a_row", "want").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row_no")
    best, done, width = None, 0, BLOCKS
    while done < len(order) or best is None:
        now = order[done:done + width]
        least = F.array_min("least") if best is not None else F.lit(None).cast("bigint")
        table = F.array(*[F.struct(F.lit(b).cast("bigint").alias("b"), F.lit(float(longest[b])).alias("m")) for b in now]) if now \
            else F.array().cast("array<struct<b:bigint,m:double>>")
        visits = F.transform(F.filter(table, lambda t: least.isNull() | (least <= F.col("length") * t["m"] * (1 + 1e-9))), lambda t: t["b"])
        new = scanned(blocks.where(F.col("block").isin(now)), anchors, visits, kind, k)
        if best is not None:
            new = new.unionByName(best.drop("rank"))
        best = saved(new.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k), name)
        done, width = done + len(now), width * GROWTH
        if done < len(order):
            anchors = with_least(anchors, best, k)
    return best


def with_least(anchors: DataFrame, best: DataFrame, k: int) -> DataFrame:
    """Anchors with the score of each want's ``k``-th row so far (the lowest long where there are fewer)."""
    full = best.where(F.col("rank") == k).groupBy("a_row").agg(F.map_from_entries(F.collect_list(F.struct("want", "score"))).alias("full"))
    joined = anchors.drop("least").join(full, "a_row", "left")
    at = lambda j: F.coalesce(F.col("full")[j], F.lit(LOWEST))
    return joined.withColumn("least", F.transform(F.sequence(F.lit(0), F.greatest(F.size("limits"), F.lit(1)) - 1), at)).drop("full")


def hard_negatives(df: DataFrame, is_anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label",
                   positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: int = 256) -> DataFrame:
    """For each anchor row and each of its best ``positives`` rows of the same label, the best ``negatives`` rows of other
    labels that score ``low`` to ``high`` percent of the positive: anchor_id, positive_id, rank, negative_id,
    positive_score, negative_score, positive_rank. ``is_anchor`` is a condition on ``id``, the id column."""
    blocks = blocks_of(vectors(df, id_col, vector_col, label_col, scale), df.count())
    none = [F.lit(None).cast("array<bigint>").alias("least"), F.lit(None).cast("array<array<bigint>>").alias("limits")]
    anchors = blocks.where(is_anchor).select(F.col("row_no").alias("a_row"), F.col("id").alias("anchor_id"), "label", "v", "length", *none)
    near = best_rows(blocks, anchors, Positives, positives, "positives")
    part = F.col("score").cast("decimal(38,0)")
    limit = F.array(F.ceil(part * low / 100).cast("bigint"), F.floor(part * high / 100).cast("bigint"))
    per_anchor = near.groupBy("a_row").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score", limit.alias("limit")))).alias("near"))
    asking = saved(anchors.drop("limits").join(per_anchor, "a_row").withColumn("limits", F.col("near.limit")), "asking")
    far = best_rows(blocks, asking, Negatives, negatives, "negatives")
    return (far.join(asking.select("a_row", "anchor_id", "near"), "a_row")
            .withColumn("positive", F.element_at("near", F.col("want") + 1))
            .select("anchor_id", F.col("positive.id").alias("positive_id"), "rank", F.col("id").alias("negative_id"),
                    F.col("positive.score").alias("positive_score"), F.col("score").alias("negative_score"),
                    F.col("positive.rank").alias("positive_rank")))
