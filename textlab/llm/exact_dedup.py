"""Exact deduplication with a heavy-hitter split.

A Misra-Gries pass names the digests that may be frequent, an exact count
verifies them, and the verified winners (at most ``k`` rows) are broadcast:
rows of a winner get their verdict map-side and never shuffle. What is left
holds no digest above ``2/(k+1)`` of the rows, so an ordinary shuffle is even.

Defined results: a null text counts as empty; an empty table gives an empty
result; rows without an id never beat rows with one, and a group of only null
ids has ``keep_id`` null with every row kept; rows that repeat the same id and
text share the group's verdict (all copies of the smallest id are ``kept``).
Other input columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, saved, text_or_empty

# Counters of a Misra-Gries summary; also the bound of the broadcast winners.
COUNTERS = 256


def misra_gries(df: DataFrame, col: str, k: int) -> DataFrame:
    """At most ``k`` rows (value, est) that hold every value above 2/(k+1) of the rows.

    One mergeable summary per task (error at most rows/(k+1)); summaries add up
    by value, so at most ``k`` values can keep an estimate above that error."""
    def summarise(batches):
        counts: Counter = Counter()
        for batch in batches:
            seen = pc.value_counts(batch.column(0))
            for v, c in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist()):
                counts[v] += c
            if len(counts) > k:
                cut = sorted(counts.values(), reverse=True)[k]
                counts = Counter({v: c - cut for v, c in counts.items() if c > cut})
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["value", "est"])

    parts = df.select(F.col(col).cast("binary")).mapInArrow(summarise, "value binary, est bigint")
    return parts.groupBy("value").agg(F.sum("est").alias("est")).orderBy(F.desc("est"), "value").limit(k)


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = COUNTERS) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256."""
    plain = F.regexp_replace(text_or_empty(text_col), SPACE + "+", " ")
    rows = saved(df.select(F.col(id_col).alias("doc_id"), F.unhex(F.sha2(plain, 256)).alias("digest")), "digests")
    total = rows.count()
    maybe = F.broadcast(misra_gries(rows, "digest", k).select(F.col("value").alias("digest")))
    verdict = [F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    winners = saved(rows.join(maybe, "digest").groupBy("digest").agg(*verdict)
                    .where(F.col("group_size") * (k + 1) > total), "heavy")
    hot = rows.join(F.broadcast(winners), "digest")
    rest = rows.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    cold = rest.join(rest.groupBy("digest").agg(*verdict), "digest")
    return hot.unionByName(cold).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"))
