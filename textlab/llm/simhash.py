"""SimHash near-duplicates by anchor-point covering.

Every text gets a 64-bit fingerprint; equal fingerprints collapse into one row
first. Two fingerprints within ``2 * t`` bits are within ``t`` bits in one of
their 32-bit halves, so each half is searched with threshold ``t``.

Anchors of a half are the words of a covering code: the [31, 26] Hamming code on
its low 31 bits and every value of its top bit, 2^27 anchors with covering radius
1. A pair within ``t = 2`` bits has a midpoint one bit from both; the midpoint's
anchor is within radius + 1 = 2 bits of both fingerprints. So every fingerprint
is replicated to all anchors within 2 bits (at most 17 a half, found by syndrome
arithmetic, not by search), pairs are compared per anchor, and none is missed.

Inside an anchor the fingerprints are linked as a spanning forest of their
components, never as all pairs, so a group of thousands of near copies gives
thousands of links. An anchor that covers more than ``LARGE`` fingerprints (many can
share one half) is not held by one task: its fingerprints are dealt to blocks by hash
and every pair of blocks is one group, so memory stays bounded, the comparisons spread
over the cluster and no pair is lost. Components over all anchors come from alternating large-star
and small-star rounds on the links between distinct fingerprints.

Defined results: null and empty texts (no words) have fingerprint zero, which
links like any other; an empty table gives an empty result; repeated rows get one
result each; ids are compared as they are, a component of only null ids has a
null component id; further columns are ignored. With ``row_col`` one row of each
component is kept: the one with the smallest id (null last), then the smallest row.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import saved

SHINGLE = 4
SEED = 42
MAX_BITS = 4
LARGE = 20_000  # fingerprints of one anchor that one task compares at once
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

# Code words of weight 2 away by syndrome s are the pairs (i, i ^ s) of positions 1..31.
PAIRS = np.zeros((32, 16), np.uint64)
PAIR_COUNT = np.zeros(32, np.int64)
for _s in range(1, 32):
    _pairs = [(1 << (i - 1)) | (1 << ((i ^ _s) - 1)) for i in range(1, 32) if i < (i ^ _s)]
    PAIRS[_s, :len(_pairs)] = _pairs
    PAIR_COUNT[_s] = len(_pairs)
SYNDROME_MASKS = [sum(1 << (i - 1) for i in range(1, 32) if i >> b & 1) for b in range(5)]


# ---------------------------------------------------------------- fingerprints

def fingerprint(text: bytes, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes; A-Z count as a-z."""
    words = WORD.findall(text.lower())  # bytes.lower() changes A-Z only
    if not words:
        return 0
    flat, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[:len(words) - k] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(flat[a:b], seed) for a, b in zip(starts, ends[k - 1:].tolist())], ">u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(hashes[at:at + 4096].view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big", signed=True)


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                 seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """doc_id, row (if ``row_col`` is given) and fp of every row."""
    told = [F.col(id_col).alias("doc_id"), *([F.col(row_col).alias("row")] if row_col else [])]
    rows = df.select(*told, F.col(text_col).cast("string").cast("binary").alias("text"))

    def run(batches):
        for batch in batches:
            found = [fingerprint(t or b"", shingle, seed) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.int64())], [*batch.schema.names[:-1], "fp"])

    kinds = [f"{c.name} {c.dataType.simpleString()}" for c in rows.schema if c.name != "text"]
    return rows.mapInArrow(run, ", ".join([*kinds, "fp bigint"]))


# --------------------------------------------------------------------- anchors

def anchors(half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, anchor) of every code word within 2 bits of each 32-bit half."""
    low, top = half & np.uint64(0x7FFFFFFF), half & np.uint64(0x80000000)
    syndrome = np.zeros(len(half), np.int64)
    for b, mask in enumerate(SYNDROME_MASKS):
        syndrome |= (np.bitwise_count(low & np.uint64(mask)).astype(np.int64) & 1) << b
    nearest = np.where(syndrome > 0, low ^ (np.uint64(1) << (np.maximum(syndrome, 1) - 1).astype(np.uint64)), low)
    rows = np.arange(len(half))
    # the nearest code word with either top bit; without the top bit, those two flips away
    out_rows, out = [rows, rows], [nearest | top, nearest | (top ^ np.uint64(0x80000000))]
    width = int(PAIR_COUNT.max())
    far = rows[syndrome > 0]
    pairs = PAIRS[syndrome[far], :width]
    used = np.arange(width) < PAIR_COUNT[syndrome[far]][:, None]
    out_rows.append(np.repeat(far, PAIR_COUNT[syndrome[far]]))
    out.append(((low[far, None] ^ pairs) | top[far, None])[used])
    return np.concatenate(out_rows), np.concatenate(out)


def replicas(fps: DataFrame) -> DataFrame:
    """(anchor, fp): each distinct fingerprint at every anchor it covers, half told by the anchor's 33rd bit."""
    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy().view(np.uint64)
            for which, half in enumerate((fp & np.uint64(0xFFFFFFFF), fp >> np.uint64(32))):
                for at in range(0, len(fp), 50_000):
                    row, anchor = anchors(half[at:at + 50_000])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array((anchor | np.uint64(which << 32)).view(np.int64)), pa.array(fp[at:at + 50_000][row].view(np.int64))],
                        ["anchor", "fp"])

    return fps.select("fp").mapInArrow(run, "anchor bigint, fp bigint")


def forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (fp, an earlier fp) that join the fingerprints of one anchor into their components.

    Breadth first: every round takes the unreached neighbours of one member, so a
    dense group needs one pass and nobody is compared twice with a whole group."""
    a, b, left = [], [], fp
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            member = queue.pop()
            near = np.bitwise_count(left ^ member) <= most
            if near.any():
                reached = left[near]
                a.append(reached)
                b.append(np.full(len(reached), member))
                queue.extend(reached)
                left = left[~near]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(a or empty), np.concatenate(b or empty)


def linked(key: np.ndarray, fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within every group of equal keys; the keys are sorted."""
    edge = np.flatnonzero(np.diff(key)) + 1
    starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
    sizes = ends - starts
    two = starts[sizes == 2]
    near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= most
    found = [(fp[two][near], fp[two + 1][near])]
    found += [forest(fp[s:e], most) for s, e in zip(starts[sizes > 2], ends[sizes > 2])]
    return tuple(np.concatenate(x) for x in zip(*found))


def compared(groups: DataFrame, most: int, large: int | None) -> DataFrame:
    """(a, b, anchor) from (anchor, fp): links of every anchor with a null anchor; the fingerprints
    of an anchor that holds more than ``large`` come back as a, uncompared, with their anchor."""
    dealt = groups.repartition("anchor").sortWithinPartitions("anchor")
    names = ["a", "b", "anchor"]

    def run(batches):
        held_anchor, held_fp, passed = np.zeros(0, np.int64), np.zeros(0, np.uint64), None

        def pairs(anchor, fp):
            a, b = linked(anchor, fp, most)
            none = pa.nulls(len(a), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(a, b).view(np.int64)), pa.array(np.minimum(a, b).view(np.int64)), none], names)

        def uncompared(anchor, fp):
            return pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(len(fp), pa.int64()), pa.array(anchor)], names)

        for batch in batches:
            anchor, fp = batch.column(0).to_numpy(), batch.column(1).to_numpy().view(np.uint64)
            if passed is not None:  # the rest of an anchor that is too large to hold
                n = np.searchsorted(anchor, passed, "right")
                if n:
                    yield uncompared(anchor[:n], fp[:n])
                if n == len(anchor):
                    continue
                anchor, fp, passed = anchor[n:], fp[n:], None
            anchor, fp = np.concatenate([held_anchor, anchor]), np.concatenate([held_fp, fp])
            if large is not None:
                values, first, sizes = np.unique(anchor, return_index=True, return_counts=True)
                for at, size in zip(first[sizes > large], sizes[sizes > large]):
                    yield uncompared(anchor[at:at + size], fp[at:at + size])
                small = np.repeat(sizes <= large, sizes)
                if len(values) and sizes[-1] > large:
                    passed = values[-1]
                anchor, fp = anchor[small], fp[small]
            # the last anchor may go on
            last = len(anchor) if passed is not None else int(np.searchsorted(anchor, anchor[-1])) if len(anchor) else 0
            held_anchor, held_fp = anchor[last:], fp[last:]
            if last:
                yield pairs(anchor[:last], fp[:last])
        if len(held_anchor):
            yield pairs(held_anchor, held_fp)

    return dealt.mapInArrow(run, "a bigint, b bigint, anchor bigint")


def block_pairs(large: DataFrame, size: int = LARGE) -> DataFrame:
    """(anchor, fp) with every pair of blocks of an anchor as one group under a key of its own.

    An anchor of n fingerprints has n / size blocks by hash; a fingerprint goes to every
    pair that holds its block. Equal keys of different pairs would only add comparisons."""
    n = large.groupBy("anchor").agg(F.count(F.lit(1)).alias("n"))
    blocks = large.join(n.hint("merge"), "anchor").withColumn("blocks", F.ceil(F.col("n") / size).cast("int")) \
        .withColumn("own", F.pmod(F.xxhash64("fp"), F.col("blocks")).cast("int"))
    other = blocks.select("anchor", "fp", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    return other.select(F.xxhash64("anchor", F.least("own", "other"), F.greatest("own", "other")).alias("anchor"), "fp")


def links(fps: DataFrame, most: int = MAX_BITS, large: int = LARGE) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to join every component."""
    if most > 4:
        raise ValueError("the anchors of this code cover pairs of at most 4 bits")
    found = saved(compared(replicas(fps), most, large), "anchor-links")
    rest = block_pairs(found.where("anchor IS NOT NULL").select("anchor", F.col("a").alias("fp")), large)
    return found.where("anchor IS NULL").select("a", "b").unionByName(compared(rest, most, None).select("a", "b")).distinct()


# ------------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node reachable, for every node that has a link.

    Large-star joins each node's larger neighbours to its smallest one, small-star
    the smaller ones; both keep components and shorten paths until only stars are
    left. Smallest neighbours are partial aggregates, so a hub combines map-side."""
    now = saved(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links")
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = saved(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(
            F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e"))
        after = saved(small.select("e.*").where("a <> b").distinct(), "small-star")
        if now.exceptAll(after).isEmpty() and after.exceptAll(now).isEmpty():
            break
        now = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def simhash_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       most: int = MAX_BITS, seed: int = SEED, row_col: str | None = None) -> DataFrame:
    """One row per input row: doc_id, fp, component_id (smallest doc_id reachable).

    ``row_col`` names a column that tells rows apart, whatever their ids; it comes back as
    ``row``, with ``kept``, true for one row of each component."""
    rows = saved(fingerprints(df, id_col, text_col, shingle, seed, row_col), "fingerprints")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("late"), *[c for c in rows.columns if c != "fp"]))
    distinct = saved(rows.groupBy("fp").agg(least.alias("least")), "distinct-fingerprints")
    member = components(links(distinct, most))
    rooted = distinct.join(member, distinct["fp"] == member["node"], "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root"))
    named = rooted.join(rooted.groupBy("root").agg(F.min("least").alias("first")), "root").select("fp", "first")
    out = rows.join(named, "fp").withColumn("component_id", F.col("first.doc_id"))
    if not row_col:
        return out.select("doc_id", "fp", "component_id")
    return out.select("row", "doc_id", "fp", "component_id", (F.col("row") == F.col("first.row")).alias("kept"))
