"""MinHash near-duplicates by a multi-index Hamming join of b-bit signatures.

A text's set of word shingles gets a signature of 64 symbols of 16 bits (b-bit
min-hashes). Two sets with Jaccard similarity J differ in a symbol with
probability 1 - J, so at J = 0.85 a distance over ``DISTANCE`` = 23 symbols has
probability 9e-6 (``missed``), and less above. Every pair within that distance is
found: the symbols are split into 12 chunks, by pigeonhole some chunk has at most
one wrong symbol, and that error is enumerated by leaving out each symbol of each
chunk in turn: 64 keys of four or five symbols. Pairs that share a key are
compared on the whole signature (4 bits a symbol, which can only shorten the
distance).

Links between signatures join them into candidate groups, kept as spanning
forests, never as all pairs; a key with more than ``KEY_ROWS`` signatures, or one
that a Misra-Gries pass finds in over 1/32 of them, joins all of its signatures
map-side or as one star, which makes candidate groups larger but loses nothing.
Within a candidate group the full shingle sets decide: a set is marked in the
group's vocabulary, and its intersections with all sets not yet reached are
counted at once. Only texts of groups with at least two different sets are read
again for this.

A candidate group beyond ``GROUP_ROWS`` sets or ``GROUP_SHINGLES`` shingles is
dealt into blocks. Blocks are joined inside first; then all sets meet a few
pivots, which unites a dense group in one pass; only sets still outside the
group's largest component meet every block. So no pair of sets that is not
already in one component goes unchecked, and the work is linear for dense groups.

Defined results: null text and text without words have an empty set, which links
with nothing; equal sets link at any size; rows that repeat an id are rows of
their own; ids are compared as they are, rows without an id never give the
component its id, and a component of only null ids has a null id and keeps all;
an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import re
from copy import copy
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved
from .simhash import components

SHINGLE = 3
PERCENT = 85
SYMBOLS, CHUNKS = 64, 12
DISTANCE = 2 * CHUNKS - 1   # all pairs up to this signature distance are found
KEY_ROWS = 20_000           # signatures compared within one key; beyond, the key is one star
KEY_COUNTERS = 64           # Misra-Gries counters per enumerated error
GROUP_ROWS, GROUP_SHINGLES = 4_000, 4_000_000
PIVOTS = 16
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

_rng = np.random.default_rng(11)
FACTORS = _rng.integers(1, 2 ** 63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SHIFTS = _rng.integers(0, 2 ** 63, SYMBOLS, dtype=np.uint64)
MIX = np.uint64(0x9E3779B97F4A7C15)


def missed(similarity: float, symbols: int = SYMBOLS, distance: int = DISTANCE) -> float:
    """Probability that a pair of this similarity lies beyond the signature distance."""
    p = 1 - similarity
    return sum(comb(symbols, d) * p ** d * (1 - p) ** (symbols - d) for d in range(distance + 1, symbols + 1))


# -------------------------------------------------------------------- signatures

class WordHashes(dict):
    """Word -> 64-bit hash, remembered for a while (texts repeat their words)."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(text: bytes, known: WordHashes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's word shingles; A-Z count as a-z."""
    words = [known[w] for w in WORD.findall(text.lower())]  # bytes.lower() changes A-Z only
    if not words:
        return np.zeros(0, np.uint64)
    words, k = np.array(words, np.uint64), min(shingle, len(words))
    n = len(words) - k + 1
    total = np.full(n, k, np.uint64)
    for i in range(k):
        total = mixed(total + words[i:i + n])
    return np.unique(total)


def signature(hashes: np.ndarray) -> np.ndarray:
    """64 symbols of 16 bits of a non-empty set."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        least = np.minimum(least, (hashes[at:at + 2048, None] * FACTORS + SHIFTS).min(axis=0))
    return ((least * MIX) >> np.uint64(48)).astype(np.uint16)


def signed(df: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """doc_id, mark (digest of the text), n_shingles, key (of the set), sig, node (of the signature)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).select(
        "doc_id", F.xxhash64("text").alias("mark"), F.col("text").cast("binary").alias("text"))
    schema = f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, mark bigint, n_shingles bigint, key binary, sig binary, node bigint"

    def run(batches):
        known = WordHashes()
        for batch in batches:
            size, key, sig, node = [], [], [], []
            for text in batch.column(2):
                found = shingle_set(text.as_py() or b"", known, shingle)
                size.append(len(found))
                if len(found):
                    symbols = signature(found).tobytes()
                    key.append(xxhash.xxh3_128_digest(found.tobytes()))
                    sig.append(symbols)
                    node.append(xxhash.xxh64_intdigest(symbols) - 2 ** 63)
                else:
                    key.append(None), sig.append(None), node.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(size, pa.int64()), pa.array(key, pa.binary()), pa.array(sig, pa.binary()),
                 pa.array(node, pa.int64())], ["doc_id", "mark", "n_shingles", "key", "sig", "node"])

    return rows.mapInArrow(run, schema)


# -------------------------------------------------------------- multi-index join

def chunk_edges() -> list[tuple[int, int]]:
    cuts = [SYMBOLS * i // CHUNKS for i in range(CHUNKS + 1)]
    return list(zip(cuts, cuts[1:]))


def keys_of(sigs: np.ndarray) -> np.ndarray:
    """(rows, 64): a key for every enumerated error, the chunk's other symbols hashed with its place."""
    place = np.arange(1, SYMBOLS + 1, dtype=np.uint64) * MIX
    worth = mixed(sigs.astype(np.uint64) + place)  # a symbol at its place
    out = np.empty(sigs.shape, np.uint64)
    for a, b in chunk_edges():
        total = worth[:, a:b].sum(axis=1, dtype=np.uint64)
        for wrong in range(a, b):
            out[:, wrong] = mixed(total - worth[:, wrong] + place[wrong])
    return out.view(np.int64)


def packed(sigs: np.ndarray) -> np.ndarray:
    """4 bits of each symbol, 16 symbols a word."""
    low = (sigs & np.uint16(15)).astype(np.uint64).reshape(len(sigs), 4, 16)
    return (low << (np.arange(16, dtype=np.uint64) * np.uint64(4))).sum(axis=2, dtype=np.uint64)


def differing(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a ^ b
    x |= x >> np.uint64(1)
    x |= x >> np.uint64(2)
    return np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=1)


def symbols_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def hot_keys(sigs: DataFrame, counters: int = KEY_COUNTERS) -> list[int]:
    """Keys that may hold over 1/32 of the signatures: a Misra-Gries summary per enumerated error and task."""
    def summarise(batches):
        held = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in range(SYMBOLS)]
        for batch in batches:
            keys = keys_of(symbols_of(batch.column(0)))
            for e in range(SYMBOLS):
                values, counts = np.unique(keys[:, e], return_counts=True)
                values, back = np.unique(np.concatenate([held[e][0], values]), return_inverse=True)
                total = np.bincount(back, np.concatenate([held[e][1], counts]), len(values)).astype(np.int64)
                if len(values) > counters:
                    total = total - np.partition(total, -counters - 1)[-counters - 1]
                held[e] = (values[total > 0], total[total > 0])
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([h[0] for h in held])), pa.array(np.concatenate([h[1] for h in held]))], ["key", "est"])

    n = sigs.count()
    if n <= KEY_ROWS:  # no key can hold more
        return []
    found = sigs.select("sig").mapInArrow(summarise, "key bigint, est bigint").groupBy("key").agg(F.sum("est").alias("est"))
    # a summary misses n/65 at most; an error has at most 64 keys over n/64, so at most 4,096 reach the driver
    return [r["key"] for r in found.where(F.col("est") > max(n / 64, KEY_ROWS / 2)).collect()]


def forest(node: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (node, earlier node) joining one key's signatures into their components; nobody is compared
    twice with a whole group."""
    a, b, left = [], [], np.arange(len(node))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            member = queue.pop()
            near = differing(words[left], words[member]) <= DISTANCE
            if near.any():
                a.append(left[near])
                b.append(np.full(len(a[-1]), member))
                queue.extend(left[near])
                left = left[~near]
    none = [np.zeros(0, np.int64)]
    return node[np.concatenate(a or none)], node[np.concatenate(b or none)]


def candidate_links(sigs: DataFrame) -> DataFrame:
    """Links (a, b) between signature nodes, enough to join all within ``DISTANCE``."""
    hot = np.array(sorted(hot_keys(sigs)), np.int64)

    def replicate(batches):
        for batch in batches:
            for at in range(0, len(batch), 2_000):
                part = batch.slice(at, 2_000)
                symbols, node = symbols_of(part.column(1)), part.column(0).to_numpy()
                keys, words = keys_of(symbols).ravel(), packed(symbols)
                row = np.repeat(np.arange(len(node)), SYMBOLS)
                star = np.isin(keys, hot)
                words = words[row[~star]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys[~star]), pa.array(node[row[~star]]), *[pa.array(words[:, i].view(np.int64)) for i in range(4)]], REPLICA)
                if star.any():  # words are not needed: every member links to the key itself
                    zero = pa.array(np.zeros(star.sum(), np.int64))
                    yield pa.RecordBatch.from_arrays([pa.nulls(star.sum(), pa.int64()), pa.array(node[row[star]]), pa.array(keys[star]), zero, zero, zero], REPLICA)

    columns = ", ".join(f"{c} bigint" for c in REPLICA)
    copies = sigs.select("node", "sig").mapInArrow(replicate, columns)
    if len(hot):
        copies = saved(copies, "replicas")
        stars = copies.where("key IS NULL").select(F.col("node").alias("a"), F.col("w0").alias("b"))
        copies = copies.where("key IS NOT NULL")
    dealt = copies.repartition("key").sortWithinPartitions("key")

    def link(batches):
        key, node, words, star = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 4), np.uint64), None

        def linked(key, node, words):
            edge = np.flatnonzero(np.diff(key)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(key)]])
            sizes = ends - starts
            two = starts[sizes == 2]
            near = differing(words[two], words[two + 1]) <= DISTANCE
            found = [(node[two][near], node[two + 1][near])]
            found += [forest(node[s:e], words[s:e]) for s, e in zip(starts[sizes > 2], ends[sizes > 2])]
            a, b = (np.concatenate(x) for x in zip(*found))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            key = np.concatenate([key, batch.column(0).to_numpy()])
            node = np.concatenate([node, batch.column(1).to_numpy()])
            words = np.concatenate([words, np.stack([batch.column(i).to_numpy() for i in range(2, 6)], axis=1).view(np.uint64)])
            if star is not None:  # a key too large to compare: its further rows link to its first
                same = np.searchsorted(key, star[0], "right")
                yield pa.RecordBatch.from_arrays([pa.array(node[:same]), pa.array(np.full(same, star[1]))], ["a", "b"])
                key, node, words = key[same:], node[same:], words[same:]
                star = star if not len(key) else None
            if not len(key):
                continue
            last = np.searchsorted(key, key[-1])  # the last key may go on
            if last:
                yield linked(key[:last], node[:last], words[:last])
                key, node, words = key[last:], node[last:], words[last:]
            if len(key) > KEY_ROWS:
                star = (key[0], node[0])
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(np.full(len(node), node[0]))], ["a", "b"])
                key, node, words = key[:0], node[:0], words[:0]
        if len(key):
            yield linked(key, node, words)

    links = dealt.mapInArrow(link, "a bigint, b bigint")
    return (links.unionByName(stars) if len(hot) else links).where("a <> b").distinct()


REPLICA = ["key", "node", "w0", "w1", "w2", "w3"]


# ------------------------------------------------------------- full shingle sets

class Sets:
    """Shingle sets by ascending size over their common vocabulary."""

    def __init__(self, sets: list[np.ndarray]):
        self.sizes = np.array([len(s) for s in sets])
        self.order = np.argsort(self.sizes, kind="stable")
        self.sizes = self.sizes[self.order]
        words, flat = np.unique(np.concatenate([sets[i] for i in self.order]), return_inverse=True)
        self.flat, self.ends = flat.astype(np.int32), np.cumsum(self.sizes)
        self.vocabulary, self.mark = words, np.zeros(len(words), bool)

    def items(self, i: int) -> np.ndarray:
        return self.flat[self.ends[i] - self.sizes[i]:self.ends[i]]

    def linked_to(self, items: np.ndarray, size: int, percent: int) -> np.ndarray:
        """Places of the sets with at least ``percent`` Jaccard similarity to a set of ``size`` words,
        ``items`` of which are in the vocabulary. Only sets of a feasible size are counted."""
        low = np.searchsorted(100 * self.sizes, percent * size, "left")
        high = np.searchsorted(percent * self.sizes, 100 * size, "right")
        if low >= high:
            return np.zeros(0, np.int64)
        self.mark[items] = True
        start = self.ends[low] - self.sizes[low]
        shared = np.add.reduceat(self.mark[self.flat[start:self.ends[high - 1]]].astype(np.int32), self.ends[low:high] - self.sizes[low:high] - start)
        self.mark[items] = False
        return low + np.flatnonzero(100 * shared >= percent * (size + self.sizes[low:high] - shared))

    def without(self, gone: np.ndarray) -> None:
        """Drops the marked places."""
        self.flat = self.flat[np.repeat(~gone, self.sizes)]
        self.sizes, self.order = self.sizes[~gone], self.order[~gone]
        self.ends = np.cumsum(self.sizes)


def stars(sets: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """(member, leader) for every set linked, over any number of steps, to an earlier one."""
    everything, out = Sets(sets), []
    left = copy(everything)
    place = np.empty(len(sets), np.int64)
    place[everything.order] = np.arange(len(sets))
    reached = np.zeros(len(sets), bool)  # by place in the list
    for leader in range(len(sets)):
        if reached[leader]:
            continue
        reached[leader] = True
        queue = [leader]
        while queue:
            member = queue.pop()
            at = place[member]
            near = left.order[left.linked_to(everything.items(at), everything.sizes[at], percent)]
            new = near[~reached[near]]
            reached[new] = True
            out += [(int(i), leader) for i in new]
            queue.extend(int(i) for i in new)
            gone = reached[left.order]
            if 4 * gone.sum() > len(gone):  # those reached need no further comparison
                left.without(gone)
            if not len(left.order):
                return out
    return out


def grouped(members: DataFrame, columns: str, work) -> DataFrame:
    """``work(rows)`` for the rows of each (root, part, other), one group in memory at a time."""
    dealt = members.repartition("root", "part", "other").sortWithinPartitions("root", "part", "other")
    kinds = pa.schema([(c.split(" ")[0], pa.binary()) for c in columns.split(", ")])

    def run(batches):
        now, held = None, []

        def done():
            found = work(held)
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], pa.binary()) for i in range(len(kinds))], schema=kinds)

        for batch in batches:
            for at in range(0, len(batch), 64):
                for row in batch.slice(at, 64).to_pylist():
                    group = (row["root"], row["part"], row["other"])
                    if group != now and held:
                        yield done()
                        held = []
                    now = group
                    held.append(row)
        if held:
            yield done()

    return dealt.mapInArrow(run, columns)


def verified(df: DataFrame, members: DataFrame, id_col: str, text_col: str, shingle: int, percent: int,
             group_rows: int = 0, group_shingles: int = 0) -> DataFrame:
    """Links (a, b) between set keys on full shingle sets, enough to join every component.

    ``members``: root (candidate group), key, rep_id and mark (a row that has the set), n_shingles."""
    group_rows, group_shingles = group_rows or GROUP_ROWS, group_shingles or GROUP_SHINGLES
    sizes = members.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("weight")).where("n > 1")
    parts = F.greatest(F.ceil(F.col("n") / group_rows), F.ceil(F.col("weight") / group_shingles))
    many = saved(members.join(sizes.select("root", parts.alias("parts")), "root").withColumn(
        "part", F.pmod(F.xxhash64("key"), F.col("parts"))), "candidates")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("m", F.xxhash64("text"))
    # a merge join at every size: the planner would broadcast small tables of candidates and shuffle large ones
    read = texts.join(many.hint("merge"), F.col("id").eqNullSafe(F.col("rep_id")) & (F.col("m") == F.col("mark"))).select(
        "root", "part", "parts", F.lit(0).cast("bigint").alias("other"), "key", F.col("text").cast("binary").alias("text"))

    def sets_of(rows):
        known = WordHashes()
        once = {r["key"]: r["text"] for r in rows}
        return list(once), [shingle_set(t or b"", known, shingle) for t in once.values()]

    def within(rows):
        keys, sets = sets_of(rows)
        return [(keys[a], keys[b]) for a, b in stars(sets, percent)]

    pair = "a binary, b binary"
    if many.where("parts > 1").isEmpty():
        return saved(grouped(read, pair, within), "verified")

    read = saved(read, "candidate-texts")
    large = read.where("parts > 1")
    first = saved(grouped(read, pair, within), "verified")
    # pivots: the sets that lead the largest stars of a group's blocks
    led = first.groupBy(F.col("b").alias("key")).agg(F.count(F.lit(1)).alias("led"))
    spread = many.where("parts > 1").select("root", "key", "parts")
    pivots = large.join(top_leaders(spread.join(led, "key")).select("key"), "key").select("root", "parts", "key", "text")
    blocks = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1)).alias("part")
    meet = large.withColumn("role", F.lit("all")).unionByName(
        pivots.select("root", blocks, "parts", F.lit(0).cast("bigint").alias("other"), "key", "text", F.lit("ask").alias("role")))

    def asked(rows):
        asking = [r for r in rows if r["role"] == "ask"]
        others = [r for r in rows if r["role"] == "all"]
        if not asking or not others:
            return []
        keys, sets = sets_of(others)
        label = {r["key"]: r.get("label") for r in others}
        side, known, found = Sets(sets), WordHashes(), []
        for key, own in zip(*sets_of(asking)):
            mine = next((r.get("label") for r in asking if r["key"] == key), None)
            at = np.searchsorted(side.vocabulary, own)
            hit = (at < len(side.vocabulary)) & (side.vocabulary[np.minimum(at, len(side.vocabulary) - 1)] == own)
            near = [keys[i] for i in side.order[side.linked_to(at[hit], len(own), percent)]]
            seen = set()
            for other in near:  # one link per component not yet joined
                if other != key and (label[other] is None or (label[other] != mine and label[other] not in seen)):
                    seen.add(label[other])
                    found.append((other, key))
        return found

    second = saved(first.unionByName(grouped(meet, pair, asked)).distinct(), "verified")
    rooted = components(second)
    labelled = with_label(spread, rooted)
    count = labelled.groupBy("root", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = count.groupBy("root").agg(F.max_by("label", F.struct("n", "label")).alias("largest"))
    outside = labelled.join(largest, "root").where(F.col("label") != F.col("largest")).select("root", "key", "label")
    share = outside.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / group_rows).alias("shares"))
    rest = saved(outside.join(share, "root"), "outside")
    full = large.join(labelled.select("key", "label"), "key")
    everyone = full.join(share, "root").select("root", "part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shares") - 1)).alias("other"),
                                               "key", "text", "label", F.lit("all").alias("role"))
    few = full.drop("label").join(rest.drop("root"), "key").select("root", blocks, F.pmod(F.xxhash64("key", F.lit(1)), F.col("shares")).alias("other"),
                                                    "key", "text", "label", F.lit("ask").alias("role"))
    return second.unionByName(grouped(everyone.unionByName(few), pair, asked)).distinct()


def top_leaders(led: DataFrame) -> DataFrame:
    """The ``PIVOTS`` largest leaders of each group (a partial top-k per task comes first)."""
    place = Window.partitionBy("root").orderBy(F.desc("led"), "key")
    return led.withColumn("at", F.row_number().over(place)).where(F.col("at") <= PIVOTS).drop("at")


def with_label(spread: DataFrame, rooted: DataFrame) -> DataFrame:
    named = rooted.select(F.col("node").alias("key"), F.col("root").alias("label"))
    return spread.join(named, "key", "left").select("root", "key", F.coalesce("label", "key").alias("label"))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id (smallest doc_id reachable), kept, key (of the set)."""
    rows = saved(signed(df, id_col, text_col, shingle), "signatures")
    distinct = saved(rows.where("key IS NOT NULL").groupBy("key").agg(
        F.min("doc_id").alias("least_id"), F.min(F.struct("doc_id", "mark")).alias("rep"), F.first("n_shingles").alias("n_shingles"),
        F.first("sig").alias("sig"), F.first("node").alias("node")), "sets")
    grouped_nodes = components(candidate_links(distinct))
    members = distinct.join(grouped_nodes.withColumnRenamed("node", "n"), F.col("node") == F.col("n"), "left").select(
        F.coalesce("root", "node").alias("root"), "key", F.col("rep.doc_id").alias("rep_id"), F.col("rep.mark").alias("mark"), "n_shingles")
    member = components(verified(df, members, id_col, text_col, shingle, percent))
    named = saved(distinct.select("key", "least_id").join(member.withColumnRenamed("node", "key"), "key").select("key", "root", "least_id"), "members")
    least = named.groupBy("root").agg(F.min("least_id").alias("least_id"))
    whole = named.drop("least_id").join(least, "root").select("key", "least_id")
    alone = distinct.select("key", "least_id").join(named.select("key"), "key", "left_anti")
    found = rows.select("doc_id", "n_shingles", "key").join(whole.unionByName(alone), "key", "left")
    component = F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("least_id"))
    return found.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"), "key")
