"""Best-fit packing of token sequences by linear grouping.

Lengths are whole numbers up to the sequence size, so the corpus reduces to a
histogram of at most ``size`` rows whatever its volume; only that histogram is
planned on the driver:

1. *Linear grouping*: large lengths, sorted, are cut into groups of equal
   cardinality and rounded up to the largest length of their group.
2. *Few-size configurations*: with few distinct sizes the cutting-stock
   relaxation is solved by column generation; whole multiples of its
   configurations become sequences.
3. *Substitution*: the k-th document of a length takes the k-th place planned
   for that length, so sequences regain the space that rounding took.
4. *Best fit*: the large rest and then the small lengths go, longest first, to the
   sequence with the least space that still holds them.

Where "large" begins and how many sizes are kept trades rounding loss against
configuration gain; as the histogram is small, several settings are planned and
the one with the fewest sequences is used.

Sequences with the same content lengths are planned together as one run of
consecutive ids. Documents find their place by their rank among the pieces of
the same length; ranks are counted per (length, salt), with as many salts as shuffle
partitions, so a length that a third of all documents share is spread over all tasks.

Defined results: a null or empty text is one piece holding only the closing id;
an empty table gives an empty result; repeated rows are packed each; further
columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

SIZE = 4096
END_ID = 1
# Settings tried on the histogram, as (rounded sizes, most large pieces to a
# sequence); the plan with the fewest sequences is used.
SETTINGS = ((48, 8), (96, 3), (256, 1))
SALTS = 64           # rank counters per length; as many as shuffle partitions where those are more
CACHE_PARTS = 600_000
CACHE_CHARS = 64     # longer parts (whole sentences of scripts without spaces) are not kept
# Latin-1 letters (each is one composed character in either case) and ASCII marks
# but for the apostrophe, which the tokenizer treats in its own way.
LETTER = r"A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff"
MARK = r"!-&(-/:-@\[-`{-~"
SIMPLE = re.compile(f"[{LETTER}0-9{MARK} \n]*")
PARTS = re.compile(f"[{LETTER}]+|[0-9]|[{MARK}]+")
LETTERS = re.compile(f"[{LETTER}]+")
PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


# ------------------------------------------------------------------- tokenising

class Encoder:
    """Token ids of whole texts, as little-endian unsigned 32-bit bytes.

    The tokenizer splits a text before it encodes the parts one by one, so a
    text's ids are the ids of its parts in order. Texts of Latin-1 letters, digits
    and plain marks are cut into those parts here (letter runs in lower case,
    single digits, runs of marks); others are cut at spaces and line feeds, which
    no part crosses. Ids of short parts are kept in a bounded table of two halves: a full
    half becomes the older one, whose parts come back when they are met again, and the one
    before it goes. Only unseen parts reach the tokenizer, letter runs many to a call, as
    each ends with a word-end token."""

    def __init__(self, path: str, most: int = CACHE_PARTS):
        from tokenizers import Tokenizer
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[str, bytes] = {"": b""}
        self.older: dict[str, bytes] = {}

    def plain(self, parts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]

    def learn(self, new: list[str]) -> None:
        runs = [p for p in new if LETTERS.fullmatch(p)]
        for at in range(0, len(runs), 1000):
            some = runs[at:at + 1000]
            raw = self.plain([" ".join(some)])[0]
            cuts = (4 * (np.flatnonzero(self.ends[np.frombuffer(raw, "<u4")]) + 1)).tolist()
            self.known.update((w, raw[a:b]) for w, a, b in zip(some, [0, *cuts[:-1]], cuts, strict=True))
        rest = [p for p in new if not LETTERS.fullmatch(p)]
        for at in range(0, len(rest), 1000):
            self.known.update(zip(rest[at:at + 1000], self.plain(rest[at:at + 1000])))

    def encode(self, texts: list[str]) -> list[bytes]:
        split = [PARTS.findall(t.lower()) if SIMPLE.fullmatch(t) and "<|" not in t else t.replace("\n", " ").split(" ")
                 for t in texts]
        if len(self.known) > self.most // 2:
            self.known, self.older = {"": b""}, self.known
        unmet = set().union(*split).difference(self.known)
        again = unmet.intersection(self.older)
        self.known.update((p, self.older[p]) for p in again)
        new = list(unmet - again)
        self.learn(new)
        known = self.known
        out = [b"".join([known[p] for p in ps]) for ps in split]
        for p in new:
            if len(p) > CACHE_CHARS:
                del known[p]
        return out


@cache
def encoder_of(tokenizer: str) -> Encoder:
    """One encoder for all tasks of a worker process, so that a part is learned once and not by every task."""
    return Encoder(tokenizer)


def slices_by_chars(sizes: list[int], most: int = 2_000_000):
    """Consecutive ranges of texts with at most ``most`` characters (one text at least)."""
    start = total = 0
    for i, n in enumerate(sizes):
        if total and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if sizes:
        yield start, len(sizes)


def token_pieces(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                 end_id: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Pieces of at most ``size`` ids of every text; ``keep_ids`` adds them as an array."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    schema = PIECES.format(id=rows.schema["doc_id"].dataType.simpleString()) + (", ids array<bigint>" if keep_ids else "")
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        encoder = encoder_of(tokenizer)
        for batch in batches:
            column = batch.column(1).fill_null("")
            for lo, hi in slices_by_chars(pc.utf8_length(column).to_pylist()):
                cut = []
                for i, raw in enumerate(encoder.encode(column.slice(lo, hi - lo).to_pylist()), lo):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * size)):
                        cut.append((i, piece, start // 4, raw[start:start + 4 * size]))
                columns = [batch.column(0).take(pa.array([c[0] for c in cut], pa.int64())),
                           pa.array([c[1] for c in cut], pa.int32()), pa.array([c[2] for c in cut], pa.int64()),
                           pa.array([len(c[3]) // 4 for c in cut], pa.int64()),
                           pa.array([zlib.crc32(c[3]) for c in cut], pa.int64())]
                if keep_ids:
                    columns.append(pa.array([np.frombuffer(c[3], "<u4").astype("i8") for c in cut], pa.list_(pa.int64())))
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"][:len(columns)]
                yield pa.RecordBatch.from_arrays(columns, names)

    return rows.mapInArrow(run, schema)


# --------------------------------------------------------------------- planning

def grouped(counts: np.ndarray, large: int, groups: int) -> list[tuple[int, int]]:
    """Linear grouping: (size, items) of equal-cardinality groups of the lengths from ``large`` on.

    ``counts[l]`` is the number of pieces of length ``l``. A group's size is its
    largest length; a length that spans a group border counts in both groups."""
    lengths = np.nonzero(counts)[0]
    lengths = lengths[lengths >= large][::-1]
    items = int(counts[lengths].sum())
    out, per, room = [], -(-items // groups) if items else 0, 0
    for length in map(int, lengths):
        left = int(counts[length])
        while left:
            if not room:
                out.append([length, 0])
                room = per
            take = min(left, room)
            out[-1][1] += take
            left -= take
            room -= take
    return [(s, n) for s, n in out]


def best_configuration(sizes: list[int], values: np.ndarray, capacity: int) -> tuple[float, list[int]]:
    """The most valuable multiset of sizes within the capacity (bounded knapsack by dynamic programming)."""
    best = np.zeros(capacity + 1)
    used = np.zeros((len(sizes), capacity + 1), np.int16)
    for i, (s, v) in enumerate(zip(sizes, values)):
        if v <= 0:
            continue
        base, top = best.copy(), best.copy()
        for k in range(1, capacity // s + 1):
            with_k = base[:capacity + 1 - k * s] + k * v
            better = with_k > top[k * s:] + 1e-12
            top[k * s:][better] = with_k[better]
            used[i, k * s:][better] = k
        best = top
    room, config = capacity, [0] * len(sizes)
    for i in range(len(sizes) - 1, -1, -1):
        config[i] = int(used[i, room])
        room -= config[i] * sizes[i]
    return float(best[capacity]), config


def configurations(sizes: list[int], items: list[int], capacity: int) -> list[tuple[int, list[int]]]:
    """Whole numbers of sequences per configuration, from the relaxation's optimum rounded down."""
    k = len(sizes)
    if not k:
        return []
    basis = np.diag([capacity // s for s in sizes]).astype(float)
    need = np.array(items, float)
    for _ in range(10 * k):
        prices = np.linalg.solve(basis.T, np.ones(k))
        value, config = best_configuration(sizes, prices, capacity)
        if value <= 1 + 1e-7:
            break
        column = np.array(config, float)
        step, amount = np.linalg.solve(basis, column), np.linalg.solve(basis, need)
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    amount = np.floor(np.linalg.solve(basis, need) + 1e-6)
    out, left = [], list(items)
    for j in np.argsort(-amount):
        config = [int(round(c)) for c in basis[:, j]]
        n = int(min([max(amount[j], 0)] + [left[i] // c for i, c in enumerate(config) if c]))
        if n:
            out.append((n, config))
            left = [x - n * c for x, c in zip(left, config)]
    return out


class Plan:
    """Places by length: rank interval -> first sequence and offset.

    ``runs`` holds runs of sequences with equal contents by free space."""

    def __init__(self, counts: np.ndarray, size: int):
        self.size, self.left, self.next_rank = size, counts.copy(), np.zeros(len(counts), np.int64)
        self.rows: list[tuple[int, int, int, int]] = []      # length, first rank, first sequence, offset
        self.runs: dict[int, list[tuple[int, int]]] = {}     # free space -> [(first sequence, sequences)]
        self.free: list[int] = []                            # free spaces in use, ascending
        self.sequences = 0

    def put(self, length: int, first: int, n: int, free: int) -> None:
        """The next ``n`` pieces of a length go into sequences first.. with ``free`` space each."""
        self.rows.append((length, int(self.next_rank[length]), first, self.size - free))
        self.next_rank[length] += n
        self.left[length] -= n
        self.keep(first, n, free - length)

    def keep(self, first: int, n: int, free: int) -> None:
        if free not in self.runs:
            self.runs[free] = []
            insort(self.free, free)
        self.runs[free].append((first, n))

    def take(self, free: int, most: int) -> tuple[int, int]:
        """A run of at most ``most`` sequences with this free space."""
        first, n = self.runs[free].pop()
        if n > most:
            self.runs[free].append((first + most, n - most))
            n = most
        if not self.runs[free]:
            del self.runs[free]
            self.free.pop(bisect_left(self.free, free))
        return first, n

    def best_fit(self, length: int) -> None:
        while (n := int(self.left[length])):
            at = bisect_left(self.free, length)
            if at < len(self.free):
                free = self.free[at]
                first, some = self.take(free, n)
            else:
                free, first, some = self.size, self.sequences, -(-n // (self.size // length))
                self.sequences += some
            self.put(length, first, some, free)

    def configured(self, config: list[int], n: int, members: list[list[int]]) -> None:
        """``n`` sequences of a configuration, filled with actual lengths of its groups."""
        runs = [(self.sequences, n, self.size)]
        self.sequences += n
        for group, copies in enumerate(config):
            for _ in range(copies):
                split = []
                for first, some, free in runs:
                    while some:
                        while members[group] and not self.quota[group][members[group][0]]:
                            members[group].pop(0)
                        length = members[group][0]
                        take = min(some, self.quota[group][length])
                        self.quota[group][length] -= take
                        self.rows.append((length, int(self.next_rank[length]), first, self.size - free))
                        self.next_rank[length] += take
                        self.left[length] -= take
                        split.append((first, take, free - length))
                        first, some = first + take, some - take
                runs = split
        for run in runs:
            self.keep(*run)


def plan(histogram: dict[int, int], size: int = SIZE, settings=SETTINGS) -> Plan:
    """Places for all pieces of a length histogram, by the best of the settings."""
    return min((grouped_plan(histogram, size, g, size // (most + 1) + 1) for g, most in settings), key=lambda p: p.sequences)


def grouped_plan(histogram: dict[int, int], size: int, groups: int, large: int) -> Plan:
    """Places with ``groups`` rounded sizes of the lengths from ``large`` on."""
    counts = np.zeros(size + 1, np.int64)
    for length, n in histogram.items():
        counts[length] = n
    out = Plan(counts, size)
    if counts[size]:
        out.best_fit(size)  # whole sequences need no plan
    rounded = grouped(out.left, large, groups)
    lengths = [int(x) for x in np.nonzero(out.left)[0][::-1] if x >= large]
    out.quota, members, left = [], [], {x: int(out.left[x]) for x in lengths}
    at = 0
    for _, n in rounded:  # the actual lengths of each group, longest first
        quota = {}
        while n:
            take = min(n, left[lengths[at]])
            quota[lengths[at]] = quota.get(lengths[at], 0) + take
            left[lengths[at]] -= take
            n -= take
            at += not left[lengths[at]]
        out.quota.append(quota)
        members.append(list(quota))
    for n, config in configurations([s for s, _ in rounded], [n for _, n in rounded], size):
        out.configured(config, n, members)
    for length in np.nonzero(out.left)[0][::-1]:
        out.best_fit(int(length))
    return out


# ------------------------------------------------------------------- operator

def pack(pieces: DataFrame, size: int = SIZE, settings=SETTINGS, salts: int | None = None) -> DataFrame:
    """Add sequence_id and offset to a table of pieces (doc_id, piece, length, ...).

    ``pieces`` must be a stored table: it is read twice."""
    salts = salts or max(SALTS, int(pieces.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by_salt = Window.partitionBy("length", "_salt").orderBy("_key", "doc_id", "piece")
    salted = pieces.withColumn("_key", F.xxhash64("doc_id", "piece", "ids_crc32")) \
        .withColumn("_salt", F.pmod("_key", F.lit(salts)).cast("int"))
    cells = saved(salted.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "packing-cells")
    histogram = {int(r["length"]): int(r["n"]) for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = plan(histogram, size, settings)
    keys = np.array([(length << 44) + rank for length, rank, _, _ in places.rows], np.int64)
    order = np.argsort(keys)
    keys = keys[order]
    ranks, firsts, offsets = (np.array([r[i] for r in places.rows], np.int64)[order] for i in (1, 2, 3))

    before = Window.partitionBy("length").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    starts = cells.select(  # one row per cell; the join has the keys of the rank window
        F.col("length").alias("_length"), F.col("_salt").alias("_of"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = (salted.withColumn("_rank", F.row_number().over(by_salt) - 1)
              .join(starts, (F.col("length") == F.col("_length")) & (F.col("_salt") == F.col("_of")))
              .withColumn("_rank", F.col("_rank") + F.col("_before")).select(*pieces.columns, "_rank"))
    schema = pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches):
        for batch in batches:
            length, rank = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "_rank"))
            at = np.searchsorted(keys, (length.astype(np.int64) << 44) + rank, side="right") - 1
            kept = [batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_rank"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(firsts[at] + rank - ranks[at]), pa.array(offsets[at])], schema.names)

    return ranked.mapInArrow(place, schema)


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE,
                   keep_ids: bool = False) -> DataFrame:
    """Tokenise, cut and pack; one row per piece with its sequence and place."""
    return pack(saved(token_pieces(df, tokenizer, id_col, text_col, size, keep_ids=keep_ids), "pieces"), size)
