"""Repair of conversation structure by the auction shortest-path algorithm.

A conversation is legal when its role initials read ``(s?(ua)+)?``. Each turn is
kept (0), given the other role (3) or deleted (4), turns without text may be
inserted (3), and a cut-off turn that stays costs 3 more. Turns and the four
states *start*, after *s*, after *u*, after *a* span a lattice with these integer
costs; the cheapest repair is a shortest path through it.

The path is found by Bertsekas' auction: a path grows from its first node along
the cheapest arc by price, and where its last node's price is below every way on,
that price rises to the cheapest way and the path is cut by a node. At the end
the price of the first node is the distance, every arc of every shortest path is
tight (price = cost + next price), and of these arcs the ASCII-least sequence of
edits is traced.

Long conversations are cut into segments of 32 turns. A segment's distances from
its entry to its exit states (4 x 4) depend on no other segment, so they are
found in parallel; the distances to the end follow from them last segment first,
and with these as costs of its exits each segment is traced by itself. No task
ever holds the turns of a whole conversation; only a conversation's segments (16
numbers each) and its digest, which is one sequential hash, pass a single task,
and both are streamed.

Defined results: null role and text count as one space, a null conversation id is
one conversation; turns come by number, nulls first, equal numbers by role and
the SHA-256 of role and text; rows that repeat a turn are duplicates; blank and
duplicate turns are always deleted; a role is known by its first character, and
roles that begin otherwise can be replaced or deleted only; an empty table gives
an empty result; further columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.rank import global_row_number
from .common import NOT_SPACE, saved

SEGMENT = 32
# Costs of the edits (fixed by the task).
REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
START, AFTER_S, AFTER_U, AFTER_A = range(4)
# Role emitted from a state -> state after it.
NEXT = {(START, "s"): AFTER_S, (START, "u"): AFTER_U, (AFTER_S, "u"): AFTER_U, (AFTER_U, "a"): AFTER_A,
        (AFTER_A, "u"): AFTER_U}
STATES = range(4)


# --------------------------------------------------------------------- auction

def lattice(codes: str, exits: tuple | None) -> list[list[tuple[int, int, str]]]:
    """Arcs (cost, node, edit) of every node ``4 * turn + state``; the last node is the sink.

    ``codes`` has a pair per turn: role initial (``s u a -``) and fault (``o`` none,
    ``t`` cut off, ``x`` to delete). ``exits`` are the costs from the four exit states
    to the sink (None: not allowed); without them the conversation ends here."""
    n = len(codes) // 2
    sink = 4 * (n + 1)
    arcs: list[list[tuple[int, int, str]]] = [[] for _ in range(sink + 1)]

    def inserts(i):
        for s in STATES:
            for role in "ua":
                if (s, role) in NEXT:
                    arcs[4 * i + s].append((INSERT, 4 * i + NEXT[s, role], "I" + role))

    for i in range(n):
        role, fault = codes[2 * i], codes[2 * i + 1]
        more = CUT_OFF if fault == "t" else 0
        for s in STATES:
            here = arcs[4 * i + s]
            here.append((DELETE, 4 * i + 4 + s, "D"))
            if fault != "x":
                if (s, role) in NEXT:
                    here.append((more, 4 * i + 4 + NEXT[s, role], "K"))
                for to in "ua":
                    if to != role and (s, to) in NEXT:
                        here.append((REROLE + more, 4 * i + 4 + NEXT[s, to], "R" + to))
        inserts(i)
    if exits is None:
        inserts(n)
        exits = (0, None, None, 0)
    for s, cost in enumerate(exits):
        if cost is not None:
            arcs[4 * n + s].append((cost, sink, ""))
    return arcs


def reaching(arcs, tight=None) -> set[int]:
    """Nodes with a path to the sink (along tight arcs, if prices are given)."""
    back: list[list[int]] = [[] for _ in arcs]
    for i, out in enumerate(arcs):
        for cost, j, _ in out:
            if tight is None or tight[i] == cost + tight[j]:
                back[j].append(i)
    found, todo = {len(arcs) - 1}, [len(arcs) - 1]
    while todo:
        for i in back[todo.pop()]:
            if i not in found:
                found.add(i)
                todo.append(i)
    return found


def auction(arcs, origins) -> list[int]:
    """Prices after an auction from each origin: an origin's price is its distance to the sink.

    Prices start at zero, never exceed cost + next price, and are shared by the origins.
    Cycles of the lattice cost something, so paths do not close; nodes that cannot reach
    the sink must not be origins and their arcs are left out."""
    live = reaching(arcs)
    ways = [[(cost, j) for cost, j, _ in out if j in live] for out in arcs]
    price, sink = [0] * len(arcs), len(arcs) - 1
    for origin in origins:
        path = [origin]
        while path[-1] != sink:
            i = path[-1]
            best, to = min((cost + price[j], j) for cost, j in ways[i])
            if price[i] < best:
                price[i] = best
                if len(path) > 1:
                    path.pop()
            else:
                path.append(to)
    return price


def origins_of(arcs, states) -> list[int]:
    live = reaching(arcs)
    return [s for s in states if s in live]


@lru_cache(maxsize=20_000)
def distances(codes: str, first: bool, last: bool) -> tuple:
    """Entry state by exit state (one column, the end, in the last segment); None: no path."""
    table = []
    for x in ([None] if last else STATES):
        arcs = lattice(codes, None if last else tuple(0 if s == x else None for s in STATES))
        starts = origins_of(arcs, [START] if first else STATES)
        price = auction(arcs, starts)
        table.append([price[s] if s in starts else None for s in STATES])
    return tuple(zip(*table))


@lru_cache(maxsize=20_000)
def traced(codes: str, exits: tuple | None, first: bool) -> tuple:
    """For each entry state (None: no path) the ASCII-least cheapest edits, one string per turn
    (inserted turns, the turn's own edit, and at the very end further inserted turns), and the exit state."""
    arcs = lattice(codes, exits)
    starts = origins_of(arcs, [START] if first else STATES)
    price = auction(arcs, starts)
    good, sink, out = reaching(arcs, price), len(arcs) - 1, []
    for s in STATES:
        if s not in starts:
            out.append(None)
            continue
        edits, now, node = [], "", s
        while True:
            tight = [(edit, j) for cost, j, edit in arcs[node] if j in good and price[node] == cost + price[j]]
            edit, to = min(tight, key=lambda e: e[0][:1])
            if to == sink:
                break
            now += edit
            if edit[0] != "I":
                edits.append(now)
                now = ""
            node = to
        if now and edits:
            edits[-1] += now
        out.append((tuple(edits), node % 4))
    return tuple(out)


# ------------------------------------------------------------------------ rows

def turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
          text_col: str = "text") -> DataFrame:
    """conv_id, turn, role, text of a conversations table; nulls in role and text become one space."""
    return df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("bigint").alias("turn"),
                     *[F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(n) for c, n in ((role_col, "role"), (text_col, "text"))])


def damage(df: DataFrame) -> DataFrame:
    """Faults by ``crc32(conv_id:turn) % 20``: 0 drops a row, 1 empties it, 2 takes its sentence ends,
    3 repeats it, 4 makes it the user's; nulls in the hashed text count as one space."""
    shown = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    fault = F.crc32(F.concat(shown[0], F.lit(":"), shown[1]).cast("binary")) % 20
    hit = df.withColumn("fault", fault).where("fault <> 0")
    return hit.select(
        "conv_id", "turn", F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", ""))
        .otherwise(F.col("text")).alias("text"),
        F.explode(F.sequence(F.lit(1), F.when(F.col("fault") == 3, 2).otherwise(1))).alias("again")).drop("again")


def checked(df: DataFrame) -> DataFrame:
    """Rows of ``turns`` with their place in the conversation (``rn``, from 1) and first fault
    (``blank``, ``duplicate``, ``truncated`` or null), written once."""
    digest = F.unhex(F.sha2(F.concat(F.col("role"), F.lit("\n"), F.col("text")), 256))
    rows = saved(df.select("conv_id", "turn", "role", "text", digest.alias("digest"),
                           F.monotonically_increasing_id().alias("row_no")), "turns")
    bare = rows.select("conv_id", "turn", "role", "digest", "row_no")
    first = bare.groupBy("conv_id", "digest").agg(F.min(F.struct("turn", "row_no"))["row_no"].alias("row_no"), F.count(F.lit(1)).alias("n"))
    firsts = first.where("n > 1").select("row_no", F.lit(True).alias("is_first"))
    # a row repeats an earlier one if its group has several rows and it is not the first of them
    again = (bare.join(first.where("n > 1").select(F.col("conv_id").alias("c"), F.col("digest").alias("d")),
                       F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left_semi")
             .join(firsts, "row_no", "left_anti").select("row_no", F.lit(True).alias("again")))
    keyed = bare.withColumn("at", F.coalesce(F.col("turn").cast("double"), F.lit(-1e300))).withColumn(
        "conv", F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")))  # "": the null id
    placed = global_row_number(keyed, "at", [F.asc_nulls_first("turn"), "role", "digest", "row_no"], ["conv"], "rn").select("row_no", "rn")
    last = F.regexp_extract("text", rf"(?s)({NOT_SPACE})[\x20\x09-\x0D]*\z", 1)
    fault = (F.when(last == "", "blank").when(F.col("again"), "duplicate")
             .when(~last.isin(".", "!", "?"), "truncated"))
    return saved(rows.join(placed, "row_no").join(again, "row_no", "left")
                 .select("conv_id", "turn", "role", "text", "row_no", "rn", fault.alias("fault")), "checked-turns")


def segments(rows: DataFrame) -> DataFrame:
    """One row per 32 turns: conv_id, seg, codes, row_nos, last."""
    initial = F.substring("role", 1, 1)
    code = F.concat(F.when(initial.isin("s", "u", "a"), initial).otherwise("-"),
                    F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", "t").otherwise("o"))
    at = (F.col("rn") - 1).cast("long")
    cut = (rows.select("conv_id", F.floor(at / SEGMENT).alias("seg"), F.struct("rn", "row_no", code.alias("code")).alias("t"))
           .groupBy("conv_id", "seg").agg(F.array_sort(F.collect_list("t")).alias("t")))
    return cut.select("conv_id", "seg", F.array_join("t.code", "").alias("codes"), F.col("t.row_no").alias("row_nos"),
                      (F.col("seg") == F.max("seg").over(Window.partitionBy("conv_id"))).alias("last"))


def mapped(df: DataFrame, columns: str, fn) -> DataFrame:
    """``fn(row dict) -> row dict`` in Arrow batches; ``columns`` is the result's DDL."""
    names = [c.strip().split(" ")[0] for c in columns.split(", ")]

    def run(batches):
        for batch in batches:
            done = [fn(row) for row in batch.to_pylist()]
            yield [[d[n] for d in done] for n in names]

    return arrow(df, columns, run)


def arrow(df: DataFrame, columns: str, lists) -> DataFrame:
    """mapInArrow over a generator of column lists."""
    schema = df.sparkSession.createDataFrame([], columns).schema
    from pyspark.sql.pandas.types import to_arrow_schema
    kinds = to_arrow_schema(schema)

    def run(batches):
        for columns_of in lists(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns_of, kinds)], schema=kinds)

    return df.mapInArrow(run, schema)


def edits(rows: DataFrame) -> DataFrame:
    """(row_no, edits) of ``checked`` rows: ``K``, ``D``, ``Ru``/``Ra`` of the turn itself after any ``Iu``/``Ia``
    put before it; the last turn's may be followed by further ``Iu``/``Ia``."""
    segs = saved(segments(rows), "segments")
    pair = "row_nos array<bigint>, edits array<string>"
    short = mapped(segs.where("last and seg = 0").select("codes", "row_nos"), pair,
                   lambda r: {"row_nos": r["row_nos"], "edits": list(traced(r["codes"], None, True)[START][0])})
    conv = f"conv_id {rows.schema['conv_id'].dataType.simpleString()}"
    long = segs.where("not (last and seg = 0)")

    ways = mapped(long.select("conv_id", "seg", "codes", "last"), f"{conv}, seg bigint, codes string, last boolean, ways array<array<bigint>>",
                  lambda r: {**r, "ways": [list(w) for w in distances(r["codes"], r["seg"] == 0, r["last"])]})

    def to_end(batches):
        """Distances from a segment's exits to the end, last segment first."""
        ahead = None
        for batch in batches:
            out: list[list] = [[], [], []]
            for r in batch.to_pylist():
                for column, value in zip(out, (r["conv_id"], r["seg"], None if r["last"] else ahead)):
                    column.append(value)
                ways = [[w + a for w, a in zip(row, [0] if r["last"] else ahead) if w is not None and a is not None] for row in r["ways"]]
                ahead = [min(w) if w else None for w in ways]
            yield out

    exits = arrow(ways.drop("codes").repartition("conv_id").sortWithinPartitions("conv_id", F.desc("seg")),
                  f"{conv}, seg bigint, exits array<bigint>", to_end)
    known = long.join(exits.select(F.col("conv_id").alias("c"), F.col("seg").alias("s"), "exits"),
                      F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("seg") == F.col("s"))).drop("c", "s")

    def by_entry(r):
        found = traced(r["codes"], None if r["last"] else tuple(r["exits"]), r["seg"] == 0)
        return {**r, "found": [None if f is None else {"edits": list(f[0]), "state": f[1]} for f in found]}

    found = mapped(known.select("conv_id", "seg", "row_nos", "codes", "last", "exits"),
                   f"{conv}, seg bigint, row_nos array<bigint>, found array<struct<edits:array<string>,state:int>>", by_entry)

    def chained(batches):
        state = START
        for batch in batches:
            out: list[list] = [[], []]
            for r in batch.to_pylist():
                one = r["found"][START if r["seg"] == 0 else state]
                state = one["state"]
                out[0].append(r["row_nos"])
                out[1].append(one["edits"])
            yield out

    chosen = arrow(found.repartition("conv_id").sortWithinPartitions("conv_id", "seg"), pair, chained)
    return (short.unionByName(chosen).select(F.explode(F.arrays_zip("row_nos", "edits")).alias("e"))
            .select(F.col("e.row_nos").alias("row_no"), F.col("e.edits").alias("edits")))


def repair(df: DataFrame) -> DataFrame:
    """The rows of ``turns`` with their place, fault and edits: conv_id, rn, turn, role, text, fault, edits."""
    rows = checked(df)
    return rows.join(edits(rows), "row_no").select("conv_id", "rn", "turn", "role", "text", "fault", "edits")


def repaired_turns(repaired: DataFrame) -> DataFrame:
    """The legal conversations: conv_id, rn and step (their order), role, text, edit."""
    steps = repaired.select("conv_id", "rn", "role", "text", F.posexplode(F.regexp_extract_all("edits", F.lit("([A-Z][ua]?)"))).alias("step", "edit"))
    new_role = F.when(F.substring("edit", 2, 1) == "u", "user").when(F.substring("edit", 2, 1) == "a", "assistant")
    return steps.where("edit <> 'D'").select(
        "conv_id", "rn", "step", F.coalesce(new_role, "role").alias("role"),
        F.when(F.col("edit").startswith("I"), "").otherwise(F.col("text")).alias("text"), "edit")


LEGAL = {"su", "ua", "au"}
WORTH = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


def summary(repaired: DataFrame) -> DataFrame:
    """One row per conversation with turns: gaps, counts of faults, illegal neighbours, cost, audit,
    and the SHA-256 of its repaired ``role:text`` lines. Turns are streamed, one conversation after another."""
    counts = (repaired.groupBy("conv_id").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0)).alias("gaps"),
        *[F.count_if(F.coalesce(F.col("fault"), F.lit("")) == f).alias(f) for f in ("blank", "duplicate", "truncated")]))
    ordered = (repaired.select("conv_id", "rn", "role", "text", "fault", "edits")
               .repartition("conv_id").sortWithinPartitions("conv_id", "rn"))
    conv = f"conv_id {repaired.schema['conv_id'].dataType.simpleString()}"

    def run(batches):
        now: dict = {}

        def done():
            return [[now["conv_id"]], [now["illegal"]], [now["cost"]], ["".join(now["audit"])], [now["hash"].hexdigest()]]

        for batch in batches:
            for r in batch.to_pylist():
                if r["rn"] == 1:
                    if now:
                        yield done()
                    now = {"conv_id": r["conv_id"], "illegal": 0, "cost": 0, "audit": [], "hash": hashlib.sha256(), "before": None, "lines": 0}
                initial = r["role"][:1]
                if now["before"] is not None:
                    now["illegal"] += now["before"] + initial not in LEGAL
                now["before"] = initial
                edit = r["edits"]
                for at, letter in enumerate(edit):
                    if letter in "ua":
                        continue
                    now["audit"].append(letter)
                    now["cost"] += WORTH[letter]
                    if letter == "D":
                        continue
                    if letter in "KR" and r["fault"] == "truncated":
                        now["cost"] += CUT_OFF
                    role = r["role"] if letter == "K" else {"u": "user", "a": "assistant"}[edit[at + 1]]
                    line = f"{role}:{'' if letter == 'I' else r['text']}"
                    now["hash"].update((("\n" if now["lines"] else "") + line).encode())
                    now["lines"] += 1
        if now:
            yield done()

    told = arrow(ordered, f"{conv}, illegal bigint, cost bigint, audit string, repaired_sha256 string", run)
    return counts.join(told.withColumnRenamed("conv_id", "c"), F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")


def audits(df: DataFrame, repaired: DataFrame) -> DataFrame:
    """``summary`` for every conversation of ``df``, those without any turn left included."""
    told = summary(repaired).withColumnRenamed("conv_id", "c")
    every = df.select("conv_id").distinct()
    empty = hashlib.sha256(b"").hexdigest()
    longs = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return every.join(told, F.col("conv_id").eqNullSafe(F.col("c")), "left").select(
        "conv_id", *[F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c) for c in longs],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(empty)).alias("repaired_sha256"))
