"""Conversation repair against a plain search over all edit sequences by cost and audit."""

import hashlib
import random
import re
import sys
import zlib
from functools import lru_cache

import duckdb
import pytest

from textlab.llm import conversation_repair as R

NEXT = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
sys.setrecursionlimit(20_000)

SPACES = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        f = zlib.crc32(key.encode()) % 20
        if f == 0:
            continue
        if f == 1:
            text = ""
        if f == 2:
            text = re.sub("[.!?]", "", text)
        if f == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (2 if f == 3 else 1)
    return out


def faults(said):
    seen, out = set(), []
    for _, _, role, text in said:
        tail = text.rstrip(SPACES)
        out.append("blank" if not tail else "duplicate" if (role, text) in seen else "truncated" if tail[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(said, bad):
    """(cost, audit, lines) by recursion from the end; inserts never run longer than two."""
    n = len(said)

    @lru_cache(None)
    def best(i, state, inserts):
        ways = []
        if i == n and state in ("", "a"):
            ways.append((0, "", ()))
        if inserts < 2:
            for role, full in (("u", "user"), ("a", "assistant")):
                if (state, role) in NEXT:
                    rest = best(i, NEXT[state, role], inserts + 1)
                    if rest:
                        ways.append((rest[0] + 3, "I" + rest[1], (full + ":",) + rest[2]))
        if i < n:
            _, _, role, text = said[i]
            rest = best(i + 1, state, 0)
            if rest:
                ways.append((rest[0] + 4, "D" + rest[1], rest[2]))
            if bad[i] not in ("blank", "duplicate"):
                more = 3 if bad[i] == "truncated" else 0
                for letter, cost, full in (("K", 0, role), ("R", 3, "user"), ("R", 3, "assistant")):
                    if (state, full[:1]) in NEXT:
                        rest = best(i + 1, NEXT[state, full[:1]], 0)
                        if rest:
                            ways.append((rest[0] + cost + more, letter + rest[1], (full + ":" + text,) + rest[2]))
        return min(ways) if ways else None

    return best(0, "", 0)


def brute(rows):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], [])
    for r in damaged(rows):
        groups[r[0]].append(r)
    out = {}
    for conv, said in groups.items():
        said = sorted(said, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(f"{r[2]}\n{r[3]}".encode()).digest()))
        bad = faults(said)
        cost, audit, lines = cheapest(tuple(said), tuple(bad))
        known = [r[1] for r in said if r[1] is not None]
        initials = [r[2][:1] for r in said]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out[conv] = (max(known) - min(known) + 1 - len(set(known)) if known else 0, bad.count("blank"), bad.count("duplicate"),
                     bad.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def run(spark, df):
    said = R.turns(df)
    return {r[0]: tuple(r)[1:] for r in R.audits(said, R.repair(R.damage(said))).collect()}


SCHEMA = "conv_id bigint, turn bigint, role string, text string"


def test_whole_table(spark):
    from textlab.llm.queries import QUERIES
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = duckdb.sql(f"SELECT conv_id, turn, role, text FROM '{path}'").fetchall()
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == brute(rows)


def test_awkward_rows(spark):
    rng = random.Random(5)
    rows = []
    for conv in [None, *range(120)]:
        n = rng.choice([1, 1, 2, 3, 4, 6, 9])
        for t in range(n):
            turn = rng.choice([None, t, t, t, t + 2, t])
            role = rng.choice(["user", "assistant", "system", "user", "assistant", None, "", "tool", "User"])
            text = rng.choice(["Hi.", "Yes!", "no", "  ", "", None, "a?\n", "Long one. ", "tail \t", "été…", "ok. "])
            rows.append((conv, turn, role, text))
    rows += rows[:7]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", fault string, row_no int")
    assert run(spark, df) == brute(rows)


def test_long_conversations_cross_segments(spark, monkeypatch):
    monkeypatch.setattr(R, "SEGMENT", 5)
    rng = random.Random(6)
    rows = [(conv, t, rng.choice(["user", "assistant", "assistant", "system"]), rng.choice(["A.", "B", f"c {t}.", f"d {t}", ""]))
            for conv in range(12) for t in range(rng.choice([5, 6, 11, 24, 60]))]
    assert run(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_very_long_conversation(spark):
    rng = random.Random(7)
    rows = [(1, t, rng.choice(["user", "assistant"]), f"turn {t}{rng.choice(['.', '.', ''])}") for t in range(400)]
    assert run(spark, spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_repaired_turns_are_legal(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate([("system", "s."), ("assistant", "a"), ("user", "u."), ("user", "v.")])]
    said = R.turns(spark.createDataFrame(rows, SCHEMA))
    legal = R.repaired_turns(R.repair(R.damage(said))).orderBy("conv_id", "rn", "step").collect()
    told = {}
    for r in legal:
        told.setdefault(r["conv_id"], []).append(r["role"])
    assert told and all(re.fullmatch("s?(ua)+", "".join(x[0] for x in v)) for v in told.values())
    want = brute(rows)
    lines = {c: "" for c in want}
    for r in legal:
        lines[r["conv_id"]] += ("\n" if lines[r["conv_id"]] else "") + f"{r['role']}:{r['text']}"
    assert all(hashlib.sha256(v.encode()).hexdigest() == want[c][-1] for c, v in lines.items())


def test_empty_table(spark):
    assert run(spark, spark.createDataFrame([], SCHEMA)) == {}


def test_prices_are_distances():
    arcs = R.lattice("uoaxutao", None)
    price = R.auction(arcs, [R.START])
    assert all(price[i] <= c + price[j] for i, out in enumerate(arcs) for c, j, _ in out if j in R.reaching(arcs))
    assert price[R.START] == 4 + 4  # the second turn goes, and of the cut-off one and an answer put before it the former


@pytest.mark.parametrize("codes", ["", "so", "ao", "uouo", "aoaoao", "-o", "ux"])
def test_traces_end_legally(codes):
    (steps, state), = [t for t in R.traced(codes, None, True) if t]
    assert state in (R.START, R.AFTER_A) and len(steps) == len(codes) // 2
