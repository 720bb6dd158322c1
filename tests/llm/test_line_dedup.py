"""Line dedup against a plain re-telling of its rules, and planted passages."""
import random
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textlab.llm.line_dedup import GRAM, LEAST, REACH, line_dedup

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("k1", T.StringType()), T.StructField("row", T.IntegerType())])


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], DOCS)


def run(spark, rows, **kw):
    got = line_dedup(frame(spark, rows).repartition(5), **kw).select("row.*", "new_text", "removed_lines", "removed_words").collect()
    assert all(r.k1 == "x" and r.row == 1 for r in got)
    return got


def hashes(spark, values):
    """The built-in hashes that order grams: of lines, then of lists of them."""
    df = spark.createDataFrame([(v,) for v in values], "v string")
    return {r.v: r.h for r in df.select("v", F.xxhash64("v").alias("h")).collect()}


def brute(spark, rows, gram, reach, least):
    docs = []
    for i, text in {(i, t) for i, t in rows if t is not None}:
        lines = [(p, x.strip(" \t\x0b\x0c\r"), len(re.findall(r"[^\x20\x09-\x0D]+", x))) for p, x in enumerate(text.split("\n"))]
        docs.append(((i is None, i or 0, text), [x for x in lines if x[2]]))
    line_hash = hashes(spark, sorted({x[1] for _, ls in docs for x in ls}))
    wanted, prints = {}, []
    for key, ls in docs:
        starts = [sum(x[2] for x in ls[:j]) for j in range(len(ls))]
        total = sum(x[2] for x in ls)
        grams = {j: tuple(ls[m][1] for m in range(j, len(ls)) if starts[m] < starts[j] + gram)
                 for j in range(len(ls)) if total - starts[j] >= gram}
        wanted[key] = ls, starts, grams
    lists = sorted({g for _, _, grams in wanted.values() for g in grams.values()})
    df = spark.createDataFrame([(n, [line_hash[x] for x in g]) for n, g in enumerate(lists)], "n int, g array<bigint>") if lists else None
    order = {lists[r.n]: r.h for r in df.select("n", F.xxhash64("g").alias("h")).collect()} if lists else {}
    for key, (ls, starts, grams) in wanted.items():
        chosen = set()
        for j in range(len(ls)):
            window = [(order[grams[m]], m) for m in range(j, len(ls)) if starts[m] < starts[j] + reach and m in grams]
            if window:
                chosen.add(min(window)[1])
        prints += [(grams[m], key, m) for m in chosen]
    by = defaultdict(list)
    for g, key, m in prints:
        by[g].append((key, m))
    hit = defaultdict(set)
    for places in by.values():
        places.sort(key=lambda p: (p[0][:2], p[1]))
        for n, (key, m) in enumerate(places):
            ls, starts, _ = wanted[key]
            for first_key, first in places[:n]:  # every earlier occurrence
                fl, fs, _ = wanted[first_key]
                hit[key].add(m)
                a, b = m - 1, first - 1
                while a >= 0 and b >= 0 and starts[m] - starts[a] < reach and fs[first] - fs[b] < reach and ls[a][1] == fl[b][1]:
                    hit[key].add(a)
                    a, b = a - 1, b - 1
                a, b = m + 1, first + 1
                while a < len(ls) and b < len(fl) and starts[a] < starts[m + 1] + gram + reach - 1 \
                        and fs[b] < fs[first + 1] + gram + reach - 1 and ls[a][1] == fl[b][1]:
                    hit[key].add(a)
                    a, b = a + 1, b + 1
    out = {}
    for key, (ls, _, _) in wanted.items():
        gone, j = set(), 0
        while j < len(ls):
            if j not in hit[key]:
                j += 1
                continue
            end = j
            while end < len(ls) and end in hit[key]:
                end += 1
            if sum(ls[m][2] for m in range(j, end)) >= least:
                gone.update(ls[m][0] for m in range(j, end))
            j = end
        out[key] = "\n".join(x for p, x in enumerate(key[2].split("\n")) if p not in gone)
    return out


@pytest.mark.parametrize("seed, gram, reach, least", [(1, GRAM, REACH, LEAST), (2, 6, 5, 10), (3, 3, 1, 3), (4, 4, 6, 12)])
def test_matches_a_plain_retelling(spark, seed, gram, reach, least):
    rng = random.Random(seed)
    scale = max(1, gram // 6)
    pool = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randint(1, 4 * scale))) for _ in range(25)]
    rows = []
    for i in range(60):
        lines = [rng.choice([rng.choice(pool), f"own {rng.random()} " * rng.randint(1, 3), "", "  "]) for _ in range(rng.randint(0, 12))]
        at = rng.randint(0, len(lines))
        start = rng.randrange(len(pool) - 8)
        lines[at:at] = pool[start:start + rng.randint(0, 8)]
        rows.append((i, "\n".join(lines)))
    rows += [(500, rows[7][1]), (501, rows[7][1] + "\n" + rows[8][1])]
    want = brute(spark, rows, gram, reach, least)
    for r in run(spark, rows, gram=gram, reach=reach, least=least):
        assert r.new_text == want[(False, r.doc_id, r.text)], r.doc_id


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_planted_passages_go_and_clean_text_stays(spark):
    rng = random.Random(9)
    passages = []
    for k in range(6):  # over 50 words, in one line or many
        n = rng.randint(51, 120)
        ws, lines = words(rng, n).split(" "), []
        while ws:
            step = n if k == 0 else rng.randint(1, 14)
            lines.append(" ".join(ws[:step]))
            ws = ws[step:]
        passages.append(lines)
    short, rows, where = words(rng, 12), [], {}
    for i in range(120):
        own = [words(rng, rng.randint(1, 40)) for _ in range(rng.randint(2, 8))] + [short]
        if i % 3 == 0:
            p = rng.randrange(6)
            at = rng.randint(0, len(own) - 2)  # not beside the line that all texts share
            own[at:at] = passages[p]
            where[i] = p
        rows.append((i, "\n".join(own)))
    seen = set()
    got = {r.doc_id: r for r in run(spark, rows)}
    for i, text in rows:
        p = where.get(i)
        want = text if p is None or p not in seen else text.replace("\n".join(passages[p]), "").strip("\n").replace("\n\n", "\n")
        seen.add(p)
        assert got[i].new_text == want, i
        assert (got[i].removed_lines > 0) == (want != text)


def test_earlier_fragments_hide_no_later_passage(spark):
    rng = random.Random(21)
    rows, whole = [], {}
    for p in range(12):
        lines = [words(rng, rng.randint(3, 9)) for _ in range(rng.randint(9, 14))]
        while sum(len(x.split(" ")) for x in lines) < 51:
            lines.append(words(rng, 6))
        for n in range(8):  # fragments before, between and after the whole passages
            own = [words(rng, 20), words(rng, 20)]
            if n in (2, 4, 6, 7):
                own[1:1] = lines
                whole[100 * p + n] = lines
            else:
                a = rng.randint(0, 3)
                b, left = a, 46  # short of a run
                while b < len(lines) and left >= len(lines[b].split(" ")):
                    left -= len(lines[b].split(" "))
                    b += 1
                own[1:1] = lines[a:b]
            rows.append((100 * p + n, "\n".join(own)))
    rng.shuffle(rows)
    got = {r.doc_id: r.new_text for r in run(spark, rows)}
    for i, text in rows:
        if i in whole and i % 100 > 2:
            assert got[i] == text.replace("\n".join(whole[i]) + "\n", ""), i
        elif i % 100 < 2:
            assert got[i] == text, i


def test_hot_copies_and_repeats_within_one_text(spark):
    rng = random.Random(3)
    text = "\n".join(words(rng, 9) for _ in range(12))
    rows = [(i, text) for i in range(150)] + [(200 + i, words(rng, 60)) for i in range(100)] + [(400, text + "\n" + "x " * 60 + "\n" + text)]
    got = {r.doc_id: r for r in run(spark, rows)}
    assert got[0].new_text == text and all(got[i].new_text == "" and got[i].removed_lines == 12 for i in range(1, 150))
    assert all(got[i].removed_lines == 0 for i in range(200, 300))
    assert got[400].new_text == "x " * 60
    own = words(rng, 55)
    assert run(spark, [(1, f"{own}\nmid\n{own}\n{own}")])[0].new_text == f"{own}\nmid"


def test_odd_rows(spark):
    rng = random.Random(4)
    long, p = "\n".join(words(rng, 10) for _ in range(3000)), words(rng, 60)
    rows = [(1, None), (2, ""), (3, "\n \n"), (4, p), (5, p), (5, p), (None, p), (6, long)]
    got = sorted([(r.doc_id or 0, r.new_text, r.removed_words) for r in run(spark, rows)], key=lambda x: x[0])
    assert got == [(0, "", 60), (1, None, 0), (2, "", 0), (3, "\n \n", 0), (4, p, 0), (5, "", 60), (5, "", 60), (6, long, 0)]
    assert run(spark, []) == []


def test_only_jvm_expressions(spark):
    plan = line_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
