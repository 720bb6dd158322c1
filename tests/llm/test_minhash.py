"""MinHash near-duplicates against all pairs of full shingle sets."""

import random
import re

import numpy as np
import pytest

from textlab.llm import minhash as M

SCHEMA = "doc_id bigint, text string"


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    n = min(k, len(words))
    return {tuple(words[i:i + n]) for i in range(len(words) - n + 1)} if words else set()


def brute(rows, k=3, percent=85):
    sets = [shingles(t, k) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (doc_id, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(doc_id)
    least = {r: min((d for d in ids if d is not None), default=None) for r, ids in groups.items()}
    out = []
    for i, (doc_id, _) in enumerate(rows):
        component = least[find(i)] if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), component, doc_id == component))
    return sorted(out, key=str)


def run(spark, rows, **args):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", key string, mark int")
    return sorted([tuple(r)[:4] for r in M.near_duplicates(df, **args).collect()], key=str)


def family(rng, n, words, edits):
    base = [f"w{rng.randrange(5000)}" for _ in range(words)]
    out = []
    for _ in range(n):
        text = list(base)
        for _ in range(rng.randint(0, edits)):
            text[rng.randrange(words)] = f"x{rng.randrange(100_000)}"
        out.append(" ".join(text))
    return out


def made(seed, n=40, families=6):
    rng = random.Random(seed)
    texts = [t for _ in range(families) for t in family(rng, n, rng.choice([5, 30, 120, 300]), rng.choice([1, 3, 8]))]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_families(spark):
    rows = made(1)
    assert run(spark, rows) == brute(rows)


def test_awkward_rows(spark):
    rows = [(9, None), (8, ""), (7, " \n\t"), (6, "one"), (5, "ONE"), (4, "one two"), (3, "one  two"), (2, "É é É"), (1, "é É é"),
            (None, "a b c d e f g h"), (None, "A b c d e f g h"), (20, "a b c d e f g h"), (20, "a b c d e f g h"), (None, "lonely words here"),
            (30, "a b c d"), (31, "a b c d")]
    long = " ".join(f"t{i}" for i in range(30_000))
    rows += [(40, long), (41, long + " tail"), (42, long.replace("t5 ", "t6 "))]
    assert run(spark, rows) == brute(rows)


def test_other_shingle_and_threshold(spark):
    rows = made(2, n=20)
    assert run(spark, rows, shingle=2, percent=95) == brute(rows, 2, 95)


def test_blocks_pivots_and_stars(spark, monkeypatch):
    """A candidate group over many blocks, keys too large to compare, and a key linked map-side."""
    monkeypatch.setattr(M, "GROUP_ROWS", 12)
    monkeypatch.setattr(M, "KEY_ROWS", 15)
    monkeypatch.setattr(M, "PIVOTS", 2)
    rng = random.Random(3)
    # a chain: neighbours are alike, its ends are not; and loose members that link to few others
    words = [f"w{i}" for i in range(150)]
    chain = []
    for i in range(60):
        chain.append(" ".join(words))
        words[(i * 3) % 150] = f"c{i}"
    texts = chain + family(rng, 90, 100, 9) + family(rng, 30, 100, 14)
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    assert run(spark, rows) == brute(rows)


def test_copies_and_empty(spark):
    rows = [(i, "the same words again and again in every copy of this text") for i in range(300)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_every_pair_within_the_distance_shares_a_key():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2 ** 16, (300, M.SYMBOLS)).astype(np.uint16)
    b = a.copy()
    for i in range(300):
        wrong = rng.choice(M.SYMBOLS, M.DISTANCE, replace=False)
        b[i, wrong] ^= np.uint16(1 + rng.integers(0, 2 ** 15))
    assert (M.keys_of(a) == M.keys_of(b)).any(axis=1).all()
    assert (M.differing(M.packed(a), M.packed(b)) <= M.DISTANCE).all()
    assert not (M.keys_of(a)[:150] == M.keys_of(a)[150:]).any()


def test_distance_suits_the_similarity():
    assert M.missed(0.85) < 1e-5


def test_symbols_agree_like_similarity():
    rng = np.random.default_rng(2)
    base = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    apart = []
    for i in range(60):
        other = np.concatenate([base[:340], rng.integers(0, 2 ** 63, 60).astype(np.uint64)])
        apart.append((M.signature(np.unique(base + np.uint64(i))) != M.signature(np.unique(other + np.uint64(i)))).mean())
    assert abs(np.mean(apart) - (1 - 340 / 460)) < 0.04


@pytest.mark.parametrize("seed", range(6))
def test_stars_join_components(seed):
    rng = random.Random(seed)
    known = M.WordHashes()
    texts = [t for _ in range(4) for t in family(rng, 25, rng.choice([10, 80]), 6)]
    sets = [M.shingle_set(t.encode(), known) for t in texts]
    root = {i: i for i in range(len(sets))}
    for a, b in M.stars(sets, 85):
        root[a] = b
    want = {d: c for d, _, c, _ in brute(list(enumerate(texts)))}
    assert {i: min(j for j in root if root[j] == root[i]) for i in root} == want
