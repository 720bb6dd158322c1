"""Tokenising and packing against direct encoding, validity and plain best fit."""
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import types as T

from textlab.llm.packing import Encoder, configurations, encoder_of, grouped, pack_documents, plan

PATH = public_tokenizers.path("word_bpe_49k.json")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("length", T.StringType()), T.StructField("offset", T.IntegerType())])


def direct(text, tokenizer):
    return tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def check_places(rows, size):
    """Every sequence is gapless from 0 and within the size; returns the number of sequences."""
    by = defaultdict(list)
    for length, sequence, offset in rows:
        by[sequence].append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def places(p):
    """All (length, sequence, offset) of a plan, from its rank intervals."""
    out = []
    for length in {r[0] for r in p.rows}:
        rows = sorted(r for r in p.rows if r[0] == length) + [(length, int(p.next_rank[length]), 0, 0)]
        for (_, rank, first, offset), (_, end, _, _) in zip(rows, rows[1:]):
            out += [(length, first + i, offset) for i in range(end - rank)]
    return out


def plain_best_fit(lengths, size):
    free = []
    for length in sorted(lengths, reverse=True):
        fits = [i for i, f in enumerate(free) if f >= length]
        if fits:
            free[min(fits, key=lambda i: free[i])] -= length
        else:
            free.append(size - length)
    return len(free)


def test_encoder_equals_direct_encoding():
    from tokenizers import Tokenizer
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(3)
    bits = ["don't", " ", "\n", "\t", "  ", "É", "é", " ", " ", "a1b2", "<|endoftext|>", "ΣΑΣ", "'s", "\x1f", "\x0b",
            "!!", "日本語", "🙂", "İ", "\r\n", "\u0085", "w" * 40, "Ünder", "ß.", "***", "naïve,", "×", "|", "<", "µ", "́x"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(3000)]
    for text, raw in zip(texts, Encoder(PATH, most=500).encode(texts)):
        assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids, repr(text)


def test_long_parts_are_encoded_but_not_kept():
    from tokenizers import Tokenizer
    tokenizer, encoder = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = ["日本語" * 50 + " short", "w" * 500 + " short", "日本語" * 50 + " again"]
    for _ in range(2):
        for text, raw in zip(texts, encoder.encode(texts)):
            assert np.frombuffer(raw, "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert "short" in encoder.known and max(map(len, encoder.known)) <= 64


@pytest.mark.parametrize("seed", range(8))
def test_plan_is_valid_and_near_the_bound(seed):
    rng = random.Random(seed)
    draw = [lambda: rng.randint(1, 4096), lambda: rng.randint(1400, 2100), lambda: min(4096, int(rng.expovariate(1 / 700)) + 1),
            lambda: rng.choice([1366, 1365, 2049, 600, 4096, 5])][seed % 4]
    lengths = [draw() for _ in range(4000)]
    p = plan(Counter(lengths))
    placed = places(p)
    assert Counter(x[0] for x in placed) == Counter(lengths)
    n = check_places(placed, 4096)
    assert n == p.sequences
    assert n >= -(-sum(lengths) // 4096)
    assert n <= plain_best_fit(lengths, 4096), (n, plain_best_fit(lengths, 4096), sum(lengths) / 4096)


def test_groups_have_equal_cardinality_and_round_up():
    counts = np.zeros(101, np.int64)
    counts[[40, 60, 61, 90]] = 30, 5, 5, 60
    out = grouped(counts, 50, 7)
    assert sum(n for _, n in out) == 70 and {n for _, n in out} == {10} and out[0][0] == 90 and out[-1][0] == 61


def test_configurations_cover_no_more_than_there_is():
    out = configurations([60, 50, 40], [100, 90, 80], 100)
    used = np.sum([n * np.array(c) for n, c in out], axis=0)
    assert (used <= [100, 90, 80]).all() and all(sum(s * k for s, k in zip([60, 50, 40], c)) <= 100 for _, c in out)
    assert plan({60: 100, 50: 90, 40: 100}, size=100, settings=((29, 3),)).sequences == 145


def test_packed_documents(spark):
    from tokenizers import Tokenizer
    tokenizer, rng = Tokenizer.from_file(PATH), random.Random(7)
    words = ["alpha", "beta,", "Straße", "42", "x"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60, 900])))) for i in range(120)]
    rows += [(500, None), (501, ""), (502, "word " * 9000), (503, " \n "), (None, "no id"), (7, "twice"), (7, "twice")]
    rows += [(1000 + i, "the same text again") for i in range(60)]
    df = spark.createDataFrame([(i, t, "z", 9) for i, t in rows], DOCS).repartition(5)
    out = pack_documents(df, PATH, keep_ids=True).collect()
    want = Counter()
    for i, text in rows:
        ids = direct(text, tokenizer)
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = ids[start:start + 4096]
            want[(i, piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
            assert any(r.doc_id == i and r.piece == piece and list(r.ids) == part for r in out)
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    n = check_places([(r.length, r.sequence_id, r.offset) for r in out], 4096)
    assert n <= plain_best_fit([r.length for r in out], 4096)
    assert pack_documents(df.limit(0), PATH).collect() == []


def test_parts_are_learned_once_while_they_are_met(monkeypatch):
    assert encoder_of(PATH) is encoder_of(PATH)  # by the tasks of a worker, not by each
    encoder, learned = Encoder(PATH, most=200), []
    learn = encoder.learn
    monkeypatch.setattr(encoder, "learn", lambda new: (learned.extend(new), learn(new)))
    letters = [chr(97 + i // 26) + chr(97 + i % 26) for i in range(600)]
    for i, rare in enumerate(letters):
        text = f"often again {rare}zq"
        want = np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert encoder.encode([text]) == [want] and len(encoder.known) + len(encoder.older) <= 210
    assert learned.count("often") == learned.count("again") == 1 and len(learned) == 602
