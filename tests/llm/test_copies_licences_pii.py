"""Exact dedup, licence scan and PII against brute force on small fixtures."""
import hashlib
import random
import re

import pytest
from pyspark.sql import types as T

from textlab.llm.common import Cover
from textlab.llm.exact_dedup import exact_dedup, misra_gries
from textlab.llm.license_scan import NOTICES, Scanner, license_scan
from textlab.llm.pii import KINDS, base_spans, find_pii, luhn, mod97, pii_spans

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("digest", T.StringType()), T.StructField("keep_id", T.IntegerType())])


def frame(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "x", 7) for i, t in rows], DOCS)


# ------------------------------------------------------------------ exact dedup

def brute_copies(rows):
    plain = [(i, re.sub(r"[\x20\x09-\x0D]+", " ", t or "")) for i, t in rows]
    out = []
    for i, t in plain:
        group = [j for j, u in plain if u == t]
        keep = min((j for j in group if j is not None), default=None)
        out.append((i, keep, len(group), i == keep, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=repr)


def copies(df, **kw):
    return sorted([(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(df, **kw).collect()], key=repr)


@pytest.mark.parametrize("k", [2, 256])
def test_copies_match_brute_force(spark, k):
    rng = random.Random(5)
    rows = [(i, rng.choice(["a b", "a\n\tb", "hot", "hot ", " hot", "", None, "ü b", f"u{i}"])) for i in range(90)]
    rows += [(i, "one hot text") for i in range(100, 160)]  # a third of all rows
    rows += [(None, "a b"), (None, "only null"), (None, "only null"), (3, "again"), (3, "again"), (7, "w " * 30_000)]
    assert copies(frame(spark, rows), k=k) == brute_copies(rows)


def test_copies_of_an_empty_table(spark):
    assert copies(frame(spark, [])) == []


def test_misra_gries_never_misses_a_frequent_value(spark):
    rng = random.Random(1)
    values = ["f1"] * 200 + ["f2"] * 150 + [f"r{i}" for i in range(400)]
    rng.shuffle(values)
    df = spark.createDataFrame([(v,) for v in values], "v string").repartition(7)
    found = {bytes(r.value).decode() for r in misra_gries(df, "v", 9).collect()}
    assert {"f1", "f2"} <= found and len(found) <= 9


# ---------------------------------------------------------------- licence scan

def brute_places(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    places = []
    for label, phrase in (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")):
        p = phrase.split()
        places += [(i, label) for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    return words, places


CASES = [
    None, "", "Released under the MIT License.", "cc-by-nc 4.0, CC BY NC", "Apache License, Version 2.0.",
    "Apache License, Version 2. 0", "under the mit license under the mit license", "underthe mit license",
    "ÜNDER THE MIT LICENSE under\nthe\tmit license", "cc by nc by nc cc by", "x " * 5000 + "cc by nc",
    "İK under the mit license", "no licence here",
]


def test_base_places_match_brute_force(spark):
    out = {r.doc_id: r for r in license_scan(frame(spark, list(enumerate(CASES)))).collect()}
    for i, text in enumerate(CASES):
        words, places = brute_places(text)
        r = out[i]
        assert (r.n_words, r.n_base) == (len(words), len(places)), text
        assert r.first_word == min((p for p, _ in places), default=None)
        assert r.last_word == max((p for p, _ in places), default=None)
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert 0 <= r.score <= 1


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_every_notice_is_found_within_its_edits():
    rng, scanner = random.Random(2), Scanner()
    for label, parts in NOTICES:
        for _ in range(25):
            changed = ""
            for part, k in parts:
                chars = list(part)
                for _ in range(rng.randint(0, k)):
                    at = rng.randrange(1, max(2, len(chars) - 1))
                    kind = rng.randrange(3)
                    if chars[at:at + 1] != [" "]:
                        chars[at:at + (kind != 0)] = [] if kind == 1 else [rng.choice("xqz")]
                changed += "".join(chars)
            got = scanner.scan(f"some words {changed} and more".encode())
            assert label in got["labels"].split(","), changed
            assert got["score"] > 0.7


def damaged(part, k, rng):
    """``part`` with exactly ``k`` letters replaced, dropped or doubled, none of them its first or last."""
    chars = list(part)
    inner = [i for i in range(1, len(chars) - 1) if chars[i] != " "]
    for at in sorted(rng.sample(inner, k), reverse=True):
        chars[at:at + 1] = rng.choice((["x"], [], [chars[at], "x"]))
    return "".join(chars)


def test_every_notice_is_found_at_its_edit_bound():
    rng, scanner, found, planted = random.Random(5), Scanner(), 0, 0
    for label, parts in NOTICES:
        for _ in range(20):
            text = "".join(damaged(part, k, rng) for part, k in parts)
            got = scanner.scan(f"as stated above {text} see also".encode())
            planted += 1
            found += label in got["labels"].split(",")
    assert found == planted


def test_each_notice_gives_its_own_label_alone():
    scanner = Scanner()
    for label, parts in NOTICES:
        phrase = "".join(part for part, _ in parts)
        assert scanner.scan(f"see {phrase} here".encode())["labels"] == label, phrase


def test_notices_as_people_write_them():
    scanner = Scanner()
    for text, labels in (
            ("// SPDX-License-Identifier: LGPL-2.1-or-later", "lgpl"),
            ("# SPDX-License-Identifier: AGPL-3.0-only", "agpl"),
            ("/* SPDX-License-Identifer: BSD-3-Clause */", "bsd-3"),
            ("Text: https://creativecommons.org/licenses/by-sa/4.0/", "cc-by-sa"),
            ("https://creativecommons.org/licenses/by-nc-sa/3.0/", "cc-by-nc"),
            ("https://creativecommons.org/licenses/by/4.0/deed.en", "cc-by"),
            ("https://creativecommons.org/publicdomain/zero/1.0/", "cc0"),
            ("under the Creative Commons Attribution-ShareAlike 4.0 licence", "cc-by-sa"),
            ("under the Creative Commons Attribution Share Alike licence", "cc-by-sa"),
            ("Creative Commons Attribution 4.0 International", "cc-by"),
            ("GNU Affero General Public License v3", "agpl"),
            ("GNU Lesser General Public Licence", "lgpl"),
            ("This is free and unencumbered software released in to the public domain.", "unlicense"),
            ("In no event will the authors be held liable for any damage arising from the use of this software.", "zlib"),
            ("with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\"", "0bsd"),
            ("with or without fee is hereby granted, provided that the above copyright notice and this permission "
             "notice appear in all copies.", "isc"),
            ("Distributed under the Boost Software License, Version 1.0.", "boost"),
            ("made available under the Eclipse Public Licence 2.0", "epl")):
        assert scanner.scan(text.encode())["labels"] == labels, text
    for text in ("the eclipse was seen by the public", "a common development of the city", "an open font of knowledge",
                 "license identifier missing", "the creative commons of the village", "spdx license identifier proprietary",
                 "neither the names nor the products", "free software in the public library"):
        assert scanner.scan(text.encode())["labels"] == "", text


def test_other_licences_do_not_match():
    scanner = Scanner()
    for text in ("under the mpl license", "apache license version 1", "licensed under cc by sa", "the license of the mit",
                 "all right then", "general public transport license"):
        assert scanner.scan(text.encode())["labels"] == "", text


def test_many_notices_in_one_long_text():
    got = Scanner().scan(b"under the mit license. All rights reservd? all rights reserved. " * 20_000)
    assert got["n_base"] == 20_000 and got["labels"] == "all-rights-reserved,mit"
    assert sum(s["label"] == "mit" for s in got["spans"]) == 20_000


def test_fuzzy_span_covers_the_changed_words():
    got = Scanner().scan(b"Released undr the MIT Licence today")
    assert [(s["label"], s["start"], s["end"], s["edits"]) for s in got["spans"]] == [("mit", 1, 5, 2)]
    assert edits("undr the mit licence", "under the mit license") == 2


# -------------------------------------------------------------------------- PII

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(digits):
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            ok = {"email": True, "ip": kind == "ip" and all(int(p) < 256 for p in m.group().split(".")),
                  "card": 16 <= len(digits) <= 19 and plain_luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_match_the_plain_patterns():
    rng = random.Random(3)
    bits = ["a", "b.c", "@", "@x.yz", "mail4", ".", "-", " ", "é", "1.2.3.4", "256.1.1.1", "10.0.0.300.7", "4539578763621486",
            "4539 5787 6362 1486", "0000000000000000", "+1 (555) 123-4567", "+4", "9", "555", "\n", "+", "%", "12345678901234567890"]
    for _ in range(3000):
        text = "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))
        assert base_spans(text) == brute_spans(text), text


def test_long_runs_and_many_spans_end():
    digits = "7" * 300_000  # longer than int() takes, and no pattern may read it again from every digit
    assert find_pii(f"{digits}.1.1.1 {digits}") == []
    assert base_spans("0" * 6000 + "1.2.3.4") == [("ip", 0, 6007)]
    many = "ssn 123-45-6789, 4539 5787 6362 1486; " * 20_000
    kinds = [s[0] for s in find_pii(many)]
    assert kinds.count("ssn") == kinds.count("card") == 20_000


def test_cover_is_a_plain_overlap_test():
    rng = random.Random(4)
    for _ in range(300):
        spans = [(a, a + rng.randint(1, 6)) for a in (rng.randint(0, 60) for _ in range(rng.randint(0, 8)))]
        cover = Cover(spans)
        for _ in range(12):
            a = rng.randint(0, 66)
            b = a + rng.randint(1, 6)
            meets = any(a < y and x < b for x, y in spans)
            assert cover.meets(a, b) == meets
            if not meets:
                cover.add(a, b)
                spans.append((a, b))


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("DE89370400440532013000") and not mod97("DE89370400440532013001")


def test_method_kinds_and_context():
    spans = find_pii("iban DE89 3704 0044 0532 0130 00, ssn 123-45-6789, and 123-45-6780; code 79927398713; account 79927398713")
    kinds = [s[0] for s in spans]
    assert kinds.count("iban") == 1 and kinds.count("ssn") >= 1 and kinds.count("account") >= 1
    assert find_pii("build 123-45-6789") == []  # no context word
    near, far = find_pii("call +1 (555) 123-4567")[0][3], find_pii("x +1 (555) 123-4567")[0][3]
    assert near > far


def test_spans_of_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "é" * 5 + "a@b.co" + " x" * 40_000 + " 8.8.8.8"), (3, "a@b.co"), (None, "+1 555 123 4567")]
    out = sorted([(r.doc_id or 0, [(s.kind, s.start, s.end) for s in r.pii]) for r in pii_spans(frame(spark, rows)).collect()])
    long = 5 + 6 + 80_000 + 1
    assert out == [(0, [("phone", 0, 15)]), (1, []), (2, []), (3, [("email", 0, 6)]),
                   (3, [("email", 5, 11), ("ip", long, long + 7)])]
    assert pii_spans(frame(spark, [])).collect() == [] and list(KINDS[:4]) == ["email", "ip", "card", "phone"]


def test_iban_ends_before_what_follows():
    german, british, norse = "DE89 3704 0044 0532 0130 00", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"
    for iban in (german, german.replace(" ", ""), british, british.replace(" ", ""), norse):
        for after in (" BIC COBADEFFXXX", " BIC: COBADEFFXXX", " SWIFT NWBKGB2L", " 2024", " 7", " UND MEHR TEXT IN GROSSEN BUCHSTABEN", " and", ".", ""):
            for before in ("", "IBAN ", "AB12 ", "é"):
                text = before + iban + after
                assert [text[a:b] for k, a, b, _ in find_pii(text) if k == "iban"] == [iban], text
    both = f"{german} {british} {norse}"
    assert [both[a:b] for k, a, b, _ in find_pii(both) if k == "iban"] == [german, british, norse]
    assert "iban" not in [s[0] for s in find_pii("DE89 3704 0044 0532 0130 01 BIC COBADEFFXXX")]  # wrong check digits
    assert "iban" not in [s[0] for s in find_pii(german.replace(" ", "") + "x")]
    assert find_pii("AA00 " * 20_000) is not None  # linear
