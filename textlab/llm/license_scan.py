"""Licence scan: exact phrase places plus a fuzzy search for short notices.

A notice that occurs with at most ``k`` edits keeps one of its ``k + 1`` equal
parts intact (pigeonhole), so one Aho-Corasick pass over those seeds finds every
candidate; the ``regex`` library's bounded-error match then verifies the place
and gives its span and number of edits. Words that tell licences apart are
exact parts of a notice, the words around them may hold edits.

Texts are searched as their words ([0-9a-z] and non-ASCII runs, A-Z lowered)
joined by single spaces, so punctuation and line breaks do not matter.

Defined results: null and empty texts have no words, no places, null first and
last word, empty label strings and score 0; an empty table gives an empty
result; repeated rows are scanned each; further columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover

# Phrases whose exact places are counted, and their labels.
BASE_PHRASES = (("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc"))

# Short notices for the fuzzy search: label, then parts as (text, edits allowed in it).
NOTICES = (
    ("mit", (("under the ", 1), ("mit", 0), (" license", 1))),
    ("apache-2", (("apache", 1), (" license ", 1), ("version 2", 0))),
    ("cc-by-nc", (("licensed under", 1), (" cc by nc", 0))),
    ("cc-by-nc", (("creative commons ", 1), ("attribution", 1), (" noncommercial", 1))),
    ("gpl", (("gnu ", 0), ("general public", 2), (" license", 1))),
    ("lgpl", (("gnu lesser ", 0), ("general public", 2), (" license", 1))),
    ("mpl-2", (("mozilla ", 1), ("public license ", 1), ("version 2", 0))),
    ("bsd", (("redistribution and use in source", 2), (" and binary forms", 1))),
    ("all-rights-reserved", (("all rights ", 1), ("reserved", 1))),
    # names
    ("agpl", (("gnu ", 0), ("affero ", 1), ("general public", 2), (" license", 1))),
    ("lgpl", (("gnu ", 0), ("library ", 1), ("general public", 2), (" license", 1))),
    ("artistic-2", (("artistic license", 1), (" 2 0", 0))),
    ("boost", (("boost software", 1), (" license", 1))),
    ("cddl", (("common development", 1), (" and distribution", 1), (" license", 1))),
    ("epl", (("eclipse public license", 1),)),
    ("eupl", (("european union", 1), (" public licence", 1))),
    ("ms-pl", (("microsoft public license", 1),)),
    ("ofl", (("sil open font license", 1),)),
    # sentences that only one licence holds
    ("mit", (("of this software and associated documentation files", 3), (" the software to deal in the software without restriction", 2))),
    ("bsd-3", (("nor the names of its contributors", 2), (" may be used to endorse or promote products", 2))),
    ("0bsd", (("with or without fee is hereby granted", 2), (" the software is provided as is", 1))),
    ("isc", (("is hereby granted provided that the above copyright notice", 2), (" and this permission notice appear in all copies", 2))),
    ("unlicense", (("this is free and unencumbered software", 2), (" released into the public domain", 2))),
    ("zlib", (("in no event will the authors be held liable", 2), (" for any damages arising from the use of this software", 2))),
    # Creative Commons by name and by address
    ("cc0", (("creative commons", 1), (" zero", 0))),
    ("cc0", (("creativecommons org", 1), (" publicdomain", 1), (" zero", 0))),
    ("cc-by-sa", (("creative commons", 1), (" attribution", 1), (" sharealike", 1))),
    ("cc-by-nd", (("creative commons", 1), (" attribution", 1), (" noderivatives", 1))),
    ("cc-by", (("creative commons", 1), (" attribution", 1), (" 4 0", 0))),
    ("cc-by", (("creative commons", 1), (" attribution", 1), (" 3 0", 0))),
    ("cc-by", (("licensed under", 1), (" cc by 4 0", 0))),
    ("cc-by", (("licensed under", 1), (" cc by 3 0", 0))),
    ("cc-by", (("creativecommons org", 1), (" licenses", 1), (" by 4 0", 0))),
    ("cc-by", (("creativecommons org", 1), (" licenses", 1), (" by 3 0", 0))),
    ("cc-by-nc", (("creativecommons org", 1), (" licenses", 1), (" by nc", 0))),
    ("cc-by-nd", (("creativecommons org", 1), (" licenses", 1), (" by nd", 0))),
    ("cc-by-sa", (("creativecommons org", 1), (" licenses", 1), (" by sa", 0))),
    # identifier lines; an exact part begins with its space, so no edit can run into another identifier
    ("0bsd", (("spdx license identifier", 2), (" 0bsd", 0))),
    ("agpl", (("spdx license identifier", 2), (" agpl", 0))),
    ("apache-2", (("spdx license identifier", 2), (" apache 2 0", 0))),
    ("boost", (("spdx license identifier", 2), (" bsl 1 0", 0))),
    ("bsd", (("spdx license identifier", 2), (" bsd 2 clause", 0))),
    ("bsd-3", (("spdx license identifier", 2), (" bsd 3 clause", 0))),
    ("cc-by", (("spdx license identifier", 2), (" cc by 3 0", 0))),
    ("cc-by", (("spdx license identifier", 2), (" cc by 4 0", 0))),
    ("cc-by-nc", (("spdx license identifier", 2), (" cc by nc", 0))),
    ("cc-by-nd", (("spdx license identifier", 2), (" cc by nd", 0))),
    ("cc-by-sa", (("spdx license identifier", 2), (" cc by sa", 0))),
    ("cc0", (("spdx license identifier", 2), (" cc0 1 0", 0))),
    ("epl", (("spdx license identifier", 2), (" epl", 0))),
    ("gpl", (("spdx license identifier", 2), (" gpl", 0))),
    ("isc", (("spdx license identifier", 2), (" isc", 0))),
    ("lgpl", (("spdx license identifier", 2), (" lgpl", 0))),
    ("mit", (("spdx license identifier", 2), (" mit", 0))),
    ("mpl-2", (("spdx license identifier", 2), (" mpl 2 0", 0))),
    ("unlicense", (("spdx license identifier", 2), (" unlicense", 0))),
    ("zlib", (("spdx license identifier", 2), (" zlib", 0))),
)

SCHEMA = ("doc_id {id}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, "
          "labels string, score double, spans array<struct<label:string,start:bigint,end:bigint,edits:int>>")


def seeds(phrase: str, k: int) -> list[tuple[str, int]]:
    """``k + 1`` near-equal consecutive parts of the phrase with their offsets."""
    cuts = [len(phrase) * i // (k + 1) for i in range(k + 2)]
    return [(phrase[a:b], a) for a, b in zip(cuts, cuts[1:])]


class Scanner:
    """Compiled notices; built once per task."""

    def __init__(self, notices=NOTICES, base=BASE_PHRASES):
        import ahocorasick
        import regex
        self.base = [(label, f" {phrase} ".encode()) for label, phrase in base]
        self.word = re.compile(rb"[0-9a-z\x80-\xff]+")
        self.notices, at = [], {}
        for i, (label, parts) in enumerate(notices):
            phrase, k = "".join(t for t, _ in parts), sum(e for _, e in parts)
            body = "".join(f"(?:{regex.escape(t, special_only=True)}){{e<={e}}}" if e else regex.escape(t) for t, e in parts)
            self.notices.append((label, len(phrase), k, regex.compile(rf"(?b)(?<= ){body}(?= )")))
            for seed, offset in seeds(phrase, k):
                at.setdefault(seed, []).append((i, offset))
        self.seeds = ahocorasick.Automaton()
        for seed, where in at.items():
            self.seeds.add_word(seed, (len(seed), where))
        self.seeds.make_automaton()

    def scan(self, text: bytes) -> dict:
        words = self.word.findall(text.lower())  # bytes.lower() changes A-Z only
        flat = b" " + b" ".join(words) + b" "
        spaces = np.flatnonzero(np.frombuffer(flat, np.uint8) == 32)
        word_at = lambda byte: int(np.searchsorted(spaces, byte))
        base = []
        for label, phrase in self.base:
            at = flat.find(phrase)
            while at >= 0:
                n = word_at(at)
                base.append((label, n, n + phrase.count(b" ") - 1, 0))
                at = flat.find(phrase, at + 1)
        chars = flat.decode("latin-1")  # one character a byte: offsets stay byte offsets
        windows: dict[int, list] = {}
        for end, (size, where) in self.seeds.iter(chars):
            for i, offset in where:
                start = end - size + 1 - offset
                windows.setdefault(i, []).append(start)
        fuzzy = set()
        for i, starts in windows.items():
            label, size, k, pattern = self.notices[i]
            done = -1
            for start in sorted(starts):
                lo, hi = max(0, start - k - 1), min(len(chars), start + size + k + 1)
                if start + k < done:
                    continue
                m = pattern.search(chars, lo, hi) if hi > lo else None
                if m and m.end() > m.start():
                    first = word_at(m.start()) - 1
                    last = word_at(m.end())
                    fuzzy.add((label, first, last, sum(m.fuzzy_counts), size))
                    done = m.end()
        covers = {label: Cover(b[1:3] for b in base if b[0] == label) for label, _ in self.base}
        spans = base + [x[:4] for x in fuzzy if not (x[0] in covers and covers[x[0]].meets(x[1], x[2]))]
        score = 1.0 if base else max((1.0 - e / size for _, _, _, e, size in fuzzy), default=0.0)
        return {
            "n_words": len(words), "n_base": len(base),
            "first_word": min((b[1] for b in base), default=None), "last_word": max((b[1] for b in base), default=None),
            "base_labels": ",".join(sorted({b[0] for b in base})), "labels": ",".join(sorted({s[0] for s in spans})),
            "score": score,
            "spans": [dict(zip(("label", "start", "end", "edits"), s)) for s in sorted(spans, key=lambda s: (s[1], s[2], s[0]))],
        }


def license_scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices=NOTICES) -> DataFrame:
    """One row per input row with counts, labels, score and word spans (end exclusive)."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    schema = SCHEMA.format(id=rows.schema["doc_id"].dataType.simpleString())

    def run(batches):
        scanner = Scanner(notices)
        for batch in batches:
            found = [scanner.scan(t or b"") for t in batch.column(1).to_pylist()]
            struct = pa.struct([("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int32())])
            kinds = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(), "last_word": pa.int64(),
                     "base_labels": pa.string(), "labels": pa.string(), "score": pa.float64(), "spans": pa.list_(struct)}
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([f[c] for f in found], t) for c, t in kinds.items())], ["doc_id", *kinds])

    return rows.mapInArrow(run, schema)
