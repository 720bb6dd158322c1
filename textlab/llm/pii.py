"""Personal data: patterns propose spans, checks confirm them, context sets the score.

Base kinds (email, ip, card, phone) follow fixed rules: leftmost non-overlapping
matches per kind, failing matches dropped without a retry. Further kinds: iban
(mod-97), ssn (range rules plus a context word), account (8 to 15 digits passing
Luhn, only beside a card or account word). Every span has a score: a prior of its
kind, raised by a passed checksum and by context words within ``NEAR`` characters.

Offsets are code points, end exclusive. Defined results: null and empty texts
have no spans; an empty table gives an empty result; repeated rows are searched
each; further columns are ignored.
"""

from __future__ import annotations

import ipaddress
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Cover

# Kinds in output order; the first four are the base kinds.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "account")
BASE = KINDS[:4]
NEAR = 40

DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
# A leftmost match starts where its run of digits does, and dots end runs: each run is read once.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
WORD = re.compile("[A-Za-z0-9]")
SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")

# Characters of an IBAN by country, where registered.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 "
    "GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 "
    "NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SD18 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}

# Context words by kind; English with the common German, French and Spanish ones.
CONTEXT = {
    "email": ("mail", "contact", "correo", "courriel"),
    "ip": ("ip", "server", "host", "address", "adresse"),
    "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "bank", "account", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security"),
    "account": ("card", "account", "konto", "compte", "cuenta", "karte", "carte", "tarjeta"),
}
PRIOR = {"email": 0.8, "ip": 0.4, "card": 0.7, "phone": 0.6, "iban": 0.8, "ssn": 0.3, "account": 0.3}
CONTEXT_GAIN = 0.2
LEAST_SCORE = 0.5  # of the kinds beyond the base ones


def luhn(digits: str) -> bool:
    odd, even = digits[::-1][::2], digits[::-1][1::2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def iban_end(text: str, start: int, stop: int) -> int:
    """End of the IBAN that starts a run of capitals and digits, 0 if none does.

    What follows an IBAN (a BIC, a capital word, a number) may continue the run, so every end
    of a word counts; the country's length is tried first, then the longest."""
    ends, n = {}, 0
    for i in range(start, stop):
        if text[i] != " ":
            n += 1
            if n >= 15 and not WORD.match(text, i + 1):
                ends[n] = i + 1
    known = IBAN_LENGTH.get(text[start:start + 2])
    longest_first = sorted(ends, reverse=True)
    for n in longest_first if known is None else [n for n in (known, *longest_first[:1]) if n in ends]:
        if mod97(text[start:ends[n]].replace(" ", "")):
            return ends[n]
    return 0


def ibans(text: str):
    """Every IBAN; a run that holds none at its start is read again from its next word."""
    at = 0
    while m := IBAN.search(text, at):
        end = iban_end(text, m.start(), m.end())
        if end:
            yield m.start(), end
        at = end or m.start() + 1


def emails(text: str):
    """Every ``@`` with a local part before and a dotted domain after it.

    The local class holds no ``@``, so the leftmost match ends its local part at the
    next ``@``; going from ``@`` to ``@`` gives the pattern's matches in linear time."""
    last, at = 0, text.find("@")
    while at >= 0:
        domain = DOMAIN.match(text, at + 1)
        start = at
        while start > last and (c := text[start - 1]) < "\x7f" and (c.isalnum() or c in "._%+-"):
            start -= 1
        if domain and start < at:
            yield start, domain.end()
            last = domain.end()
        at = text.find("@", max(at + 1, last))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "@" in text:
        found += [("email", a, b) for a, b in emails(text)]
    for m in IP.finditer(text):
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            found.append(("ip", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group()) if m.end() - m.start() >= 16 else ""
        if 16 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 8 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", m.start(), m.end()))
    return found


def further_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("iban", a, b) for a, b in ibans(text)]
    for m in SSN.finditer(text):
        area, group, serial = m.group().split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            found.append(("ssn", m.start(), m.end()))
    for m in CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 8 <= len(digits) <= 15 and luhn(digits):
            found.append(("account", m.start(), m.end()))
    return found


def score(text: str, kind: str, start: int, end: int) -> float:
    around = (text[max(0, start - NEAR):start] + " " + text[end:end + NEAR]).lower()
    near = any(re.search(rf"\b{re.escape(w)}", around) for w in CONTEXT[kind])
    points = PRIOR[kind] + (CONTEXT_GAIN if near else 0.0)
    if kind == "ip" and not _public_ip(text[start:end]):
        points -= 0.1
    return round(min(1.0, points), 3)


def _public_ip(value: str) -> bool:
    try:
        return ipaddress.ip_address(value).is_global
    except ValueError:  # leading zeros
        return False


def find_pii(text: str) -> list[tuple[str, int, int, float]]:
    """All spans (kind, start, end, score), by kind as in ``KINDS``, then start."""
    if not re.search("[0-9@]", text):
        return []
    spans = [(k, a, b, score(text, k, a, b)) for k, a, b in base_spans(text)]
    taken = Cover((a, b) for _, a, b, _ in spans)
    for k, a, b in further_spans(text):
        s = score(text, k, a, b)
        if s >= LEAST_SCORE and not taken.meets(a, b):
            spans.append((k, a, b, s))
            taken.add(a, b)
    return sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1]))


def pii_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, pii array<struct<kind, start, end, score>>."""
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches):
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "score"), s)) for s in find_pii(t or "")]
                     for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, struct)], ["doc_id", "pii"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, pii array<struct<kind:string,start:bigint,end:bigint,score:double>>")
