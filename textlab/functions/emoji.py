"""Emoji to words (re-aimed): Unicode names by rule, as column expressions.

A symbol sequence (flag, keycap, skin tone, joined figures) is found whole, longest
first, and gets one name; the name table is built from the standard library's
Unicode names and looked up by position, one step a symbol.

``words`` mode mirrors the baseline cleaner: each emoji becomes
``:name_with_underscores:`` and every ``:<non-space run>:`` then has ``_``/``-``
turned into spaces and ``:`` removed. ``tokens`` mode mirrors the generic
cleaner: `` name_with_underscores `` (space delimited, underscores kept).
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import NON_WS, once

# Code-point blocks scanned for pictographic symbols.
EMOJI_BLOCKS = [(0x2600, 0x27BF), (0x2B00, 0x2BFF), (0x1F000, 0x1FAFF)]
# Parts of symbol sequences.
FLAG_LETTER = r"[\x{1F1E6}-\x{1F1FF}]"
FLAG_A = 0x1F1E6
TONE = r"[\x{1F3FB}-\x{1F3FF}]"
BLOCKS = "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in EMOJI_BLOCKS)
VARIATION, JOINER, KEYCAP = r"\x{FE0F}", r"\x{200D}", r"\x{20E3}"
TAGS = r"[\x{E0020}-\x{E007F}]"


@lru_cache(maxsize=1)
def emoji_names() -> dict[int, str]:
    """code point -> lower-case name with underscores (symbol categories So, Sk)."""
    out = {}
    for lo, hi in EMOJI_BLOCKS:
        for cp in range(lo, hi + 1):
            ch = chr(cp)
            if unicodedata.category(ch) in ("So", "Sk"):
                name = unicodedata.name(ch, "")
                if name:
                    out[cp] = name.lower().replace(" ", "_")
    return out


@lru_cache(maxsize=1)
def symbol_ranges() -> str:
    """The named code points as ranges of a character class."""
    spans: list[list[int]] = []
    for cp in sorted(emoji_names()):
        if spans and cp == spans[-1][1] + 1:
            spans[-1][1] = cp
        else:
            spans.append([cp, cp])
    return "".join(f"\\x{{{lo:X}}}-\\x{{{hi:X}}}" for lo, hi in spans)


def sequence_pattern() -> str:
    """A whole symbol sequence: a flag, a keycap, or symbols with tone, joined to one figure."""
    one = f"[{symbol_ranges()}]{VARIATION}?{TONE}?{VARIATION}?{TAGS}*"
    return f"{FLAG_LETTER}{FLAG_LETTER}|[0-9#*]{VARIATION}?{KEYCAP}|{one}(?:{JOINER}{one})*"


def piece_pattern() -> str:
    """Runs of text that no sequence starts in, symbol sequences, else one character."""
    return f"(?s)[^{BLOCKS}0-9#*]+|{sequence_pattern()}|."


def _symbol_name(char: Column) -> Column:
    """Name of one code point; null for joiners, variation selectors and tags."""
    names, found = emoji_names(), []
    for lo, hi in EMOJI_BLOCKS:
        table = F.split(F.lit(",".join(names.get(cp, "") for cp in range(lo, hi + 1))), ",")
        found.append(F.nullif(F.get(table, F.ascii(char) - lo), F.lit("")))
    return F.coalesce(*found)


def _sequence_name(piece: Column) -> Column:
    chars = F.regexp_extract_all(piece, F.lit("(?s)."), 0)
    letters = F.transform(chars, lambda c: F.char(F.ascii(c) - FLAG_A + ord("a")))
    parts = F.filter(F.transform(chars, _symbol_name), lambda n: n.isNotNull())
    return (F.when(F.rlike(piece, F.lit(f"^{FLAG_LETTER}{FLAG_LETTER}$")), F.concat(F.lit("flag_"), F.array_join(letters, "")))
            .when(F.rlike(piece, F.lit(f"{KEYCAP}$")), F.concat(F.lit("keycap_"), F.left(piece, F.lit(1))))
            .otherwise(F.array_join(parts, "_")))


def emoji_to_text(col, mode: str = "words") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    mark = " " if mode == "tokens" else ":"

    def starts_sequence(piece: Column) -> Column:  # three characters tell
        return F.rlike(F.left(piece, F.lit(3)), F.lit(f"^(?:[{symbol_ranges()}]|[0-9#*]{VARIATION}?{KEYCAP})"))

    def named(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(piece_pattern()), 0)
        return F.array_join(F.transform(pieces, lambda p: F.when(
            starts_sequence(p), F.concat(F.lit(mark), _sequence_name(p), F.lit(mark))).otherwise(p)), "")

    out = once(c, lambda t: F.when(F.rlike(t, F.lit(f"[{BLOCKS}{KEYCAP}]")), named(t)).otherwise(t))
    return out if mode == "tokens" else _unfold_names(out)


def _unfold_names(c: Column) -> Column:
    """Every ``:<non-space run>:`` without its colons, ``_`` and ``-`` as spaces."""
    def unfolded(text: Column) -> Column:
        pieces = F.regexp_extract_all(text, F.lit(f":{NON_WS}+:|[^:]+|:"), 0)
        inside = lambda p: F.replace(F.translate(p, "_-", "  "), F.lit(":"), F.lit(""))
        return F.array_join(F.transform(pieces, lambda p: F.when(F.startswith(p, F.lit(":")) & (F.length(p) > 1), inside(p)).otherwise(p)), "")

    return once(c, lambda t: F.when(F.contains(t, F.lit(":")), unfolded(t)).otherwise(t))
