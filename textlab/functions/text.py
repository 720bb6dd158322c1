"""Text cleaners as Column expressions (JVM-side, codegen, stream-safe).

Python's ``\\w``, ``\\s`` and ``\\d`` are Unicode-aware while Java's are ASCII
by default, so the classes are spelled out. The same pattern strings are
accepted by Java regex and by RE2 (the DuckDB oracle), only the replacement
group syntax differs (``$1`` here).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes matching Python's Unicode \w, \s, \S, \d.
WORD = r"[\p{L}\p{N}_]"
NON_WORD = r"[^\p{L}\p{N}_]"
WS_CHARS = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS = f"[{WS_CHARS}]"
NON_WS = f"[^{WS_CHARS}]"
DIGIT = r"\p{Nd}"

# The cleaning patterns (strict order matters).
URL_PATTERN = f"http{NON_WS}+|www\\.{NON_WS}+"
MENTION_PATTERN = f"@{WORD}+"
EMAIL_PATTERN = f"{NON_WS}+@{NON_WS}+"
HASHTAG_PATTERN = f"#({WORD}+)"
WS_RUN = f"{WS}+"
# Looser url form of the generic cleaner (no dot after www).
URL_LOOSE_PATTERN = f"http{NON_WS}+|www{NON_WS}+"
NON_ASCII_RUN = r"[^\x{00}-\x{7f}]+"

# Replacement tokens.
URL_TOKEN = "<url>"
USER_TOKEN = "<user>"
EMAIL_TOKEN = "<email>"


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def once(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def _guarded(c: Column, needle: str, pattern: str, repl: str) -> Column:
    """Run the regex only on values holding its literal trigger (same result,
    avoids backtracking scans of texts that cannot match)."""
    return F.when(F.contains(c, F.lit(needle)), F.regexp_replace(c, pattern, repl)).otherwise(c)


def normalize_url(col) -> Column:
    c = _c(col)
    hit = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www"))
    return F.when(hit, F.regexp_replace(c, URL_PATTERN, URL_TOKEN)).otherwise(c)


def normalize_mention(col) -> Column:
    return _guarded(_c(col), "@", MENTION_PATTERN, USER_TOKEN)


def normalize_email(col) -> Column:
    return _guarded(_c(col), "@", EMAIL_PATTERN, EMAIL_TOKEN)


def unpack_hashtag(col) -> Column:
    return _guarded(_c(col), "#", HASHTAG_PATTERN, "$1")


def expand_ampersand(col) -> Column:
    """``&amp;`` first, then every remaining ``&``, both to `` and ``."""
    c = F.replace(_c(col), F.lit("&amp;"), F.lit(" and "))
    return F.replace(c, F.lit("&"), F.lit(" and "))


def collapse_whitespace(col) -> Column:
    """Unicode whitespace runs to one space, then strip."""
    return F.trim(F.regexp_replace(_c(col), WS_RUN, " "))


# The characters Python's str.strip() removes (every one lies below U+3001).
STRIP_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


def unicode_strip(col) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace. A
    character-set trim scans only the two ends, not the whole text."""
    return F.btrim(_c(col), F.lit(STRIP_CHARS))


def clean_text(col) -> Column:
    """url -> mention -> email -> hashtag -> ampersand -> whitespace; null -> ''."""
    c = F.coalesce(_c(col), F.lit(""))
    c = normalize_url(c)
    c = normalize_mention(c)
    c = normalize_email(c)
    c = unpack_hashtag(c)
    c = expand_ampersand(c)
    return collapse_whitespace(c)


def simple_preprocess(col) -> Column:
    """Ampersands to `` and ``, newlines to space, whitespace collapsed, stripped."""
    c = F.coalesce(_c(col), F.lit(""))
    c = expand_ampersand(c)
    c = F.regexp_replace(c, r"[\r\n]+", " ")
    return collapse_whitespace(c)


def generic_preprocess(col, emoji_col: Column | None = None) -> Column:
    """Links and mentions removed, hashtag word kept, entities decoded,
    whitespace collapsed *before* non-ASCII runs become spaces, stripped.

    ``emoji_col``: optionally the text already passed through an emoji-to-name
    step (see ``textlab.functions.emoji``); by default the step is off.
    """
    if emoji_col is not None:
        return once(emoji_col, lambda t: generic_preprocess(t))
    c = _c(col)
    hit = F.contains(c, F.lit("http")) | F.contains(c, F.lit("www"))
    c = F.when(hit, F.regexp_replace(c, URL_LOOSE_PATTERN, " ")).otherwise(c)
    c = _guarded(c, "@", MENTION_PATTERN, " ")
    c = _guarded(c, "#", HASHTAG_PATTERN, "$1")
    c = F.replace(c, F.lit("&amp;"), F.lit("and"))
    c = F.replace(c, F.lit("&lt;"), F.lit("<"))
    c = F.replace(c, F.lit("&gt;"), F.lit(">"))
    c = F.regexp_replace(c, WS_RUN, " ")
    c = F.regexp_replace(c, NON_ASCII_RUN, " ")
    return unicode_strip(c)


# The social token grammar: at each place the first kind that fits is the token, so longer kinds come first.
# Kinds that end in a letter or digit end only where no further ASCII letter, digit or underscore follows.
SOCIAL_GRAMMAR = [
    ("tag", r"<url>|<user>|<email>"),
    ("emoticon", r"[:;=][-o^']?[)(\]\[|/\\*}{@$]+|[:;][-^']?[DPpOo3]+(?![A-Za-z0-9_])|</?3+(?![A-Za-z0-9_])|\^[_.-]?\^|[oO][_.][oO](?![A-Za-z0-9_])|T_T(?![A-Za-z0-9_])|-[_.]+-|[xX]D+(?![A-Za-z0-9_])"),
    ("date", r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}(?![A-Za-z0-9_])|[0-9]{1,2}[-/.][0-9]{1,2}[-/.](?:[0-9]{4}|[0-9]{2})(?![A-Za-z0-9_])"),
    ("time", r"[0-9]{1,2}:[0-5][0-9](?::[0-5][0-9])?(?:[aApP][mM])?(?![A-Za-z0-9_])"),
    ("phone", r"\+[0-9][0-9().-]{6,}[0-9](?![A-Za-z0-9_])|\([0-9]{2,3}\)[0-9]{3,5}-[0-9]{4}(?![A-Za-z0-9_])|[0-9]{3}-[0-9]{3}-[0-9]{4}(?![A-Za-z0-9_])"),
    ("money", r"[$€£¥][0-9]+(?:[.,][0-9]+)*(?:[kKmMbB](?![A-Za-z0-9_]))?|[0-9]+(?:[.,][0-9]+)*[$€£¥]"),
    ("percent", r"[0-9]+(?:[.,][0-9]+)*%"),
    ("number", r"[0-9]+(?:[.,][0-9]+)+(?![A-Za-z0-9_])"),
    ("acronym", r"(?:\p{Lu}\.){2,}(?:\p{Lu}(?![A-Za-z0-9_]))?"),
    ("censored", r"\p{L}+\*+\p{L}+(?:\*+\p{L}*)*|\p{L}+\*{2,}"),
    ("word", f"(?:{WORD}|')+"),
    ("symbol", NON_WS),
]
SOCIAL_TOKEN = "|".join(pattern for _, pattern in SOCIAL_GRAMMAR)


def social_token_kind(token) -> Column:
    """The kind of a social token (the first of the grammar that it fits as a whole)."""
    kind = F.lit(None).cast("string")
    for name, pattern in reversed(SOCIAL_GRAMMAR):
        kind = F.when(_c(token).rlike(f"^(?:{pattern})$"), name).otherwise(kind)
    return kind


def social_tags(col) -> Column:
    """Addresses, names and e-mails to tags; null -> ''."""
    return normalize_email(normalize_mention(normalize_url(F.coalesce(_c(col), F.lit("")))))


def social_tokens(col) -> Column:
    """Social tokens joined by one space, case kept."""
    return F.array_join(F.regexp_extract_all(_c(col), F.lit(SOCIAL_TOKEN), 0), " ")


def social_normalize(col) -> Column:
    """Url/user/email to tags, hashtags unpacked to their word, tokens joined by one space
    (``operators.hashtags.social_clean`` segments the hashtags as well)."""
    return social_tokens(unpack_hashtag(social_tags(col)))


# Typographic quotes mapped to ASCII.
CURLY_QUOTES_FROM = "‘’“”"
CURLY_QUOTES_TO = "''\"\""


def ascii_text(col) -> Column:
    """``&amp;``/``&`` to ``and``, curly quotes straightened, non-ASCII runs to a
    space, space runs collapsed; null -> ''."""
    c = F.coalesce(_c(col), F.lit(""))
    c = F.replace(c, F.lit("&amp;"), F.lit("and"))
    c = F.replace(c, F.lit("&"), F.lit("and"))
    c = F.translate(c, CURLY_QUOTES_FROM, CURLY_QUOTES_TO)
    c = F.regexp_replace(c, NON_ASCII_RUN, " ")
    return F.regexp_replace(c, " +", " ")


def baseline_preprocess(col, emoji_col: Column | None = None) -> Column:
    """``ascii_text``, then social normalisation with hashtags unpacked to their word
    (``operators.hashtags.baseline_clean`` is the whole chain, emoji and segmentation included)."""
    return once(ascii_text(col if emoji_col is None else emoji_col), social_normalize)


def whitespace_tokens(col) -> Column:
    """Whitespace tokens of the stripped text (empty text -> no tokens)."""
    s = unicode_strip(F.coalesce(_c(col), F.lit("")))
    return F.when(s == "", F.array().cast("array<string>")).otherwise(F.split(s, WS_RUN))


def token_count(col) -> Column:
    return F.size(whitespace_tokens(col))


def verbalize_label(col) -> Column:
    """1 -> ``Yes``, anything else -> ``No``."""
    return F.when(_c(col) == 1, F.lit("Yes")).otherwise(F.lit("No"))


# Metric display renames, applied in this order after title-casing.
DISPLAY_RENAMES = [("Macro F1", "Macro-F1"), ("Macro Ap", "Macro-AP"), ("Roc Auc", "ROC-AUC"),
                   ("Ece", "ECE ↓"), ("F1 ", "F1-"), ("Precision ", "Prec-"), ("Recall ", "Rec-")]


def title_case(col) -> Column:
    """A capital at the start of every run of letters, lower case after it."""
    runs = F.regexp_extract_all(_c(col), F.lit(r"\p{L}+|[^\p{L}]+"), 0)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substr(r, F.lit(2))))), "")


def metric_display_name(col) -> Column:
    """``_`` to space, title case, then the fixed renames."""
    c = title_case(F.replace(_c(col), F.lit("_"), F.lit(" ")))
    for a, b in DISPLAY_RENAMES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def diff_format(col) -> Column:
    """Signed 4-decimal difference (Python rounding of the binary value)."""
    from .formats import py_format
    return py_format(col, 4, None, signed=True)
