"""Text column expressions.

Everything is a JVM regex / string function; no Python UDF is involved.
Character classes are spelled out (``\\p{L}``, ``\\p{N}``) so the same pattern
means the same thing in Java regex and in RE2 (used by the SQL oracle).
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bilingual category labels separate the languages with this token.
CATEGORY_SEPARATOR = " / "

# A "word" character is a letter, a digit or underscore (Unicode aware);
# whitespace includes Unicode separators.
_WS = r"\p{Z}\t\n\x0B\f\r"
URL_PATTERN = r"http\S+"
NON_WORD_PATTERN = r"[^\p{L}\p{N}_" + _WS + r"]"
WS_RUN_PATTERN = r"[" + _WS + r"]+"
# Punctuation and whitespace in one pass: what the two patterns above leave between words.
# (The ASCII letters are in \p{L}: listed first, they are told without the Unicode tables.)
BETWEEN_WORDS_PATTERN = r"[^a-zA-Z0-9_\p{L}\p{N}]+"


def shorten_category(c: Column) -> Column:
    """The text before the first separator, trimmed; null passes through."""
    return F.trim(F.split_part(c, F.lit(CATEGORY_SEPARATOR), F.lit(1)))


def normalise_text(c: Column, strip_urls: bool = True) -> Column:
    """Lower, strip URLs, punctuation -> space, collapse whitespace, trim."""
    return F.trim(F.regexp_replace(word_text(c, strip_urls), BETWEEN_WORDS_PATTERN, " "))


def _accent_table() -> tuple[str, str]:
    """Map each Latin-1 / Latin Extended-A letter whose compatibility decomposition
    is one ASCII letter plus combining marks onto that letter (rule-built)."""
    src, dst = [], []
    for cp in range(0x00C0, 0x0180):
        ch = chr(cp)
        base = "".join(x for x in unicodedata.normalize("NFKD", ch) if not unicodedata.combining(x))
        if len(base) == 1 and base != ch and base.isascii():
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


ACCENT_SRC, ACCENT_DST = _accent_table()


def strip_accents(c: Column) -> Column:
    """Accent stripping over the Latin range (1:1 letters only)."""
    return F.translate(c, ACCENT_SRC, ACCENT_DST)


TOKEN_PATTERN = r"[a-zA-Z0-9_\p{L}\p{N}]{2,}"


def word_text(c: Column, strip_urls: bool = True) -> Column:
    """Text whose ``tokens`` are those of ``normalise_text``: punctuation still stands between them."""
    return F.regexp_replace(F.lower(c), URL_PATTERN, " ") if strip_urls else F.lower(c)


def tokens(c: Column) -> Column:
    """Words of at least two characters from normalised text or ``word_text``, by one regex."""
    return F.regexp_extract_all(c, F.lit(TOKEN_PATTERN), F.lit(0))


def bigrams(words: Column) -> Column:
    """Neighbouring word pairs of a token array, joined by a space."""
    pairs = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    return F.when(F.size(words) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def format_terms(terms: Column, term_field: str = "term", weight_field: str = "weight") -> Column:
    """array<struct<term, weight>> -> "term(1.234) | term2(0.500)"."""
    return F.array_join(
        F.transform(terms, lambda t: F.format_string("%s(%.3f)", t[term_field], t[weight_field])),
        " | ",
    )


def parse_terms(c: Column) -> Column:
    """S23: "term(1.234) | ..." -> array<struct<term string, weight double>>."""
    parts = F.split(c, r"\s*\|\s*")
    return F.transform(
        F.filter(parts, lambda p: p.rlike(r"^.+\([-0-9.eE]+\)$")),
        lambda p: F.struct(
            F.regexp_extract(p, r"^(.*)\(([-0-9.eE]+)\)$", 1).alias("term"),
            F.regexp_extract(p, r"^(.*)\(([-0-9.eE]+)\)$", 2).cast("double").alias("weight"),
        ),
    )


def strip_parenthesised_suffix(c: Column) -> Column:
    """S25: "Damped Add (AIC)" -> "Damped Add"."""
    return F.trim(F.regexp_replace(c, r"\s*\([^)]*\)\s*$", ""))
