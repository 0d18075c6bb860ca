"""Text expressions.

All regexes run JVM-side.  Java's ``\\s`` is ASCII-only, Python's is not, so
the whitespace class is spelled out once (``WS``) and used everywhere; the
same class works unchanged in RE2, which keeps the SQL oracle honest.

Fixed values (must equal the reference's behaviour):
* whitespace = the characters for which Python's ``str.isspace`` is true:
  tab, LF, VT, FF, CR, U+001C..U+001F, space, U+0085, U+00A0, U+1680,
  U+2000..U+200A, U+2028, U+2029, U+202F, U+205F, U+3000
* word tokens = runs of letters/digits, or one other non-space character
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str

WS = (r"\t\n\x{0B}\f\r\x{1C}-\x{1F} \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}"
      r"\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}")
TOKEN_PATTERN = r"[\p{L}\p{N}]+|[^" + WS + r"\p{L}\p{N}]"
# Java looks letters listed one by one up in a table, but tries ranges in turn, so
# most characters of a text cost one look-up here
_KEPT = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
DROPPED = "[[^" + _KEPT + " ]&&[^" + WS + "]]+"
# what is left beside letters and digits is whitespace: runs of it but a single space, which stays as it is
WS_RUN = "[^" + _KEPT + "](?:(?<! )|[^" + _KEPT + "])[^" + _KEPT + "]*"
NGRAM_SEP = " "   # tokens never contain whitespace, so the join is unambiguous


def _c(x: ColumnOrName) -> Column:
    return F.col(x) if isinstance(x, str) else x


def clean_text(text: ColumnOrName) -> Column:
    """P5: lower-case, drop everything outside [a-zA-Z0-9] and whitespace,
    collapse whitespace runs to one space, strip."""
    t = F.lower(_c(text))
    t = F.regexp_replace(t, F.lit(DROPPED), F.lit(""))
    t = F.regexp_replace(t, F.lit(WS_RUN), F.lit(" "))
    # every whitespace run is now one space, so trimming spaces is exact
    return F.trim(t)


def strip_text(text: ColumnOrName) -> Column:
    """Strip Unicode whitespace at both ends (``trim`` strips spaces only)."""
    return F.regexp_replace(_c(text), F.lit("^[" + WS + "]+|[" + WS + "]+$"), F.lit(""))


def null_safe_concat(a: ColumnOrName, b: ColumnOrName, sep: str = " ") -> Column:
    """``fillna('')`` on both sides, then join with one space; the space
    stays when a side is null (``concat_ws`` would drop it)."""
    return F.concat(F.coalesce(_c(a), F.lit("")), F.lit(sep), F.coalesce(_c(b), F.lit("")))


def tokenize(text: ColumnOrName) -> Column:
    """P25: case-sensitive word tokens with punctuation kept as tokens.

    Not the Treebank tokenizer (a per-row library); documented re-aim."""
    return F.regexp_extract_all(F.coalesce(_c(text), F.lit("")), F.lit(TOKEN_PATTERN), 0)


def token_count(text: ColumnOrName) -> Column:
    """Number of word tokens."""
    return F.size(tokenize(text))


def ngrams(tokens: ColumnOrName, n: int) -> Column:
    """Ordered n-grams joined by a space; empty when fewer than n tokens.

    Built from n shifted slices zipped together, never from a lambda over
    positions: a lambda would re-run the tokenizer once per position after
    Catalyst inlines it."""
    t = _c(tokens)
    length = F.greatest(F.size(t) - F.lit(n - 1), F.lit(0))
    if n == 1:
        return t
    parts = [F.slice(t, i + 1, length) for i in range(n)]
    zipped = F.arrays_zip(*[p.alias(f"t{i}") for i, p in enumerate(parts)])
    return F.transform(zipped, lambda s: F.concat_ws(NGRAM_SEP, *[s[f"t{i}"] for i in range(n)]))
