"""String expressions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from reviewmill.fixed import NULL_SPELLINGS, PREVIEW_CHARS, TEXT_LIMIT, WAIT_WORDS

# --- fixed values: the characters Python's str.strip() and \s treat as space --
SPACE_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
# The same set as a character class, for engines without properties.
SPACE_CLASS = (
    r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
# Whitespace other than the plain space. One property test per character: several times faster
# than a class of ranges, and plain spaces, most of the matches, are left alone.
ODD_SPACE = r"(?U)[\s\x1c-\x1f&&[^ ]]"


def collapse_spaces(c: Column) -> Column:
    """Every whitespace run as one plain space."""
    return F.regexp_replace(F.regexp_replace(c, ODD_SPACE, " "), " {2,}", " ")


def null_literals(c: Column, spellings: Iterable[str] = NULL_SPELLINGS) -> Column:
    """Null when the raw cell is one of the spellings of "missing"."""
    return F.when(~c.isin(*spellings), c)


def coerce_str(c: Column) -> Column:
    """Strip whitespace at both ends; blank stays as the empty string.

    ``trim`` with a character set only looks at the two ends, unlike a regular
    expression, which walks the whole text.
    """
    return F.trim(c, F.lit(SPACE_CHARS))


def clean_text(c: Column, fill: str | None = None) -> Column:
    """Strip, then empty to null (or to ``fill``)."""
    cleaned = F.nullif(coerce_str(c), F.lit(""))
    return cleaned if fill is None else F.coalesce(cleaned, F.lit(fill))


def norm_ws(c: Column) -> Column:
    """Collapse whitespace runs to one space and strip."""
    return F.trim(collapse_spaces(c))


def norm_text_dupkey(c: Column) -> Column:
    """Lower case with whitespace runs as one space, ends kept."""
    return collapse_spaces(F.lower(c))


def mentions_any(c: Column, words: Iterable[str] = WAIT_WORDS) -> Column:
    """True if any word occurs as a substring, case-insensitive; null text is false."""
    hit = F.lit(False)
    for word in words:
        hit = hit | F.lower(c).contains(word)
    return F.coalesce(hit, F.lit(False))


def text_length(c: Column) -> Column:
    return F.length(c)


def text_trunc(c: Column, limit: int = TEXT_LIMIT) -> Column:
    return F.substring(c, 1, limit)


def preview_text(c: Column) -> Column:
    return F.substring(c, 1, PREVIEW_CHARS)


def fmt_pct(fraction: Column) -> Column:
    """0.123 to '12.3%'. Display only: reports keep the fraction beside it."""
    return F.format_string("%.1f%%", F.bround(fraction * 100, 1))


def null_key_label(c: Column) -> Column:
    """Label of a group key. Apply after grouping, so that null stays one group."""
    return F.coalesce(c.cast("string"), F.lit("NA"))
