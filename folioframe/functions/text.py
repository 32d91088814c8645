"""Text column expressions. Everything here stays inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANK = r"[ \n\t\r]+"
# Unicode words; the second form keeps inner hyphens, the third also apostrophes.
WORD = r"[\p{L}\p{N}_]+"
HYPHEN_WORD = r"[\p{L}\p{N}_]+(?:-+[\p{L}\p{N}_]+)*"
APOSTROPHE_WORD = r"[\p{L}\p{N}_]+(?:['-]+[\p{L}\p{N}_]+)*"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row.

    A column that only lambdas refer to would be inlined by the optimizer and computed again
    for every array element; a lambda variable is not.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Blank-separated words, empty ones removed."""
    return F.array_remove(F.split(text, BLANK), "")


def tokens(text: Column) -> Column:
    """Lower-case blank-separated words: the index vocabulary."""
    return words(F.lower(text))


def squeeze(text: Column) -> Column:
    """Runs of blanks become one space, ends trimmed."""
    return F.trim(F.regexp_replace(text, BLANK, " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(squeeze(text), F.lit(""))


def matches(text: Column, pattern: str, group: int = 0) -> Column:
    """All matches of a fixed pattern as an array."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def term_set(text: Column, stop: list[str], min_length: int = 3, joined: str = HYPHEN_WORD) -> Column:
    """Distinct lower-case ASCII terms in order of first use, without stop words."""
    found = matches(F.lower(text), joined)
    ascii_term = r"^[a-z0-9][a-z0-9_-]{%d,}$" % (min_length - 1)
    return F.array_distinct(
        F.filter(found, lambda t: t.rlike(ascii_term) & ~t.isin(*stop))
    )


def word_set(text: Column) -> Column:
    """Distinct lower-case unicode words longer than one character."""
    return F.array_distinct(
        F.filter(matches(F.lower(text), APOSTROPHE_WORD), lambda t: F.length(t) > 1)
    )


def sentences(text: Column, boundary: str = r"(?<=[.!?])[ \n\t\r]+") -> Column:
    """Sentences after ``.``, ``!`` or ``?`` and a blank; trimmed, blank ones dropped."""
    parts = F.transform(F.split(text, boundary), lambda s: F.regexp_replace(s, r"^[ \n\t\r]+|[ \n\t\r]+$", ""))
    return F.array_remove(parts, "")


def tokens_by_words(text: Column) -> Column:
    """Token estimate: 1.3 per blank-separated word, at least one for non-blank text."""
    n = F.size(words(text))
    return F.when(n == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(n * F.lit(1.3)))).cast("int")


def tokens_by_matches(text: Column) -> Column:
    """Token estimate: word matches over 0.75, rounded up; empty text counts zero."""
    n = F.regexp_count(text, F.lit(WORD))
    return (
        F.when(F.length(text) == 0, F.lit(0))
        .otherwise(F.greatest(F.lit(1), F.ceil(n / F.lit(0.75))))
        .cast("int")
    )


def has_term(text: Column, term: Column) -> Column:
    """``term`` occurs in lower-case ``text`` and touches no other ASCII letter or digit."""
    escaped = F.regexp_replace(term, r"([.+*?^$(){}|\[\]\\])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit("(^|[^a-z0-9])"), escaped, F.lit("($|[^a-z0-9])")))
