"""Column helpers for texts: cleaning, tokens and the four ways a term may match."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that are no keywords.
STOPWORDS = (
    "a an the is are was were be been being of for in on to with and or but not this that these those it its we our you your "
    "what which who whom how when where why do does did can could will would should may might i me my us if so as at by from"
).split()


def clean(c: Column) -> Column:
    """Any white space as one blank, none outside; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Runs of letters a–z and digits of the lower-cased text, in order."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"([a-z0-9]+)"), F.lit(1))


def keywords(c: Column) -> Column:
    """Tokens of three characters or more that aren't stop words, repeated ones included."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return F.filter(tokens(c), lambda w: (F.length(w) >= 3) & ~F.array_contains(stop, w))


#: No letter, digit or underscore may stand before or behind a term.
_OPEN, _SHUT = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def inflected(term: str) -> str:
    """A pattern for a term as a whole word, with an optional plural ending."""
    return _OPEN + re.escape(term) + "(?:e?s)?" + _SHUT


def any_term(terms: list[str]) -> str:
    """One pattern for any of the terms, plural or not; what stands beside a term is looked at once for all."""
    return _OPEN + "(?:" + "|".join(map(re.escape, terms)) + ")(?:e?s)?" + _SHUT


def contains_any(c: Column, terms: list[str]) -> Column:
    return F.lower(clean(c)).rlike(any_term(terms))


def unnegated(term: str) -> str:
    """As ``inflected``, but not behind ``non-``."""
    return "(?<!non[- ])" + inflected(term)


def whole(term: str) -> str:
    """A pattern for a term with no letter or digit beside it."""
    return rf"(?<![a-zA-Z0-9]){re.escape(term)}(?![a-zA-Z0-9])"


def longest_contained(c: Column, vocabulary: list[str], otherwise: str = "Unknown") -> Column:
    """The longest term that the text contains in any letter case."""
    out = F.lit(otherwise)
    for term in sorted(vocabulary, key=lambda t: (len(t), t)):
        out = F.when(F.contains(F.lower(c), F.lit(term.lower())), F.lit(term)).otherwise(out)
    return out


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.regexp_replace(F.lower(F.trim(c)), "[^a-z0-9]+", "_"), "^_+|_+$", "")
    return F.when(s == "", F.lit("field")).otherwise(s)
