"""What a question asks for by its wording alone: tests made of word lists, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nouns of a product, verbs of having one, and words of comparing, ranking and belonging.
THINGS = ["product", "sensor", "detector", "device", "analyzer", "unit"]
KINDS = ["product", "device", "unit", "sensor", "detector", "instrument", "system"]
SELLING = ["offer", "have", "sell", "make", "provide", "carry"]
OFFERED = ["available", "offer", "have", "sell", "make"]
RANGES = ["lineup", "line-up", "catalog", "catalogue", "range", "portfolio"]
COMPARING = [r"vs\.?", "versus", "compare", "compared", "compares", "comparison", "difference between", "compared to"]
RANKING = ["better", "best", "worse", "worst"]
OWN = ["our", "ours", "we", "we're", "we are", "us", "the company"]
POINTING = ["this", "these", "it"]
INSTALLS = ["portable", "fixed"]


def one_of(words: list[str], more: str = "") -> str:
    return "(?:" + "|".join(w + more for w in words) + ")"


def row(*parts: str) -> str:
    """A pattern for parts that follow each other as whole words, blanks between them."""
    return r"\b" + r"\s+".join(parts) + r"\b"


def near(first: str, second: str, most: int) -> str:
    """A pattern for two parts, each a whole word, with so many characters of one line between them."""
    return rf"\b{first}\b.{{0,{most}}}\b{second}\b"


_THING = one_of(THINGS, "s?")
#: Patterns over lower-cased text, any of which tells the wording.
WORDINGS: dict[str, list[str]] = {
    # All products of a corpus, for retrieval.
    "list_all": [near("all", _THING, 20), near("list", _THING, 20), row(_THING, one_of(RANGES)), near("what", _THING, 10) + rf".{{0,15}}\b{one_of(OFFERED)}\b"],
    # A deliberate enumeration, for the dispatcher.
    "enumerate": [row("list", "all"), rf"\bshow\s+(?:all\s+)?{one_of(INSTALLS)}?\s*products\b", row("what", "products", "do", "you", one_of(SELLING)), row("what", "products", "does", r"\w+", one_of(SELLING))],
    "which_products": [row(one_of(["which", "what"]), one_of(THINGS, "s"))],
    "ask_about": [row(one_of(["tell me", "know", "information", "info"]), "about")],
    "list_word": [row(one_of(["list", "show"]))],
    # One thing spoken of as if it were known.
    "the_one": [rf"\bthe\s(?:\w+\s+){{0,2}}{one_of([*KINDS, 'analyzer'])}\b"],
    "reference": [row(one_of(POINTING)), rf"\bthe\s(?:\w+\s+){{0,2}}{one_of(KINDS)}\b"],
    "comparison": [row(one_of(COMPARING))[:-2]],
    "superlative": [row(one_of(["most", "least"]), r"\w+"), r"\b\w{4,}est\b", row(one_of(RANKING))],
    "self_reference": [row(one_of(OWN))],
}


def asks(question: Column, wording: str) -> Column:
    """Whether a question has a wording; null has none."""
    return F.coalesce(F.lower(question), F.lit("")).rlike("|".join(f"(?:{p})" for p in WORDINGS[wording]))
