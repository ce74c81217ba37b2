"""Splitting of fields that hold several values with unequal separators, numbering and quoting.

Known whole values are found in one pass of a multi-pattern automaton. Where found values overlap, dynamic
programming picks the cover that protects most characters with fewest values. Separators inside the
cover, or inside quotes, do not separate; all others do.
"""

from __future__ import annotations

import json
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What users write where there is no value.
PLACEHOLDERS = frozenset(
    "- -- --- – — ? ?? ??? . / x xx n/a n.a. n.a na n/k nil none null nothing unknown tbd t.b.d. tbc t.b.c. todo pending open any undefined undecided unspecified "
    "keine kein unbekannt aucun aucune inconnu ninguno ninguna desconocido".split()
) | {"not known", "not specified", "not applicable", "not available", "to be defined", "to be confirmed", "to be decided", "to be discussed", "no value", "(none)", "(blank)", "no preference", "see below", "see above", "as before", "not sure", "don't know"}
BULLET = r"(?:[\-*•·–—▪◦‣]\s+|[•·▪◦‣]|\(?\d{1,3}[.)]\s+)"
SEPARATOR = re.compile(r"[\n\r\t;|,/+&•·]|(?<!\S)(?:and|und|et|y)(?!\S)")
NUMBER = re.compile(r"(?:^|(?<=\s))\(?\d{1,3}[.)]\s+")
QUOTES = {'"': '"', "'": "'", "“": "”", "„": "“", "‘": "’", "«": "»"}
BLANK = " \xa0"
#: Characters of the longest mark that may stand beside a value, such as ``(123)`` after a blank, and some more.
MARK = 8
EDGE = " \t\r\n\f\v\xa0  　"


def is_placeholder(text: str) -> bool:
    return text.strip(EDGE + "\"'").lower() in PLACEHOLDERS or not text.strip(EDGE + "\"'.,;|/+&-*•")


#: Quotes that may open, and those behind which, blanks aside, the text ends or parts.
_OPENING = re.compile("[" + "".join(QUOTES) + "]")
_CLOSING = re.compile(rf"[{''.join(dict.fromkeys(QUOTES.values()))}](?=[{BLANK}]*+(?:$|\Z|[\n\r\t;|,/+&•·]|(?:and|und|et|y)(?!\S)|\(?\d{{1,3}}[.)]\s))")


def _left(text: str, at: int, skip: str) -> int:
    """The place behind the nearest character left of ``at`` that is none of ``skip``."""
    while at and text[at - 1] in skip:
        at -= 1
    return at


def _right(text: str, at: int, skip: str) -> int:
    while at < len(text) and text[at] in skip:
        at += 1
    return at


class Splitter:
    """Splits one text after another by a list of known values; case does not matter."""

    def __init__(self, known: list[str]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for v in known:
            v = v.strip().lower()
            # Others have nothing in them that could part them.
            if v and (SEPARATOR.search(v) or NUMBER.search(v)):
                self.automaton.add_word(v, len(v))
        self.any = len(self.automaton) > 0
        if self.any:
            self.automaton.make_automaton()
        self.split = lru_cache(100_000)(self._split)

    def _cover(self, low: str) -> list[tuple[int, int]]:
        """Spans of known whole values that protect most characters, with fewest values at a tie."""
        spans = []
        for end, size in self.automaton.iter(low) if self.any else ():
            s, e = end + 1 - size, end + 1
            b, a = _left(low, s, " \"'“„‘«"), _right(low, e, " \"'”“’»")
            before, after = low[max(0, b - MARK) : b], low[a : a + MARK]
            opened = not before or SEPARATOR.match(before[-1]) or re.search(r"(?:^|\s)(?:and|und|et|y|[\-*•·–—]|\(?\d{1,3}[.)])$|\[$", before)
            closed = not after or SEPARATOR.match(after) or after[0] in "]" or re.match(r"\(?\d{1,3}[.)]\s", after)
            if opened and closed:
                spans.append((s, e))
        # Best cover up to each end, with the cover it continues; covers of later ends are never worse than those before.
        ends, best, link = [0], [(0, 0)], [(-1, -1)]
        for s, e in sorted(spans, key=lambda x: (x[1], x[0])):
            at = bisect_right(ends, s) - 1
            new = (best[at][0] + e - s, best[at][1] - 1)
            if new > best[-1]:
                if ends[-1] == e:
                    best[-1], link[-1] = new, (at, s)
                else:
                    ends.append(e)
                    best.append(new)
                    link.append((at, s))
        chosen, k = [], len(ends) - 1
        while k > 0:
            at, s = link[k]
            chosen.append((s, ends[k]))
            k = at
        return chosen[::-1]

    def _quoted(self, text: str) -> list[tuple[int, int]]:
        """Spans of quotes that open where an item may start and close where one may end.

        The places where each quote may close are found in one pass, so that many quotes cost no more than their number.
        """
        closing: dict[str, list[int]] = {}
        for m in _CLOSING.finditer(text):
            closing.setdefault(m[0], []).append(m.start())
        spans, at = [], 0
        for m in _OPENING.finditer(text) if closing else ():
            if m.start() < at:
                continue
            b = _left(text, m.start(), BLANK)
            before = text[max(0, b - MARK) : b]
            if not before or SEPARATOR.match(before[-1]) or re.search(r"(?:\s|^)(?:and|und|et|y|[\-*–—]|\(?\d{1,3}[.)])$", before):
                ends = closing.get(QUOTES[m[0]], [])
                k = bisect_right(ends, m.start())
                if k < len(ends):
                    spans.append((m.start(), ends[k] + 1))
                    at = ends[k] + 1
        return spans

    def _split(self, text: str) -> tuple[str, ...]:
        body = text.strip(EDGE)
        if is_placeholder(body):
            return ()
        if body[0] == "[" and body[-1] == "]":
            try:
                values = json.loads(body)
                return tuple(v for x in values if x is not None and (v := _clean(x if isinstance(x, str) else json.dumps(x))) and not is_placeholder(v))
            except (ValueError, RecursionError):
                body = body[1:-1]
        low = body.lower() if len(body.lower()) == len(body) else body
        kept = bytearray(len(body))
        for s, e in [*self._quoted(body), *self._cover(low)]:
            kept[s:e] = b"\1" * (e - s)
        cuts = [(m.start(), m.end()) for m in SEPARATOR.finditer(body) if not any(kept[m.start() : m.end()])]
        if re.match(r"\(?1[.)]\s", body):
            cuts += [(m.start(), m.end()) for m in NUMBER.finditer(body) if not any(kept[m.start() : m.end()])]
        items, at = [], 0
        for s, e in [*sorted(cuts), (len(body), len(body))]:
            if s >= at and (item := _clean(body[at:s])) and not is_placeholder(item):
                items.append(item)
            at = max(at, e)
        return tuple(items)


def _clean(item: str) -> str:
    """The item without outer blanks, numbering, bullets and a pair of quotes."""
    item = (item if item.isascii() else item.encode("utf-8", "replace").decode()).strip(EDGE)
    while m := re.match(BULLET, item):
        item = item[m.end() :].lstrip(EDGE)
    if len(item) > 1 and QUOTES.get(item[0]) == item[-1]:
        item = item[1:-1].strip(EDGE)
    return item.strip(EDGE)


def split_packed(rows: DataFrame, id_col: str, fields: list[str], known: dict[str, list[str]], key_name: str = "req_id") -> DataFrame:
    """``(key_name, field_name, pos bigint, item)``: one row per value of each field, in stored order.

    ``known`` has the values of each field that a separator must not part, in any letter case. Null, blank
    and placeholder texts give no row, empty places between separators none and no position; repeated values
    and repeated rows come out as often as written. Further columns are not read. No shuffle: a scan of
    the fields and one Arrow stage, in which each distinct text of a worker is split once.
    """
    src = rows.select(F.col(id_col).alias(key_name), *fields)
    kind = T.StructType([src.schema[key_name]]).add("field_name", "string").add("pos", "long").add("item", "string")
    names = kind.names
    lists = {f: tuple(known.get(f, ())) for f in fields}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, f in enumerate(fields):
                split = splitter(lists[f]).split
                found = [split(t) if t else () for t in batch.column(k + 1).to_pylist()]
                values = pa.array(found, pa.list_(pa.string()))
                parent = pc.list_parent_indices(values)
                pos = [p for v in found for p in range(1, len(v) + 1)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(parent), pa.array([f] * len(pos), pa.string()), pa.array(pos, pa.int64()), values.flatten()], names)

    return src.mapInArrow(run, kind)


@lru_cache(16)
def splitter(known: tuple[str, ...]) -> Splitter:
    return Splitter(list(known))
