"""Cutting of texts over a size limit at natural boundaries, with an overlap of whole words.

Every place where a piece may end is a boundary with a strength: 3 after a blank line, 2 after a sentence or a
line, 1 beside white space, 0 inside an unbroken run so long that it may have to be cut. The successor of a
boundary is the farthest one that is legal for the piece that starts behind it (its overlap words included):
the farthest of strength 2 or more that is in reach, else the farthest of strength 1, else the farthest.
Greedy cuts are the boundaries on the chain of successors from the start of the text. The chain is not walked:
the set of boundaries reached is doubled with the table of successors and the table is squared, so that all cuts
of all texts of an Arrow batch come out of log2(longest chain) array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Marks that end a sentence (the second group needs no space after it), and closing marks that may follow.
SENTENCE_ENDS = ".!?…"
FULL_WIDTH_ENDS = "。！？｡।॥"
CLOSERS = "\"')]}»”’」』）"
SPACES = " \t\n\r\v\f\x1c\x1d\x1e\x1f\x85\xa0                　"
LINE_ENDS = "\n\r\x85  "


def _codes(chars: str) -> np.ndarray:
    return np.array([ord(c) for c in chars], np.uint32)


def cut_batch(texts: list[str], size: int, overlap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pieces of all texts as ``(text no., start, end)`` in code points; a text within the limit is one piece, an empty one none."""
    data = [np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    lengths = np.array([len(d) for d in data], np.int64)
    base = np.concatenate([[0], np.cumsum(lengths)])
    chars = np.concatenate(data) if data else np.empty(0, np.uint32)
    total = len(chars)
    if not total:
        return (np.empty(0, np.int64),) * 3
    space, line = np.isin(chars, _codes(SPACES)), np.isin(chars, _codes(LINE_ENDS))
    first = np.zeros(total + 1, bool)
    first[base] = True
    # Strength of the place before character i, 0 to total.
    strength = np.full(total + 1, -1, np.int8)
    before, after = np.zeros(total + 1, bool), np.zeros(total + 1, bool)
    before[1:], after[:-1] = space, space
    strength[before | after] = 1
    closing = np.isin(chars, _codes(CLOSERS))
    ender = np.isin(chars, _codes(SENTENCE_ENDS))
    ended = ender.copy()
    for _ in range(3):  # closing marks behind the end belong to the sentence
        ended[1:] |= closing[1:] & ended[:-1]
    wide = np.isin(chars, _codes(FULL_WIDTH_ENDS))
    wide[1:] |= closing[1:] & wide[:-1]
    strong = np.zeros(total + 1, bool)
    strong[1:] = ended
    strong &= after
    strong[1:] |= wide
    strong[1:] |= line
    strength[strong] = 2
    blank = np.zeros(total + 1, bool)
    blank[2:] = line[1:] & line[:-1] & ~((chars[1:] == 10) & (chars[:-1] == 13))
    strength[blank] = 3
    # Long unbroken runs may be cut anywhere.
    word_start = np.flatnonzero(~space & (before[:-1] | first[:-1]))
    word_end = np.flatnonzero(~space & (after[1:] | first[1:])) + 1
    half = size // 2
    for s, e in zip(*(x[word_end - word_start >= size - half] for x in (word_start, word_end)), strict=True):
        inner = strength[s + 1 : e]
        inner[inner < 0] = 0
    strength[base] = 3
    place = np.flatnonzero(strength >= 0)
    level = strength[place]
    n = len(place)
    owner = np.searchsorted(base, place, "right") - 1  # the text that starts at or before the place
    limit_of = base[np.minimum(owner + 1, len(texts))]
    # Start of the piece behind each boundary: the last `overlap` whole words before it, as far as they fit into half a piece.
    words_before = np.searchsorted(word_end, place, "right")
    first_word = np.searchsorted(word_start, base[owner])
    fits = np.searchsorted(word_start, place - half)
    begin_at = np.maximum.reduce([words_before - overlap, first_word, fits])
    begin = np.where(begin_at < words_before, word_start[np.minimum(begin_at, len(word_start) - 1)] if len(word_start) else place, place)
    begin = np.where(np.isin(place, base), place, begin)
    reach = np.minimum(begin + size, limit_of)
    far = np.searchsorted(place, reach, "right") - 1
    index = np.arange(n)
    strong_at = np.maximum.accumulate(np.where(level >= 2, index, -1))[far]
    word_at = np.maximum.accumulate(np.where(level >= 1, index, -1))[far]
    successor = np.where(strong_at > index, strong_at, np.where(word_at > index, word_at, far))
    # The start of a text and the end of the one before share a place, so chains run on through all texts; empty ones add none.
    successor = np.maximum(successor, np.minimum(index + 1, n - 1))
    reached = np.zeros(n, bool)
    reached[np.searchsorted(place, base)] = True
    table = successor
    while not reached[successor[reached]].all():
        reached[table[reached]] = True
        table = table[table]
    cut = np.flatnonzero(reached)
    start, end = cut[:-1], cut[1:]
    return owner[start], begin[start] - base[owner[start]], place[end] - base[owner[start]]


def split_texts(
    rows: DataFrame, id_col: str = "row_id", text_col: str = "text", heading_col: str | None = "section_heading",
    size: int = 1200, overlap: int = 10, with_text: bool = True,
) -> DataFrame:
    """Pieces of the texts longer than ``size`` code points; shorter texts are no case of the operator.

    Returns ``(id_col, chunk_index int, start_char bigint, end_char bigint[, heading_col, text])``; ``chunk_index``
    counts the pieces of a text anew from 0. No piece is longer than ``size``; each begins with the last ``overlap``
    words of the piece before (fewer where they would fill more than half a piece). Pieces end after blank lines,
    sentences or lines, else between words, else anywhere, and cover the text without a gap. Null, blank or short texts
    give no row, repeated rows each their own pieces; a null heading stays null. No shuffle: the length is
    tested in the scan, only long texts pass to Python.
    """
    keep = [heading_col] if heading_col and with_text else []
    src = rows.select(id_col, *keep, text_col).filter(F.length(text_col) > size)
    kind = [src.schema[id_col], T.StructField("chunk_index", T.IntegerType()), T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType()), *(src.schema[k] for k in keep)]
    if with_text:
        kind.append(T.StructField(text_col, T.StringType()))
    names = [k.name for k in kind]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            at = 0
            while at < whole.num_rows:
                # Some millions of characters at a time, whatever their number of texts.
                texts, weight = [], 0
                for t in whole.column(whole.num_columns - 1).slice(at):
                    texts.append(t.as_py())
                    weight += len(texts[-1])
                    if weight > 1_000_000:
                        break
                part = whole.slice(at, len(texts))
                at += len(texts)
                owner, start, end = cut_batch(texts, size, overlap)
                opening = np.r_[True, owner[1:] != owner[:-1]]
                number = np.arange(len(owner)) - np.maximum.accumulate(np.where(opening, np.arange(len(owner)), 0))
                take = pa.array(owner)
                out = [part.column(0).take(take), pa.array(number, pa.int32()), pa.array(start), pa.array(end)]
                out += [part.column(1).take(take) for _ in keep]
                if with_text:
                    out.append(pa.array([texts[o][s:e] for o, s, e in zip(owner, start, end, strict=True)], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names)

    return src.mapInArrow(run, T.StructType(kind))


def oversized_ids(rows: DataFrame, id_col: str = "row_id", text_col: str = "text", size: int = 1200, overlap: int = 10) -> DataFrame:
    """The ids of the texts that the splitter cut: those with a second piece, one row per row of the table."""
    return split_texts(rows, id_col, text_col, None, size, overlap, False).filter("chunk_index = 1").select(id_col)
