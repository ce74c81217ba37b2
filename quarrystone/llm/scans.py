"""Repair of text from scanned pages.

Everything runs as joins of small typed tables. Lines at the edge of a page that come back on other pages of their document, apart from
numbers and misreadings, go; the words of the lines left are looked up by anagram hash: the hash of a word is a sum
over its letters, so that a misreading of one letter for another changes it by a fixed difference, wherever it stands. Rare words are joined with
frequent ones over all such differences, what remains is ranked by frequency, and the best one is the correction. A mark at a line's end is
a break if the joined word, not the one with the mark, is known.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from itertools import combinations_with_replacement

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.session import materialise

#: What a scanner reads for what, right then wrong.
CONFUSIONS = [
    ("e", "c"), ("c", "e"), ("l", "1"), ("1", "l"), ("i", "l"), ("l", "i"), ("i", "1"), ("o", "0"), ("0", "o"), ("a", "o"), ("o", "a"), ("g", "q"), ("q", "g"), ("m", "rn"), ("rn", "m"),
    ("n", "ri"), ("ri", "n"), ("h", "b"), ("b", "h"), ("t", "f"), ("f", "t"), ("w", "vv"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("s", "5"), ("5", "s"), ("b", "8"), ("b", "6"), ("z", "2"), ("h", "li"), ("n", "u"), ("u", "n"), ("l", "|"), ("i", "|"), ("in", "m"), ("m", "in"), ("fi", "ﬁ"), ("fl", "ﬂ"), ("ff", "ﬀ"),
]
#: Marks a word may be broken with. U+00AD is the soft hyphen, U+00AC what some scanners read for it.
MARKS = "-‐‑­¬‒"
#: A page line belongs to the edge if it is among so many from the top or the bottom; a running line stands on so many pages.
EDGE, PAGES = 3, 3
#: Share of line breaks inside sentences from which on a document is one of scanned page lines.
WRAPPED = 0.3
#: A word is a misreading of another that is so many times as frequent in sound text.
TIMES = 20

_DIGIT = "[0-9OlI|SB]"
_NUM = rf"(?:(?=[OlI|SB]{{0,3}}[0-9]){_DIGIT}{{1,4}}|[lI|]{{1,2}}|[ivxl1|]{{1,7}}|[ivxlc]{{1,7}}|[IVXLC]{{1,7}})"
_TAG = r"(?:[Pp][ao][gq][ec]|PAGE|[Pp]g\.?|[Pp]\.|S\.|[Ss]ei[tf]e|[Ss]heet|[Bb]latt)"
_OF = rf"(?:\s*(?:[o0a][ft]|OF|/|von|de)\s*{_NUM})?"
#: A line of a page number only, however written.
PAGE_NUMBER = rf"^[\s\[\(\-–—|.~*]*(?:{_TAG}\s*)?{_NUM}{_OF}[\s\]\)\-–—|.~*]*$"
_LEAD = rf"^[\s\[\(\-–—|]*(?:{_TAG}\s*)?{_NUM}{_OF}(?:\s{{2,}}|\s*[|\]\)]\s*|\s+[-–—]\s+)"
_TRAIL = rf"(?:\s{{2,}}|\s*[|\[\(]\s*|\s+[-–—]\s+)(?:{_TAG}\s*)?{_NUM}{_OF}[\s\]\)\-–—|]*$"


def fold(text: Column) -> Column:
    """One spelling for everything a scanner confuses: what is equal apart from misreadings is equal folded."""
    t = F.replace(F.lower(text), F.lit("ﬁ"), F.lit("fi"))
    # Each letter of a group becomes one of it: e c, l 1 i |, o 0 a, g q 9, h b 8 6, t f, s 5, z 2; groups of letters then take
    # the place of the one letter they are read for.
    t = F.translate(t, "c1i|0aq9b86f52", "ellloogghhhtsz")
    for wide, narrow in (("rl", "n"), ("rn", "m"), ("ln", "m"), ("vv", "w"), ("el", "d"), ("ll", "u")):
        t = F.replace(t, F.lit(wide), F.lit(narrow))
    return t


#: Hashes are sums modulo this prime, so that they fit a long for words of any length.
PRIME = (1 << 61) - 1


def anagram_hash(word: Column) -> Column:
    """The sum of the fifth powers of a word's code points, those of far scripts reduced, modulo ``PRIME``."""
    five = lambda x: x * x * x * x * x
    return F.aggregate(F.split(word, ""), F.lit(0).cast("bigint"), lambda acc, x: (acc + five(F.ascii(x).cast("bigint") % 1009)) % PRIME)


def _power(s: str) -> int:
    return sum((ord(c) % 1009) ** 5 for c in s)


def page_rows(chunks: DataFrame) -> DataFrame:
    """The rows of documents of scanned page lines: numbered pages whose lines mostly break inside sentences.

    Documents are told by counts per document, made map-side first, so that the size of none matters.
    """
    pages = chunks.select("row_id", "document_name", "page_number", "text").filter("page_number is not null and text is not null and document_name is not null")
    breaks = F.size(F.regexp_extract_all("text", F.lit(r"\S[ \t\r]*\n\s*\S"), F.lit(0)))
    inner = F.size(F.regexp_extract_all("text", F.lit(r"\n\s*\p{Ll}"), F.lit(0)))
    # A page of a wrapped document has inner breaks, so its rows alone decide; others needn't be counted.
    counts = pages.filter(F.col("text").contains("\n")).groupBy("document_name").agg(F.sum(breaks).alias("breaks"), F.sum(inner).alias("inner"))
    scanned = counts.filter(F.col("inner") >= F.greatest(F.lit(3), F.col("breaks") * WRAPPED)).select("document_name")
    return pages.join(scanned, "document_name", "left_semi")


def page_lines(pages: DataFrame) -> DataFrame:
    """``(row_id, document_name, page_number, line_no, line, kind)`` of every line that isn't blank.

    ``kind`` is running_header, page_number or body. Lines are counted from 1 over all lines of a row, blank ones included.
    """
    split = F.filter(F.transform(F.split("text", "\n"), lambda x, i: F.struct((i + 1).cast("bigint").alias("line_no"), F.regexp_replace(x, r"\s+$", "").alias("line"))), lambda s: F.trim(s["line"]) != "")
    placed = pages.select("row_id", "document_name", "page_number", split.alias("s")).select("row_id", "document_name", "page_number", F.posexplode("s").alias("at", "s"), F.size("s").alias("n"))
    lines = placed.select("row_id", "document_name", "page_number", "s.line_no", "s.line", ((F.col("at") < EDGE) | (F.col("n") - F.col("at") <= EDGE)).alias("edge"))
    number = F.col("edge") & F.col("line").rlike(PAGE_NUMBER)
    key = F.regexp_replace(fold(F.regexp_replace(F.regexp_replace("line", _LEAD, ""), _TRAIL, "")), r"[^\p{L}\p{N}]+", " ")
    lines = lines.select("*", number.alias("number"), F.when(F.col("edge") & ~number, F.trim(key)).alias("key"))
    # Lines of the page text itself end in a sentence or run on and do not come back; running lines do.
    running = lines.filter("key is not null and key <> ''").groupBy("document_name", "key").agg(F.count_distinct("page_number").alias("pages")).filter(F.col("pages") >= PAGES).select("document_name", "key", F.lit(True).alias("running"))
    # Lines without a key go their own ways instead of meeting in one task of the join.
    lines = lines.withColumn("key", F.coalesce("key", F.concat(F.lit("\u0000"), F.col("row_id").cast("string")))).join(running, ["document_name", "key"], "left")
    kind = F.when(F.col("number"), "page_number").when(F.col("running"), "running_header").otherwise("body")
    return lines.select("row_id", "document_name", "page_number", "line_no", "line", kind.alias("kind"))


def word_counts(chunks: DataFrame, pages: DataFrame | None) -> DataFrame:
    """``(word, n)``: how often a word of letters and hyphens stands in all texts, less those of ``pages``."""
    words = lambda df: df.select(F.explode(F.split(F.lower("text"), r"[^\p{L}'\-]+")).alias("word")).filter("word <> ''")
    total = words(chunks.select("text")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    if pages is None:
        return total
    less = words(pages).groupBy("word").agg((-F.count(F.lit(1))).alias("n"))
    return total.unionByName(less).groupBy("word").agg(F.sum("n").alias("n")).filter("n > 0")


def is_misreading(word: str, right: str, most: int = 2) -> bool:
    """Whether ``word`` is ``right`` with at most so many confusions."""
    at = 0
    while at < min(len(word), len(right)) and word[at] == right[at]:
        at += 1
    word, right = word[at:], right[at:]
    if not word or not right or not most:
        return word == right
    # No wrong form begins with the letter its right form begins with, so the first difference begins a confusion.
    return any(word.startswith(y) and right.startswith(x) and is_misreading(word[len(y) :], right[len(x) :], most - 1) for x, y in CONFUSIONS)


def _misreadings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array([is_misreading(w, r) for w, r in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)], pa.bool_()))


def corrections(candidates: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(word, best, best_n)``: for words not frequent themselves, the most frequent word they may be a misreading of.

    One or two confusions are tried. The hash join proposes; the letters of the two words, one after the other, dispose.
    """
    unknown = candidates.select("word").distinct().join(vocabulary, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"))
    steps = sorted({(wrong, _power(right) - _power(wrong)) for right, wrong in CONFUSIONS})
    moves = [(a,) for a in steps] + list(combinations_with_replacement(steps, 2))
    # One constant instead of some thousand expressions.
    said = json.dumps([{"x": m[0][0], "y": m[-1][0], "by": sum(d for _, d in m) % PRIME} for m in moves])
    table = F.from_json(F.lit(said), "array<struct<x:string,y:string,by:bigint>>")
    fitting = F.filter(table, lambda m: F.col("word").contains(m["x"]) & F.col("word").contains(m["y"]))
    tried = unknown.select("word", "n", anagram_hash(F.col("word")).alias("h"), F.explode(F.array_distinct(F.transform(fitting, lambda m: m["by"]))).alias("by")).select("word", "n", ((F.col("h") + F.col("by")) % PRIME).alias("hash"))
    frequent = vocabulary.filter("n >= 3").select(F.col("word").alias("best"), F.col("n").alias("best_n"), anagram_hash(F.col("word")).alias("hash"))
    found = tried.join(frequent, "hash").filter((F.col("word") != F.col("best")) & (F.col("best_n") >= F.greatest(F.lit(3), F.col("n") * TIMES)))
    found = found.select("word", "best", "best_n").mapInArrow(_misreadings, "word string, best string, best_n bigint")
    return found.groupBy("word").agg(F.max(F.struct("best_n", "best")).alias("top")).select("word", F.col("top.best").alias("best"), F.col("top.best_n").alias("best_n"))


#: Words of the tokens of a line: outer punctuation goes, letters, digits, inner hyphens and apostrophes stay.
_TOKENS = r"[\s.,;:()\"“”!?\[\]/%=<>+*&]+"
#: A number with letters in it that look like digits.
_NUMBER = r"^(?:[0-9]*[OolI|][0-9OolI|]*[0-9][0-9OolI|]*|[0-9][0-9OolI|]*[OolI|][0-9OolI|]*|[0-9]+[SB]|[SB][0-9]+|l|O|[A-Z]{2}-[0-9OolI|]*[OolI|][0-9OolI|]*[A-H]?)$"


def analyse(chunks: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines with their kinds, breaks at line ends, and misread words.

    - lines: see ``page_lines``;
    - breaks ``(row_id, line_no, next_row, next_line, head, tail, mark, split)``: body lines that end with a mark;
    - misread ``(row_id, line_no, word, best)``: words of body lines that are misreadings, of the line that holds the misread letter.
    """
    pages = materialise(page_rows(chunks), "pages")
    lines = materialise(page_lines(pages), "lines")
    vocabulary = materialise(word_counts(chunks, pages), "words")
    body = lines.filter("kind = 'body'").select("row_id", "document_name", "page_number", "line_no", F.trim("line").alias("line"))

    # The first word behind a line: of the next body line, or of the first one of the next page.
    order = Window.partitionBy("row_id").orderBy("line_no")  # the lines of one page
    first = F.regexp_extract("line", r"^\S+", 0)
    body = body.withColumn("first", first).withColumn("next_line", F.lead("line_no").over(order)).withColumn("next_first", F.lead("first").over(order))
    opening = body.groupBy("document_name", "page_number").agg(F.min(F.struct("row_id", "line_no", "first")).alias("o")).select(
        "document_name", (F.col("page_number") - 1).alias("page_number"), F.col("o.row_id").alias("o_row"), F.col("o.line_no").alias("o_line"), F.col("o.first").alias("o_first")
    )
    marked = body.filter(F.col("line").rlike(rf"\p{{L}}[{MARKS}]$"))
    marked = marked.join(opening, ["document_name", "page_number"], "left")
    inside = F.col("next_line").isNotNull()
    ends = marked.select(
        "row_id", "line_no", F.when(inside, F.col("row_id")).otherwise(F.col("o_row")).alias("next_row"), F.coalesce("next_line", "o_line").alias("next_line"),
        F.regexp_extract("line", rf"(\S*)[{MARKS}]$", 1).alias("head_raw"), F.substring("line", -1, 1).alias("mark"), F.coalesce("next_first", "o_first", F.lit("")).alias("tail_raw"),
    )
    # "(field-" and "e.g.self-" give the part behind the last punctuation, "tenance." the part before the first.
    ends = ends.select("*", F.regexp_extract("head_raw", r"([\p{L}\p{N}'\-]*)$", 1).alias("head"), F.regexp_extract("tail_raw", r"^([\p{L}\p{N}'\-]*)", 1).alias("tail"))
    ends = ends.select("*", F.lower(F.concat("head", "tail")).alias("joined"), F.lower(F.concat("head", F.lit("-"), "tail")).alias("hyphened"))

    # Words of body lines, without the parts of those that end on the next line.
    parts = body.select("row_id", "line_no", F.explode(F.array_distinct(F.split("line", _TOKENS))).alias("token")).filter("token <> ''")
    outer = ends.select("row_id", "line_no", F.lower(F.concat("head", "mark")).alias("word")).unionByName(ends.filter("next_line is not null").select(F.col("next_row").alias("row_id"), F.col("next_line").alias("line_no"), F.lower("tail").alias("word")))
    numbers = parts.filter(F.col("token").rlike(_NUMBER)).select("row_id", "line_no", F.col("token").alias("word"), F.translate("token", "OolI|S", "001115").alias("best"))
    words = parts.select("row_id", "line_no", "token", F.lower("token").alias("word")).filter(F.col("word").rlike(r"\p{L}") & ~F.col("token").rlike(_NUMBER) & ~F.col("word").rlike(r"^[a-z]{2}-\d+[a-h]?$"))
    words = words.select("row_id", "line_no", "word").join(outer, ["row_id", "line_no", "word"], "left_anti")

    looked = words.select("word").distinct().unionByName(ends.select(F.col("joined").alias("word"))).unionByName(ends.select(F.col("hyphened").alias("word"))).distinct()
    fixes = materialise(corrections(looked, vocabulary), "fixes")

    # Hyphen evidence: which of the two words is known, by itself or corrected.
    known = vocabulary.select("word", "n", F.lit(None).cast("string").alias("best")).unionByName(fixes.select("word", F.col("best_n").alias("n"), "best"))
    known = known.groupBy("word").agg(F.max(F.struct("n", "best")).alias("k")).select("word", "k.n", "k.best")
    side = lambda name: known.select(F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("best").alias(f"{name}_best"))
    judged = ends.join(side("joined"), "joined", "left").join(side("hyphened"), "hyphened", "left")
    j, h = F.coalesce("joined_n", F.lit(0)), F.coalesce("hyphened_n", F.lit(0))
    code = F.col("head").rlike(r"^[A-Z]{1,3}$") & F.col("tail").rlike(r"^[0-9OolI]")
    split = F.when(code, False).when((j == 0) & (h == 0), F.col("mark") != "-").otherwise(j > h)
    # Neither word is known: a part that is no word of its own tells a break.
    alone = known.filter("best is null").select(F.col("word").alias("head_word"), F.col("n").alias("head_n"))
    alone_tail = known.filter("best is null").select(F.col("word").alias("tail_word"), F.col("n").alias("tail_n"))
    judged = judged.join(alone, F.lower("head") == F.col("head_word"), "left").join(alone_tail, F.lower("tail") == F.col("tail_word"), "left")
    torn = F.col("tail").rlike(r"^\p{Ll}") & (F.coalesce("head_n", F.lit(0)) < 20) | F.col("tail").rlike(r"^\p{Ll}") & (F.coalesce("tail_n", F.lit(0)) < 20)
    # At the end of the document, a head that is no word tells it.
    torn = F.when(F.col("tail") == "", F.coalesce("head_n", F.lit(0)) < 20).otherwise(torn)
    split = F.when((j == 0) & (h == 0) & (F.col("mark") == "-") & ~code, torn).otherwise(split)
    breaks = materialise(judged.select("row_id", "line_no", "next_row", "next_line", "head", "tail", "tail_raw", "mark", "joined", "hyphened", "joined_best", "hyphened_best", split.alias("split")), "breaks")

    # A misread letter of a broken word is on the line of its part.
    whole = breaks.select("*", F.when(F.col("split"), F.col("joined_best")).otherwise(F.col("hyphened_best")).alias("best"), F.when(F.col("split"), F.col("joined")).otherwise(F.col("hyphened")).alias("word")).filter("best is not null")
    in_head = F.expr("left(best, length(head))") != F.lower("head")
    in_tail = F.expr("right(best, length(tail))") != F.lower("tail")
    at_head = whole.filter(in_head & (F.length("head") > 0)).select("row_id", "line_no", "word", "best")
    at_tail = whole.filter(in_tail & F.col("next_line").isNotNull() & (F.length("tail") > 0)).select(F.col("next_row").alias("row_id"), F.col("next_line").alias("line_no"), "word", "best")
    plain = words.join(fixes.select("word", "best"), "word").select("row_id", "line_no", "word", "best")
    misread = plain.unionByName(numbers).unionByName(at_head).unionByName(at_tail)
    return lines, breaks, misread


def scan_defects(chunks: DataFrame) -> DataFrame:
    """``(row_id, line_no, defect)``: running_header, page_number, split_word and misread, each once for a line.

    Null texts, names and page numbers are no page; pages delivered again come out under both ids, with running lines counted
    by page. An empty table gives an empty result.
    """
    lines, breaks, misread = analyse(chunks)
    edges = lines.filter("kind <> 'body'").select("row_id", "line_no", F.col("kind").alias("defect"))
    split = breaks.filter("split").select("row_id", "line_no", F.lit("split_word").alias("defect"))
    wrong = misread.select("row_id", "line_no", F.lit("misread").alias("defect"))
    return edges.unionByName(split).unionByName(wrong).distinct()


def repaired_pages(chunks: DataFrame) -> DataFrame:
    """``(row_id, document_name, page_number, text, runs_on)``: the pages as paragraphs of whole, correct words.

    Page matter is gone, broken words stand whole at their head and are gone from the line or page of their tail, corrections are made in the case of
    the word they replace. Lines of a paragraph are joined by a blank, paragraphs part at blank lines. ``runs_on`` says that
    the last paragraph goes on with the first of the next page.
    """
    lines, breaks, misread = analyse(chunks)
    # A broken word stands whole on the line of its head, wherever its misread letter is.
    word = F.when(F.col("split"), F.col("joined")).otherwise(F.col("hyphened"))
    right = F.when(F.col("split"), F.col("joined_best")).otherwise(F.col("hyphened_best"))
    whole_words = breaks.select("row_id", "line_no", word.alias("word"), right.alias("best")).filter("best is not null")
    fixes = misread.select("row_id", "line_no", "word", "best").unionByName(whole_words).distinct().groupBy("row_id", "line_no", "word").agg(F.max("best").alias("best")).groupBy("row_id", "line_no").agg(F.map_from_entries(F.collect_list(F.struct("word", "best"))).alias("fixes"))
    head = breaks.select("row_id", "line_no", F.when(F.col("split"), F.concat("head", "tail_raw")).otherwise(F.concat("head", F.lit("-"), "tail_raw")).alias("whole"), F.concat("head", "mark").alias("broken"))
    tail = breaks.filter("next_line is not null").select(F.col("next_row").alias("row_id"), F.col("next_line").alias("line_no"), F.col("tail_raw").alias("gone"))
    body = lines.filter("kind = 'body'").join(fixes, ["row_id", "line_no"], "left").join(head, ["row_id", "line_no"], "left").join(tail, ["row_id", "line_no"], "left")
    text = F.when(F.col("whole").isNotNull(), F.concat(F.expr("left(t0, length(t0) - length(broken))"), F.col("whole"))).otherwise(F.col("t0"))
    body = body.withColumn("t0", F.when(F.col("gone").isNotNull(), F.ltrim(F.expr("substring(trim(line), length(gone) + 1)"))).otherwise(F.trim("line"))).withColumn("t1", text)
    pieces = F.regexp_extract_all("t1", F.lit(r"[\p{L}\p{N}'\-|]+|[^\p{L}\p{N}'\-|]+"), F.lit(0))
    best = lambda x: F.coalesce(F.element_at("fixes", F.lower(x)), F.element_at("fixes", x))
    cased = lambda x: F.when(F.substring(x, 1, 1).rlike(r"\p{Lu}"), F.concat(F.upper(F.substring(best(x), 1, 1)), F.substring(best(x), F.lit(2), F.length(best(x))))).otherwise(best(x))
    fixed = F.when(F.col("fixes").isNull(), F.col("t1")).otherwise(F.array_join(F.transform(pieces, lambda x: F.coalesce(cased(x), x)), ""))
    body = body.select("row_id", "document_name", "page_number", "line_no", fixed.alias("t"))
    page = body.groupBy("row_id", "document_name", "page_number").agg(F.sort_array(F.collect_list(F.struct("line_no", "t"))).alias("ls"))
    # A gap in the line numbers is a blank line or page matter; inside the body, a paragraph ends there.
    glue = F.aggregate("ls", F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("text")), lambda acc, x: F.struct(
        x["line_no"].alias("at"),
        F.when(acc["text"] == "", x["t"]).when(x["line_no"] > acc["at"] + 1, F.concat(acc["text"], F.lit("\n\n"), x["t"])).when(x["t"] == "", acc["text"]).otherwise(F.concat(acc["text"], F.lit(" "), x["t"])).alias("text")))
    return page.select("row_id", "document_name", "page_number", glue["text"].alias("text")).withColumn("runs_on", ~F.col("text").rlike(r"[.!?:][\"')\]]*$"))


#: Pages of a document whose running numbers one task makes.
BLOCK_PAGES = 512


def repaired_paragraphs(chunks: DataFrame) -> DataFrame:
    """``(document_name, first_page, paragraph, text)``: the paragraphs of each document, whole over the borders of pages.

    ``paragraph`` counts from 0 on the page where the paragraph begins. Of pages delivered again the one of the lowest row_id counts. Where a paragraph
    began is a running maximum over pages: inside blocks of ``BLOCK_PAGES``, then over one row a block, so that no document is
    gathered in one task.
    """
    every = repaired_pages(chunks).groupBy("document_name", "page_number").agg(F.min_by(F.struct("text", "runs_on"), "row_id").alias("p"))
    pages = materialise(every.select("document_name", "page_number", F.split("p.text", "\n\n").alias("parts"), F.col("p.runs_on").alias("runs_on")), "paragraphs")
    before = pages.filter("runs_on").select("document_name", (F.col("page_number") + 1).alias("page_number"), F.lit(True).alias("goes_on"))
    marks = pages.select("document_name", "page_number", F.size("parts").alias("n")).join(before, ["document_name", "page_number"], "left").withColumn("goes_on", F.coalesce("goes_on", F.lit(False)))
    # The page on which the last paragraph of a page begins: this one, unless it only goes on with the one before.
    own = F.when((F.col("n") > 1) | ~F.col("goes_on"), F.struct("page_number", (F.col("n") - 1).alias("paragraph")))
    marks = marks.withColumn("block", F.floor(F.col("page_number") / BLOCK_PAGES)).withColumn("own", own)
    inside = Window.partitionBy("document_name", "block").orderBy("page_number")
    blocks = marks.groupBy("document_name", "block").agg(F.max("own").alias("top"))
    over = Window.partitionBy("document_name").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    carried = blocks.select("document_name", "block", F.max("top").over(over).alias("carried"))
    at = marks.withColumn("here", F.max("own").over(inside)).join(carried, ["document_name", "block"]).select("document_name", "page_number", "goes_on", F.coalesce("here", "carried").alias("at"))
    previous = at.select("document_name", (F.col("page_number") + 1).alias("page_number"), F.col("at").alias("previous"))
    pieces = pages.select("document_name", "page_number", F.posexplode("parts").alias("k", "text")).join(at.select("document_name", "page_number", "goes_on"), ["document_name", "page_number"]).join(previous, ["document_name", "page_number"], "left")
    key = F.when((F.col("k") == 0) & F.col("goes_on"), F.col("previous")).otherwise(F.struct("page_number", F.col("k").alias("paragraph")))
    pieces = pieces.select("document_name", key.alias("key"), "page_number", "text").filter("text <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "text"))), lambda x: x["text"]), " ")
    return pieces.groupBy("document_name", "key").agg(joined.alias("text")).select("document_name", F.col("key.page_number").alias("first_page"), F.col("key.paragraph").alias("paragraph"), "text")


def is_page_number(line: str) -> bool:
    """Whether a line is a page number only, for use outside tables."""
    return re.match(PAGE_NUMBER, line) is not None
