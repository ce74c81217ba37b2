"""Tables out of grids of cells: headers, styles, rows, coverage, regions; pipe tables and lists out of text."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Grid = list[list[str]]
#: Longest header cell and its share of digits, further header rows, longest column name, merged label.
HEADER_CHARS, HEADER_DIGITS, HEADER_ROWS, NAME_CHARS, LABEL_CHARS = 40, 0.4, 3, 100, 40


def is_header_cell(c: Column) -> Column:
    digits = F.length(F.regexp_replace(c, "[^0-9]", ""))
    return (F.length(c) > 0) & (F.length(c) <= HEADER_CHARS) & (digits < F.length(c) * HEADER_DIGITS)


def header_rows(cells: DataFrame) -> DataFrame:
    """``(table_id, header_rows)`` of ``cells(table_id, row_idx, col_idx, text)``.

    Row 0 counts; up to three more do while each has two cells or more that all look like headers and a blank or a value of the row above.
    """
    rows = cells.groupBy("table_id", "row_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("col_idx", "text"))), lambda x: F.coalesce(x["text"], F.lit(""))).alias("row"))
    order = Window.partitionBy("table_id").orderBy("row_idx")  # the rows of one table that can be header rows
    rows = rows.filter(F.col("row_idx") <= HEADER_ROWS).withColumn("above", F.lag("row").over(order))
    said = F.filter("row", lambda c: c != "")
    extends = F.exists("row", lambda c: c == "") | F.arrays_overlap(said, F.filter("above", lambda c: c != ""))
    good = (F.col("row_idx") == 0) | ((F.size(said) >= 2) & F.forall(said, is_header_cell) & extends)
    run = F.min(good.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("run", run).groupBy("table_id").agg(F.sum("run").cast("int").alias("header_rows"))


def coverage(raw: DataFrame, kept: DataFrame) -> DataFrame:
    """``(table_id, text)`` of the cells that got lost, as often as they did: a difference of bags."""
    return raw.select("table_id", "text").filter("text <> ''").exceptAll(kept.select("table_id", "text"))


def composite_columns(grid: Grid, n: int) -> list[str]:
    """Names of columns under ``n`` header rows: the parts from the top, without blanks and repeats; unique."""
    names: list[str] = []
    seen: Counter[str] = Counter()
    for j in range(len(grid[0]) if grid else 0):
        parts: list[str] = []
        for row in grid[:n]:
            if row[j] and row[j] not in parts[-1:]:
                parts.append(row[j])
        name = " - ".join(parts) or f"Column {j}"
        seen[name] += 1
        names.append(name if seen[name] == 1 else f"{name} ({seen[name]})")
    return names


def style(grid: Grid, bold: set[tuple[int, int]], n: int) -> str:
    """keyvalue, complex or header."""
    if not grid:
        return "header"
    if len(grid[0]) == 2:
        labels = {r[0] for r in grid}
        pairs = len(grid) == 1 or (len(labels) == 1 and len(grid[0][0]) >= LABEL_CHARS) or any((i, 0) in bold for i in range(1, len(grid)))
        return "keyvalue" if pairs else "header"
    sections = any(sum(map(bool, r)) == 1 and r[0] and (i, 0) in bold for i, r in enumerate(grid))
    return "complex" if n > 1 or sections else "header"


def table_rows(grid: Grid, n: int) -> list[tuple[str, dict[str, str]]]:
    """Rows of a table under its header as label and values; rows without any text are left out."""
    names = composite_columns(grid, n)
    return [(r[0], dict(zip(names[1:], r[1:], strict=True))) for r in grid[n:] if any(r)]


def row_text(label: str, values: dict[str, str]) -> str:
    """A row as text; equal values of several columns are said once."""
    said = {k: v for k, v in values.items() if v}
    if len(said) > 1 and len(set(said.values())) == 1:
        return f"{label}: {next(iter(said.values()))}"
    return f"{label}: " + ", ".join(f"{k}: {v}" for k, v in said.items())


def wide_names(names: list[str]) -> list[str]:
    return [x for x in names if len(x) > NAME_CHARS]


def regions(rows: Grid, gap_before: list[bool]) -> list[tuple[list[int], list[int]]]:
    """Tables of a sheet as ``(title rows, table rows)``.

    Blank gaps part the rows into blocks; a block that has no row of two cells or more goes with the next. Rows of one cell over the
    first row of two or more are titles, if their text does not come again below in that column; nothing is lost.
    """
    blocks: list[list[int]] = []
    for i, gap in enumerate(gap_before):
        if not blocks or gap:
            blocks.append([])
        blocks[-1].append(i)
    out: list[tuple[list[int], list[int]]] = []
    held: list[int] = []
    for block in blocks:
        block = held + block
        if not any(sum(map(bool, rows[i])) >= 2 for i in block) and block[-1] + 1 < len(rows):
            held = block
            continue
        held = []
        titles: list[int] = []
        for k, i in enumerate(block):
            said = [(j, c) for j, c in enumerate(rows[i]) if c]
            if len(said) == 1 and not any(rows[b][said[0][0]] == said[0][1] for b in block[k + 1 :]):
                titles.append(i)
            else:
                break
        out.append((titles, block[len(titles) :]))
    return out


def pipe_rows(text: Column) -> Column:
    """The rows of a pipe table in a text, as arrays of cells; the rule line is left out."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x.startswith("|") & x.endswith("|") & (F.length(x) > 1))
    cells = F.transform(lines, lambda x: F.transform(F.split(F.substring(x, F.lit(2), F.length(x) - 2), r"\|"), lambda c: F.trim(c)))
    return F.filter(cells, lambda r: ~F.forall(r, lambda c: c.rlike("^:?-+:?$")))


def list_items(text: Column) -> Column:
    """The items of bulleted and numbered lines, repeated ones (in any letter case) once."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.regexp_extract(x, r"^\s*(?:[-*•]|\d+[.)])\s+(.*\S)\s*$", 1))
    return first_of_each(F.filter(lines, lambda x: x != ""), F.lower)


def first_of_each(items: Column, key, last: bool = False) -> Column:
    """The items of an array of which no earlier one (no later one, with ``last``) has the same key, in order; by sorting, not by looking at all before."""
    marked = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), (-i if last else i).alias("i"), x.alias("x"))))
    kept = F.filter(marked, lambda m, j: (j == 0) | ~F.get(marked, j - 1)["k"].eqNullSafe(m["k"]))
    return F.transform(F.array_sort(F.transform(kept, lambda m: F.struct(F.abs(m["i"]).alias("i"), m["x"].alias("x")))), lambda m: m["x"])


def line_kind(line: Column) -> Column:
    """heading, list_item, table or paragraph of a line of text."""
    t = F.trim(line)
    titled = t.rlike(r"^[A-Z][A-Za-z\-]*( [A-Z][A-Za-z\-]*)*$") | ((F.upper(t) == t) & (F.lower(t) != t))
    return (
        F.when(t.rlike(r"^#{1,6}\s"), "heading").when(t.rlike(r"^\|.*\|$"), "table").when(t.rlike(r"^([-*+•]|\d+[.)])\s"), "list_item")
        .when((F.length(t) <= 80) & ~t.rlike(r"[.,;:]$") & titled, "heading").otherwise("paragraph")
    )


def lines(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, block_index, kind, section, text)`` of the lines that aren't blank; the section is the last heading before.

    A document's lines meet once, by its id; nothing is looked up line by line.
    """
    parts = F.filter(F.transform(F.split(text_col, "\n"), lambda x: F.struct(F.trim(x).alias("text"), line_kind(x).alias("kind"))), lambda s: s["text"] != "")
    each = documents.filter(F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.posexplode(parts).alias("block_index", "b")).select("doc_id", "block_index", F.col("b.kind").alias("kind"), F.col("b.text").alias("text"))
    before = Window.partitionBy("doc_id").orderBy("block_index").rowsBetween(Window.unboundedPreceding, 0)  # the lines of one document
    section = F.last(F.when(F.col("kind") == "heading", F.col("text")), ignorenulls=True).over(before)
    return each.select("doc_id", "block_index", "kind", section.alias("section"), "text")


def units(blocks: DataFrame) -> DataFrame:
    """``(doc_id, unit, section, kind, blocks)``: the runs of blocks that are packed together: those of one section, and each table for itself."""
    order = Window.partitionBy("doc_id").orderBy("block_index")  # the blocks of one document
    table = F.col("kind") == "table"
    fresh = table | F.lag(table).over(order) | ~F.col("section").eqNullSafe(F.lag("section").over(order))
    numbered = blocks.withColumn("unit", F.sum(F.coalesce(fresh, F.lit(True)).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("doc_id", "unit").agg(F.first("section").alias("section"), F.max(F.when(table, "table").otherwise("text")).alias("kind"), F.count(F.lit(1)).alias("blocks"))


def word_share(documents: DataFrame, blocks: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, words, share)``: the words of a document and the share of them that stand in its blocks; null without words."""
    count = lambda c: F.size(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"\w+"), F.lit(0)))
    raw = documents.select(F.col(id_col).alias("doc_id"), count(F.col(text_col)).alias("words"))
    kept = blocks.groupBy("doc_id").agg(F.sum(count(F.col("text"))).alias("kept"))
    return raw.join(kept, "doc_id", "left").select("doc_id", "words", F.when(F.col("words") > 0, F.round(F.coalesce("kept", F.lit(0)) / F.col("words"), 6)).alias("share"))


_SECTION = re.compile(r"^([A-Z][^:\n]{0,60}):[ \t]*(.*)$")


def sections(text: str, headers: list[str], inline: bool = False) -> dict[str, str]:
    """Contents under ``Header:`` lines by lower-cased header; a later one of the same name wins.

    With ``inline``, text behind the colon belongs to it and headers are told in their own letter case.
    """
    known = {h if inline else h.lower() for h in headers}
    out: dict[str, list[str]] = {}
    now: str | None = None
    for line in text.split("\n"):
        m = _SECTION.match(line.strip())
        name = m and (m[1] if inline else m[1].lower())
        if m and name in known and (inline or not m[2].strip()):
            now = m[1].lower()
            out[now] = [m[2]] if m[2].strip() else []
        elif now is not None:
            out[now].append(line)
    return {k: "\n".join(v).strip() for k, v in out.items()}


def keyvalue_rows(grid: Grid, bold: set[tuple[int, int]]) -> list[tuple[str, str, str | None]]:
    """``(label, value, subsection)`` of a table of two columns; a bold row of one text opens a subsection, a bold first row is a heading."""
    out: list[tuple[str, str, str | None]] = []
    section: str | None = None
    for i, (label, value) in enumerate(grid):
        if i == 0 and {(0, 0), (0, 1)} <= bold:
            continue
        if label and (not value or value == label) and (i, 0) in bold:
            section = label
        elif label:
            out.append((label, value, section))
    return out


def sectioned_rows(grid: Grid, bold: set[tuple[int, int]], n: int) -> list[tuple[str | None, str, dict[str, str], list[str]]]:
    """``(section, label, values, options)`` of a table with sections: rows of one bold text open one, further single texts are its options."""
    names = composite_columns(grid, n)
    out: list[tuple[str | None, str, dict[str, str], list[str]]] = []
    section: str | None = None
    options: list[str] = []
    for i, row in enumerate(grid[n:], n):
        said = [c for c in row if c]
        if not said:
            continue
        if (len(said) == 1 or len(set(row)) == 1) and row[0] and (i, 0) in bold:
            section, options = row[0], []
        elif len(said) == 1 and section is not None:
            options.append(said[0])
            out.append((section, "", {}, list(options[-1:])))
        else:
            out.append((section, row[0], {k: v for k, v in zip(names[1:], row[1:], strict=True) if v}, []))
    return out
