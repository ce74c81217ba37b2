"""Tables of documents out of grids of cells: their style, their rows, their text, and what got lost on the way."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.cells import HEADER_CHARS, HEADER_DIGITS, HEADER_ROWS, Grid, composite_columns, style, wide_names

Bold = set[tuple[int, int]]


class Row(NamedTuple):
    """A row of a table: under which section, its label, its values by column, or the options of the section."""

    section: str | None
    label: str
    values: list[tuple[str, str]]
    options: list[str]


def is_header(cell: str) -> bool:
    return 0 < len(cell) <= HEADER_CHARS and sum(map(str.isdigit, cell)) < HEADER_DIGITS * len(cell)


def header_count(grid: Grid) -> int:
    """Rows of the header: the first one, and up to three more of two header cells or more that leave a cell blank or repeat one above."""
    n = 1
    while n < len(grid) and n <= HEADER_ROWS:
        said = [c for c in grid[n] if c]
        goes_on = "" in grid[n] or not set(said).isdisjoint(c for c in grid[n - 1] if c)
        if len(said) < 2 or not all(map(is_header, said)) or not goes_on:
            break
        n += 1
    return n


def _spoken(row: list[str]) -> Counter[str]:
    """The texts of a row; one cell merged over the whole row is one text."""
    said = [c for c in row if c]
    return Counter(said[:1] if len(said) == len(row) and len(set(said)) == 1 else said)


def _opens_section(row: list[str], i: int, bold: Bold) -> bool:
    said = [c for c in row if c]
    return bool(said) and (len(said) == 1 or (len(said) == len(row) and len(set(said)) == 1)) and (i, 0) in bold


def build_table(grid: Grid, bold: Bold = frozenset()) -> dict[str, Any]:
    """``style, columns, rows, dropped, suspicious`` of a grid of equally long rows.

    - keyvalue: label and value, under the last bold single text; a first row all bold is a heading.
    - header: a first row of column names; complex: several such rows, or sections of rows and options.

    ``dropped`` has the cells that are in no row, as often as they are missing, ``suspicious`` column names too long to be any. An empty grid has no rows.
    """
    n = header_count(grid) if grid else 1
    kind = style(grid, {(i, 0) for i, row in enumerate(grid) if i >= n and _opens_section(row, i, bold)} if grid and len(grid[0]) != 2 else bold, n)
    first = {"keyvalue": 0, "header": 1}.get(kind, n)
    columns = [] if kind == "keyvalue" or not grid else composite_columns(grid, first)
    rows: list[Row] = []
    section: str | None = None
    for i, row in enumerate(grid[first:], first):
        if not any(row):
            continue
        opens = kind != "header" and _opens_section(row, i, bold)
        if kind == "keyvalue" and i == 0 and sum(map(bool, row)) > 1 and all((i, j) in bold for j, c in enumerate(row) if c):
            continue
        if opens:
            section = next(c for c in row if c)
            if kind == "complex":
                rows.append(Row(section, "", [], []))  # a section may stay empty
        elif kind == "keyvalue":
            if row[0]:
                rows.append(Row(section, row[0], [("", row[1] if len(row) > 1 else "")], []))
        elif kind == "complex" and section is not None and sum(map(bool, row)) == 1:
            rows.append(Row(section, "", [], [c for c in row if c]))
        else:
            values = [(name, c) for name, c in zip(columns[1:], row[1:], strict=False) if c or kind == "header"]
            rows.append(Row(section, row[0], values, []))
    raw: Counter[str] = Counter()
    for row in grid[first:]:
        raw.update(_spoken(row))
    kept: Counter[str] = Counter()
    for r in rows:
        kept.update(x for x in [r.label, *(v for _, v in r.values), *r.options, r.section if kind == "keyvalue" or not (r.label or r.values or r.options) else ""] if x)
    if kind == "keyvalue" and grid:
        kept.update(_spoken(grid[0]))
    return {"style": kind, "columns": columns, "rows": rows, "dropped": sorted((raw - kept).elements()), "suspicious": wide_names(columns)}


def _said(label: str, values: list[tuple[str, str]]) -> str:
    texts = {v for _, v in values}
    value = next(iter(texts)) if len(values) > 1 and len(texts) == 1 else ", ".join(f"{k}: {v}" for k, v in values if v)
    return f"{label}: {value}" if value else label


def table_text(table: dict[str, Any]) -> str:
    """A table as sentences, one a row; values equal in all columns are said once, options of a section together behind its rows."""
    parts: list[str] = []
    if table["style"] == "keyvalue":
        for r in table["rows"]:
            lead, value = f"{r.section} - " if r.section else "", r.values[0][1]
            parts.append(f"{lead}{r.label}: {value}" if value else f"{lead}{r.label}")
        return ". ".join(p for p in parts if p)
    at = 0
    rows = table["rows"]
    while at < len(rows):
        if rows[at].section is None:
            parts.append(_said(rows[at].label, rows[at].values))
            at += 1
            continue
        end = at + 1
        while end < len(rows) and (rows[end].label or rows[end].values or rows[end].options):
            end += 1
        own = rows[at:end]
        parts += [f"{r.section} - {_said(r.label, r.values)}" for r in own if r.label or r.values]
        if options := [o for r in own for o in r.options]:
            parts.append(f"{own[0].section} options: {', '.join(options)}")
        at = end
    return ". ".join(p for p in parts if p)


def structured(grids: DataFrame, id_col: str, grid_col: str) -> DataFrame:
    """``(id, style, columns, rows, text, dropped)`` of a table of grids ``array<array<string>>``; empty and null grids have no rows."""
    src = grids.select(F.col(id_col).cast("bigint").alias("id"), grid_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for grid in batch.column(1).to_pylist():
                rows = [[c or "" for c in r or []] for r in grid or []]
                width = max(map(len, rows), default=0)
                made = build_table([r + [""] * (width - len(r)) for r in rows])
                found.append((made["style"], made["columns"], len(made["rows"]), table_text(made), made["dropped"]))
            kinds = [pa.string(), pa.list_(pa.string()), pa.int32(), pa.string(), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds))], ["id", "style", "columns", "rows", "text", "dropped"])

    return src.mapInArrow(run, "id bigint, style string, columns array<string>, rows int, text string, dropped array<string>")
