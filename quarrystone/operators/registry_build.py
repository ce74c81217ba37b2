"""The product registry out of catalogues: typed facts, ordering codes with what they mean, and other choices a catalogue offers.

A catalogue is one row of blocks (``sources.documents.documents``), so that catalogues are read in parallel, each in its own row. The ordering code
is looked for under its heading: a line of codes parted by tabs, a line of labels, and meanings from a table of choices, a list of codes, a line of
values or a list inside the code, in this order. Nothing is guessed: a code without a meaning is Unknown.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarrystone.operators.registry import FACT_CHARS, INSTALLS, LINE_CHARS, TECHNOLOGIES, TYPES

#: Headings over an ordering code; how far the lines of codes and meanings may stand behind.
HEADINGS = ["product ordering nomenclature", "product ordering information"]
LINES, MEANINGS = 9, 7
UNKNOWN = "Unknown"
#: A code with its meaning in a list, and a code in brackets.
_MEANING = re.compile(r"^([A-Za-z0-9%]{1,4})\s*[-–]\s*(\S.*)$", re.S)
_BRACKETED = re.compile(r"\((\w{1,3})\)")
_PAIRS = pa.list_(pa.struct([("code", pa.string()), ("text", pa.string())]))
_SEGMENT = pa.struct([("pos", pa.int32()), ("code", pa.string()), ("label", pa.string()), ("values", _PAIRS)])
_CHOICE = pa.struct([("label", pa.string()), ("values", _PAIRS)])

Grid = list[list[str]]


def selectable(code: str) -> bool:
    """Whether a part of a code is chosen by the customer: starred, a list with slashes, or a letter two or three times."""
    core = code.rstrip("*")
    return code.endswith("*") or "/" in core or re.fullmatch(r"([A-Za-z])\1{1,2}", core, re.I) is not None


def span(text: str) -> str | None:
    """A range as a code or a cell of a span row says it, in one form: ``2K`` and ``2,000 ppm`` are 2000, ``5 vol%`` is 5%; None for others."""
    t = text.rstrip("*").strip()
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*[kK]", t):
        return str(int(float(m[1]) * 1000))
    if m := re.fullmatch(r"([\d,]+)\s*ppm", t, re.I):
        return m[1].replace(",", "")
    if m := re.fullmatch(r"(\d+(?:\.\d+)?)\s*(?:\w+\s*)?%", t):
        return f"{m[1]}%"
    return None


def _columns_of_codes(grid: Grid, codes: list[str]) -> dict[int, tuple[str, str]]:
    """Columns of a table of choices with their code and name: by a row of spans, else by a code in brackets in the first row."""
    spans = next((row for row in grid if row[0].strip().lower() == "span"), None)
    if spans:
        known = {n: c for c in reversed(codes) if (n := span(c)) is not None}
        found = {j: (known[n], "") for j, cell in enumerate(spans) if j and (n := span(cell)) in known}
        if found:
            return found
    out = {}
    for j, cell in enumerate(grid[0]):
        if j and (m := _BRACKETED.search(cell)):
            out[j] = (m[1], " ".join(p.strip() for p in _BRACKETED.split(cell)[::2] if p.strip()))
    return out


def _described(rows: Grid, j: int) -> str:
    return "; ".join(f"{r[0]}: {r[j]}" for r in rows if j < len(r) and r[j] and r[0])


def coded_choices(grid: Grid, codes: list[str]) -> dict[str, str]:
    """``code: text`` of a table of choices, empty if its columns have no codes.

    Rows behind the last one that differs between the columns belong to the whole product, not to a choice.
    """
    if not grid or len(grid[0]) < 2:
        return {}
    columns = _columns_of_codes(grid, codes)
    rows = grid[1:]
    if len(columns) > 1:
        differ = [k for k, r in enumerate(rows) if len({r[j] for j in columns if j < len(r) and r[j]}) > 1]
        rows = rows[: differ[-1] + 1] if differ else []
    out = {code: (_described(rows, j) if rows else "") or name for j, (code, name) in columns.items()}
    return {c: t for c, t in out.items() if t}


def named_choices(grid: Grid) -> dict[str, str]:
    """``name: text`` of a table of choices by the names of its columns; equal names are told apart by their column."""
    out: dict[str, str] = {}
    for j, name in enumerate(grid[0] if grid else []):
        if j and name:
            out[name if name not in out else f"{name} ({j})"] = _described(grid[1:], j) or UNKNOWN
    return out


def _words(text: str) -> set[str]:
    return {w[:-1] if w.endswith("s") and len(w) > 3 else w for w in re.findall("[a-z]+", text.lower())}


class Catalogue:
    """The blocks of one catalogue, asked for its ordering code."""

    def __init__(self, blocks: list[dict[str, Any]]):
        self.items = blocks
        self.tables: list[Grid] = [b["grid"] for b in blocks if b.get("grid")]

    def table_for(self, label: str) -> int | None:
        """The number of the first table of choices whose first cell shares a word with a label."""
        words = _words(label)
        return next((k for k, g in enumerate(self.tables) if g[0] and "selectable" in g[0][0].lower() and _words(g[0][0]) & words), None)

    def fixed(self, label: str) -> str | None:
        """The value of the first paragraph ``label: value``."""
        lead = label.lower()
        for b in self.items:
            text = (b.get("text") or "").strip()
            if not b.get("grid") and text.lower().startswith(lead) and (m := re.match(r"\s*:\s*(\S.*)$", text[len(label) :], re.S)):
                return m[1].strip()
        return None

    def _lines(self) -> tuple[list[str], list[str], list[str], dict[str, str]]:
        """Codes, labels and values under the heading, and the meanings listed behind the labels."""
        start = next((k for k, b in enumerate(self.items) if not b.get("grid") and any(h in (b.get("text") or "").lower() for h in HEADINGS)), None)
        if start is None:
            return [], [], [], {}
        lines: list[tuple[int, list[str]]] = []
        grid: list[str] = []
        for k, b in enumerate(self.items[start + 1 : start + 1 + LINES], start + 1):
            if b.get("grid"):
                grid = grid or list(b["grid"][0])
            elif "\t" in (b.get("raw") or "").strip() and len(lines) < 3:
                lines.append((k, [p.strip() for p in b["raw"].split("\t") if p.strip()]))
        meanings: dict[str, str] = {}
        for b in self.items[lines[1][0] + 1 : lines[1][0] + 1 + MEANINGS] if len(lines) > 1 else []:
            if b.get("grid"):
                break
            if m := _MEANING.match((b.get("text") or "").strip()):
                meanings[m[1]] = m[2].strip()
            elif meanings:
                break
        if len(lines) < 2:
            return grid, [], [], meanings
        return lines[0][1], lines[1][1], lines[2][1] if len(lines) > 2 else [], meanings

    def ordering(self) -> tuple[list[str], list[tuple[int, str, str, dict[str, str]]], list[tuple[str, dict[str, str]]]]:
        """Aliases, segments ``(pos, code, label, values)`` of those with values, and other choices ``(label, values)``."""
        codes, labels, given, meanings = self._lines()
        segments: list[tuple[int, str, str, dict[str, str]]] = []
        used: set[int] = set()
        chosen = [c for c in codes if selectable(c)]
        # Values stand under the last of the chosen parts: identity parts in front have none.
        inline = dict(zip(chosen[-len(given) :], given, strict=True)) if given and len(given) <= len(chosen) else {}
        if len(labels) == len(codes):
            for pos, (code, label) in enumerate(zip(codes, labels, strict=True)):
                values: dict[str, str] = {}
                if code in chosen:
                    at = self.table_for(label)
                    values = coded_choices(self.tables[at], list(meanings)) if at is not None else {}
                    if not values and pos == len(codes) - 1:
                        values = dict(meanings)
                    if not values and code in inline:
                        values = {"*": inline[code]}
                    if not values and "/" in code:
                        values = dict.fromkeys(code.rstrip("*").split("/"), UNKNOWN)
                    if values and at is not None:
                        used.add(at)
                if not values and (said := self.fixed(label)):
                    values = {"*": said}
                if values:
                    segments.append((pos, code, label, values))
        plain = [c.rstrip("*") for c in codes]
        base = " ".join(plain[:-1] or plain)
        aliases = [plain[0], base, f"{base} {plain[-1]}", *(f"{base} {m}" for m in meanings)] if plain else []
        choices: dict[str, dict[str, str]] = {}
        for k, grid in enumerate(self.tables):
            if k not in used and len(grid[0]) > 1 and grid[0][0].lower().startswith("selectable"):
                label = re.sub(r"(?i)^selectable\s+", "", grid[0][0].split("\n")[0]).strip()
                if label and label not in choices and (values := named_choices(grid)):
                    choices[label] = values
        return list(dict.fromkeys(a.strip() for a in aliases if a.strip())), segments, list(choices.items())


def ordering_codes(documents: DataFrame) -> DataFrame:
    """``(filename, aliases, nomenclature, choices)`` of documents of ``sources.documents.documents``; those without an ordering code have empty arrays."""
    pair = "array<struct<code:string,text:string>>"
    kind = T.StructType.fromDDL(f"filename string, aliases array<string>, nomenclature array<struct<pos:int,code:string,label:string,values:{pair}>>, choices array<struct<label:string,values:{pair}>>")
    src = documents.select("filename", F.transform("blocks", lambda b: F.struct(b["text"].alias("text"), b["raw"].alias("raw"), b["grid"].alias("grid"))).alias("blocks"))
    said = lambda values: [{"code": c, "text": t} for c, t in values.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Catalogue(b or []).ordering() for b in batch.column(1).to_pylist()]
            segments = [[{"pos": p, "code": c, "label": label, "values": said(v)} for p, c, label, v in s] for _, s, _ in found]
            choices = [[{"label": label, "values": said(v)} for label, v in c] for _, _, c in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _, _ in found], pa.list_(pa.string())), pa.array(segments, pa.list_(_SEGMENT)), pa.array(choices, pa.list_(_CHOICE))], kind.names)

    return src.mapInArrow(run, kind)


def build_registry(documents: DataFrame, names: DataFrame, vocabulary: dict[str, list[str]] | None = None) -> DataFrame:
    """The registry of catalogues, with the columns of the products table and ``choices``.

    ``names`` has ``(document_name, product_name)``, as the index names them, so that registry and index agree. Facts come from the first characters of a
    text, the technology from a line ``Technology:`` before. Only DOCX files are catalogues; a document without a name has its file's.
    """
    words = vocabulary or {"product_type": TYPES, "install_type": INSTALLS, "technology": TECHNOLOGIES}
    first = F.substring(F.coalesce("text", F.lit("")), 1, FACT_CHARS)

    def told(text, terms: list[str], otherwise):
        out = otherwise
        for t in sorted(terms, key=lambda t: (len(t), t)):
            out = F.when(F.contains(F.lower(text), F.lit(t.lower())), F.lit(t)).otherwise(out)
        return out

    line = F.substring(F.regexp_extract(F.coalesce("text", F.lit("")), r"Technology:\s*(.+)", 1), 1, LINE_CHARS)
    docs = documents.filter(F.lower("filename").endswith(".docx"))
    coded = ordering_codes(docs)
    whole = docs.join(coded, "filename").join(names.withColumnRenamed("document_name", "filename"), "filename", "left")
    name = F.coalesce("product_name", F.regexp_replace("filename", r"\.[^.]*$", ""))
    as_map = lambda values: F.map_from_entries(F.transform(values, lambda v: F.struct(v["code"], v["text"])))
    segments = F.transform("nomenclature", lambda s: F.struct(s["pos"].alias("pos"), s["code"].alias("code"), s["label"].alias("label"), as_map(s["values"]).alias("segment_values")))
    return whole.select(
        name.alias("product_name"), F.split_part(name, F.lit(" "), F.lit(1)).alias("family"), told(first, words["product_type"], F.lit(UNKNOWN)).alias("product_type"),
        told(line, words["technology"], told(first, words["technology"], F.lit(UNKNOWN))).alias("technology"), told(first, words["install_type"], F.lit(UNKNOWN)).alias("install_type"),
        F.when(F.col("text").contains("H2") | F.col("text").contains("Hydrogen"), "H2").otherwise(UNKNOWN).alias("target_gas"), F.col("filename").alias("source_catalogue"),
        F.array_sort(F.array_union(F.array(name), F.col("aliases"))).alias("aliases"), segments.alias("nomenclature"), "choices",
    )


#: The record of a product in a saved registry.
RECORD = "product_name string, family string, product_type string, technology string, install_type string, target_gas string, source_catalogue string, aliases array<string>, nomenclature array<struct<pos:int,code:string,label:string,segment_values:map<string,string>>>"


def save_registry(registry: DataFrame, path: str) -> None:
    """One line of JSON a product; the whole registry is written anew."""
    registry.select(F.to_json(F.struct("*")).alias("value")).write.mode("overwrite").text(path)


def parse_registry(lines: DataFrame, column: str = "value") -> DataFrame:
    """Products of lines of JSON. A nomenclature given as a word, as Unknown is, is empty; lines that are no record give none."""
    plain = F.regexp_replace(column, r'"nomenclature"\s*:\s*"[^"]*"', '"nomenclature":[]')
    return lines.select(F.from_json(plain, RECORD).alias("p")).filter("p.product_name is not null").select("p.*")


def load_registry(spark, path: str) -> DataFrame:
    return parse_registry(spark.read.text(path))


def by_name(registry: DataFrame, names: DataFrame) -> DataFrame:
    """Products of the given ``product_name``, in any letter case and without outer blanks."""
    return registry.join(names.select(F.lower(F.trim("product_name")).alias("_n")).distinct(), F.lower(F.trim("product_name")) == F.col("_n"), "left_semi")
