"""Files of several formats as blocks of one schema, read in parallel from their bytes.

Texts come as headings, paragraphs and list items, tables as grids and as rows by their style. What no library here can do, reading of PDF files and of
text in pictures, is passed in by ``Hooks``; without them such files are told as errors and pictures are left out.
"""

from __future__ import annotations

import csv
import io
import posixpath
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from pathlib import PurePosixPath
from typing import Any
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrystone.operators import cells
from quarrystone.operators.tables import Bold, Row, build_table, table_text

#: The extensions that are read.
EXTENSIONS = (".docx", ".pptx", ".xlsx", ".csv", ".md", ".markdown", ".txt", ".pdf", ".png", ".jpg", ".jpeg")
BLOCKS = (
    "path string, filename string, block_index int, type string, text string, raw string, section string, page_number int, slide_number int, method string, table_index int, grid array<array<string>>, style string, "
    "columns array<string>, rows array<struct<section:string,label:string,values:array<struct<name:string,value:string>>,options:array<string>>>, dropped array<string>, warnings array<string>"
)
_VALUE = pa.struct([("name", pa.string()), ("value", pa.string())])
_TEXTS = pa.list_(pa.string())
_KINDS = {
    "path": pa.string(), "filename": pa.string(), "block_index": pa.int32(), "type": pa.string(), "text": pa.string(), "raw": pa.string(), "section": pa.string(), "page_number": pa.int32(), "slide_number": pa.int32(), "method": pa.string(),
    "table_index": pa.int32(), "grid": pa.list_(_TEXTS), "style": pa.string(), "columns": _TEXTS,
    "rows": pa.list_(pa.struct([("section", pa.string()), ("label", pa.string()), ("values", pa.list_(_VALUE)), ("options", _TEXTS)])), "dropped": _TEXTS, "warnings": _TEXTS,
}
_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_MC = "{http://schemas.openxmlformats.org/markup-compatibility/2006}"
#: Least characters of a page that needs no reading of its picture; share of words that must come out; points of text as large as a heading.
PAGE_CHARS, WORD_SHARE, HEADING_POINTS = 20, 0.9, 13


@dataclass(frozen=True)
class Hooks:
    """What is passed in: ``ocr`` reads the text of a picture, ``pdf`` gives the text of each page and a way to its picture."""

    ocr: Callable[[bytes], str] | None = None
    pdf: Callable[[bytes], list[tuple[str, Callable[[], bytes]]]] | None = None


def clean(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def paragraph_type(text: str) -> str:
    """heading, list_item or paragraph by wording alone."""
    if len(text) <= 80 and text[-1:] not in ".,;:" and (text.isupper() or text.istitle()):
        return "heading"
    return "list_item" if re.match(r"^([-*•]|\d+[.)])\s", text) else "paragraph"


@dataclass
class _Blocks:
    """Blocks in order with the running section and the numbers of tables."""

    hooks: Hooks = field(default_factory=Hooks)
    rows: list[dict[str, Any]] = field(default_factory=list)
    section: str | None = None
    tables: int = 0
    slide: int | None = None
    page: int | None = None

    def text(self, kind: str, raw: str, opens: bool = True, **more: Any) -> None:
        """A text; a heading opens a section unless it only stands beside the text, as captions do."""
        text = clean(raw)
        if text:
            if kind == "heading" and opens:
                self.section = text
            self._add(kind, text=text, raw=raw, **more)

    def table(self, grid: list[list[str]], bold: Bold = frozenset(), section: str | None = None) -> None:
        width = max((len(r) for r in grid), default=0)
        grid = [[clean(c) for c in r] + [""] * (width - len(r)) for r in grid]
        kept = [i for i, r in enumerate(grid) if any(r)]
        if kept:
            place = {i: k for k, i in enumerate(kept)}
            made = build_table([grid[i] for i in kept], {(place[i], j) for i, j in bold if i in place})
            warnings = [f"long column name: {w[:40]}" for w in made["suspicious"]] + ([f"{len(made['dropped'])} cells left out"] if made["dropped"] else [])
            self._add(
                "table", grid=[grid[i] for i in kept], table_index=self.tables, section=section or self.section, warnings=warnings, text=table_text(made), style=made["style"], columns=made["columns"], dropped=made["dropped"],
                rows=[{"section": r.section, "label": r.label, "values": [{"name": k, "value": v} for k, v in r.values], "options": r.options} for r in made["rows"]],
            )
            self.tables += 1

    def picture(self, data: bytes, section: str | None) -> None:
        """The paragraphs of the text in a picture; it opens no section."""
        if self.hooks.ocr:
            for part in re.split(r"\n\s*\n", self.hooks.ocr(data)):
                self.text(paragraph_type(clean(part)), part, opens=False, method="ocr", section=section)

    def _add(self, kind: str, **more: Any) -> None:
        self.rows.append({"type": kind, "block_index": len(self.rows), "section": self.section, "slide_number": self.slide, "page_number": self.page, **more})


def _relations(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """Ids of the relations of a part, each with its kind and the part it leads to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in z.namelist():
        return {}
    return {r.get("Id") or "": ((r.get("Type") or "").rpartition("/")[2], posixpath.normpath(posixpath.join(folder, r.get("Target") or "")) if not (r.get("Target") or "").startswith("/") else (r.get("Target") or "")[1:]) for r in ElementTree.fromstring(z.read(path))}


def _w_text(p: ElementTree.Element) -> str:
    """A paragraph's own text, with its tabs and breaks, without that of text boxes in it."""
    out: list[str] = []

    def walk(e: ElementTree.Element) -> None:
        for c in e:
            if c.tag == f"{_W}t":
                out.append(c.text or "")
            elif c.tag == f"{_W}tab":
                out.append("\t")
            elif c.tag in (f"{_W}br", f"{_W}cr"):
                out.append("\n")
            elif c.tag not in (f"{_W}drawing", f"{_W}pict", f"{_MC}AlternateContent", f"{_W}pPr", f"{_W}rPr"):
                walk(c)

    walk(p)
    return "".join(out)


def _on(mark: ElementTree.Element | None) -> bool:
    return mark is not None and (mark.get(f"{_W}val") or "1").lower() not in ("0", "false", "off")


def _w_bold(runs: list[ElementTree.Element]) -> bool:
    said = [r for r in runs if _w_text(r).strip()]
    return bool(said) and all(_on(r.find(f"{_W}rPr/{_W}b")) for r in said)


def _w_kind(p: ElementTree.Element) -> str:
    named = p.find(f"{_W}pPr/{_W}pStyle")
    look = (named.get(f"{_W}val") or "").lower() if named is not None else ""
    if look.startswith("heading") or look == "title":
        return "heading"
    if "list" in look or p.find(f"{_W}pPr/{_W}numPr") is not None:
        return "list_item"
    runs = p.findall(f"{_W}r")
    sizes = [int(s.get(f"{_W}val") or 0) / 2 for r in runs if _w_text(r).strip() and (s := r.find(f"{_W}rPr/{_W}sz")) is not None]
    large = bool(sizes) and min(sizes) >= HEADING_POINTS
    return "heading" if 0 < len(_w_text(p).strip()) <= 100 and (_w_bold(runs) or large) else "paragraph"


def _w_grid(table: ElementTree.Element) -> tuple[list[list[str]], Bold]:
    """The grid of a table and its bold cells; merged cells repeat their text over what they cover."""
    grid: list[list[str]] = []
    bold: Bold = set()
    above: dict[int, tuple[str, bool]] = {}
    for i, tr in enumerate(table.findall(f"{_W}tr")):
        row: list[str] = []
        now: dict[int, tuple[str, bool]] = {}
        for tc in tr.findall(f"{_W}tc"):
            span = tc.find(f"{_W}tcPr/{_W}gridSpan")
            merge = tc.find(f"{_W}tcPr/{_W}vMerge")
            ps = tc.findall(f"{_W}p")
            said = ("\n".join(_w_text(p) for p in ps), _w_bold([r for p in ps for r in p.findall(f"{_W}r")]))
            if merge is not None and (merge.get(f"{_W}val") or "continue") == "continue":
                said = above.get(len(row), said)
            for _ in range(int(span.get(f"{_W}val") or 1) if span is not None else 1):
                if said[1]:
                    bold.add((i, len(row)))
                now[len(row)] = said
                row.append(said[0])
        above = now
        grid.append(row)
    return grid, bold


def _docx(data: bytes, out: _Blocks) -> None:
    z = zipfile.ZipFile(io.BytesIO(data))
    body = ElementTree.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    for item in body if body is not None else []:
        if item.tag == f"{_W}tbl":
            out.table(*_w_grid(item))
        elif item.tag == f"{_W}p":
            out.text(_w_kind(item), _w_text(item))
            # A text box stands there twice, in a new form and an old one: one of them is read.
            for either in item.iter(f"{_MC}AlternateContent"):
                source = either.find(f"{_MC}Choice")
                source = either.find(f"{_MC}Fallback") if source is None else source
                for box in source.iter(f"{_W}txbxContent") if source is not None else ():
                    for p in box.iter(f"{_W}p"):
                        out.text(_w_kind(p), _w_text(p), opens=False)
    for kind, target in _relations(z, "word/document.xml").values():
        if kind == "image" and target in z.namelist():
            out.picture(z.read(target), None)


def _a_text(p: ElementTree.Element) -> str:
    return "".join(e.text or "" if e.tag == f"{_A}t" else "\n" for e in p.iter() if e.tag in (f"{_A}t", f"{_A}br"))


def _a_bold(ps: list[ElementTree.Element]) -> bool:
    runs = [r for p in ps for r in p.findall(f"{_A}r") if _a_text(r).strip()]
    return bool(runs) and all((m := r.find(f"{_A}rPr")) is not None and m.get("b") in ("1", "true") for r in runs)


def _a_grid(table: ElementTree.Element) -> tuple[list[list[str]], Bold]:
    trs = [tr.findall(f"{_A}tc") for tr in table.findall(f"{_A}tr")]
    grid = [[""] * len(tr) for tr in trs]
    bold: Bold = set()
    for i, tr in enumerate(trs):
        for j, tc in enumerate(tr):
            if tc.get("hMerge") in ("1", "true") or tc.get("vMerge") in ("1", "true"):
                continue
            ps = list(tc.iter(f"{_A}p"))
            for k in range(i, min(len(trs), i + int(tc.get("rowSpan") or 1))):
                for m in range(j, min(len(trs[k]), j + int(tc.get("gridSpan") or 1))):
                    grid[k][m] = "\n".join(map(_a_text, ps))
                    if _a_bold(ps):
                        bold.add((k, m))
    return grid, bold


def _pptx(data: bytes, out: _Blocks) -> None:
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    if "ppt/presentation.xml" in z.namelist():
        leads = _relations(z, "ppt/presentation.xml")
        order = [leads[i][1] for s in ElementTree.fromstring(z.read("ppt/presentation.xml")).iter(f"{_P}sldId") if (i := s.get(f"{_R}id") or "") in leads]
        slides = [s for s in order if s in z.namelist()] or slides
    for k, name in enumerate(slides, 1):
        out.slide = k
        pictures = _relations(z, name)

        def shapes(tree: ElementTree.Element, pictures: dict[str, tuple[str, str]]) -> None:
            for shape in tree:
                if shape.tag == f"{_P}grpSp":
                    shapes(shape, pictures)
                elif shape.tag == f"{_P}graphicFrame":
                    for table in shape.iter(f"{_A}tbl"):
                        out.table(*_a_grid(table))
                elif shape.tag == f"{_P}pic":
                    blip = next(shape.iter(f"{_A}blip"), None)
                    target = pictures.get(blip.get(f"{_R}embed") or "", ("", ""))[1] if blip is not None else ""
                    if target in z.namelist():
                        out.picture(z.read(target), out.section)
                elif shape.tag == f"{_P}sp":
                    place = shape.find(f".//{_P}nvPr/{_P}ph")
                    title = place is not None and (place.get("type") or "").lower() in ("title", "ctrtitle")
                    for p in shape.iter(f"{_A}p"):
                        text = _a_text(p)
                        out.text("heading" if title or (_a_bold([p]) and len(clean(text)) <= 100) else "paragraph", text)

        tree = ElementTree.fromstring(z.read(name)).find(f".//{_P}spTree")
        if tree is not None:
            shapes(tree, pictures)


def _sheets(z: zipfile.ZipFile) -> list[tuple[str, str]]:
    """The sheets of a workbook in order: name and part, by the workbook's relations; by number where it has none."""
    book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    leads = _relations(z, "xl/workbook.xml")
    named = [(s.get("name") or "", leads.get(s.get(f"{_R}id") or "", ("", ""))[1]) for s in book.iter(f"{_S}sheet")]
    if named and all(part in z.namelist() for _, part in named):
        return named
    parts = sorted((n for n in z.namelist() if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    return list(zip([n for n, _ in named], parts, strict=False))


def _bold_styles(z: zipfile.ZipFile) -> set[int]:
    if "xl/styles.xml" not in z.namelist():
        return set()
    tree = ElementTree.fromstring(z.read("xl/styles.xml"))
    fonts = [(b := f.find(f"{_S}b")) is not None and b.get("val", "1") not in ("0", "false") for f in tree.findall(f"{_S}fonts/{_S}font")]
    return {k for k, x in enumerate(tree.findall(f"{_S}cellXfs/{_S}xf")) if (i := int(x.get("fontId") or 0)) < len(fonts) and fonts[i]}


def _grids(data: bytes) -> Iterator[tuple[str, dict[int, dict[int, tuple[str, bool]]]]]:
    """Each sheet with its cells that say something: text and whether it is bold, by row and column."""
    z = zipfile.ZipFile(io.BytesIO(data))
    shared = ["".join(t.text or "" for t in s.iter(f"{_S}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
    bold = _bold_styles(z)
    for name, part in _sheets(z):
        grid: dict[int, dict[int, tuple[str, bool]]] = {}
        for c in ElementTree.fromstring(z.read(part)).iter(f"{_S}c"):
            at = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r") or "")
            if not at:
                continue
            column = 0
            for letter in at[1]:
                column = column * 26 + ord(letter) - 64
            value = c.find(f"{_S}v")
            text = shared[int(value.text)] if c.get("t") == "s" and value is not None else "".join(t.text or "" for t in c.iter(f"{_S}t")) if c.get("t") == "inlineStr" else (value.text if value is not None else "")
            if clean(text):
                grid.setdefault(int(at[2]), {})[column] = (clean(text), int(c.get("s") or 0) in bold)
        yield name, grid


def _xlsx(data: bytes, out: _Blocks) -> None:
    for name, grid in _grids(data):
        if not grid:
            continue
        width = max(max(r) for r in grid.values())
        kept = sorted(grid)
        rows = [[grid[i].get(j, ("", False))[0] for j in range(1, width + 1)] for i in kept]
        gaps = [k > 0 and kept[k] > kept[k - 1] + 1 for k in range(len(kept))]
        for titles, body in cells.regions(rows, gaps):
            out.section = name
            for i in titles:
                out.text("heading", next(c for c in rows[i] if c))
            used = [j for j in range(width) if any(rows[i][j] for i in body)]
            out.table([[rows[i][j] for j in used] for i in body], {(k, m) for k, i in enumerate(body) for m, j in enumerate(used) if grid[kept[i]].get(j + 1, ("", False))[1]}, section=name)


def _csv(data: bytes, out: _Blocks) -> None:
    out.table([r for r in csv.reader(io.StringIO(data.decode("utf-8-sig", "replace")))])


def _markdown(data: bytes, out: _Blocks) -> None:
    table: list[list[str]] = []
    for line in [*data.decode("utf-8", "replace").splitlines(), ""]:
        s = line.strip()
        if s.startswith("|") and s.endswith("|") and len(s) > 1:
            row = [c.strip() for c in s[1:-1].split("|")]
            if not (len(table) == 1 and all(re.fullmatch(r":?-+:?", c) for c in row)):
                table.append(row)
            continue
        if table:
            out.table(table)
            table = []
        if m := re.match(r"^#{1,6}\s+(.*)$", s):
            out.text("heading", m[1])
        elif m := re.match(r"^(?:[-*+]|\d+[.)])\s+(.*)$", s):
            out.text("list_item", m[1])
        else:
            out.text("paragraph", s)


def _plain(data: bytes, out: _Blocks) -> None:
    for part in re.split(r"\n\s*\n", data.decode("utf-8", "replace")):
        if text := clean(part):
            out.text(paragraph_type(text), part)


def _pdf(data: bytes, out: _Blocks) -> None:
    """Pages by the hook; a page of hardly any text is read from its picture."""
    if out.hooks.pdf is None:
        raise ValueError("no reader for .pdf is passed in")
    for k, (text, picture) in enumerate(out.hooks.pdf(data), 1):
        out.page = k
        method = None
        if len(text.strip()) < PAGE_CHARS and out.hooks.ocr:
            text, method = out.hooks.ocr(picture()), "ocr"
        for part in re.split(r"\n\s*\n", text):
            out.text(paragraph_type(clean(part)), part, method=method)


def _image(data: bytes, out: _Blocks) -> None:
    if out.hooks.ocr is None:
        raise ValueError("no reader for pictures is passed in")
    out.picture(data, None)


READERS = {".docx": _docx, ".pptx": _pptx, ".xlsx": _xlsx, ".csv": _csv, ".md": _markdown, ".markdown": _markdown, ".txt": _plain, ".pdf": _pdf, ".png": _image, ".jpg": _image, ".jpeg": _image}


def parse(name: str, data: bytes, hooks: Hooks | None = None) -> list[dict[str, Any]]:
    """The blocks of one file; a suffix that isn't read raises ValueError."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in READERS:
        raise ValueError(f"no reader for {suffix or name}")
    out = _Blocks(hooks or Hooks())
    READERS[suffix](data, out)
    return out.rows


def as_batch(rows: list[dict[str, Any]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], k) for n, k in _KINDS.items()], list(_KINDS))


def parse_files(files: DataFrame, hooks: Hooks | None = None) -> DataFrame:
    """Blocks of ``files(path, content)``. Lock files are left out; a broken file gives one row of type error, one of which words get lost a warning."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                name = PurePosixPath(path).name
                if name.startswith("~$"):
                    continue
                try:
                    found = parse(name, data, hooks)
                    share = word_coverage(name, data, found)
                    if found and share is not None and share < WORD_SHARE:
                        found[0]["warnings"] = [*found[0].get("warnings", []), f"only {share:.0%} of the words came out"]
                except Exception as e:  # one bad file must not end the job
                    found = [{"type": "error", "block_index": 0, "text": str(e)[:200]}]
                yield as_batch([{"warnings": [], **r, "path": path, "filename": name} for r in found])

    return files.select("path", "content").mapInArrow(run, BLOCKS)


def read_blocks(spark: SparkSession, folder: str, hooks: Hooks | None = None) -> DataFrame:
    """Blocks of the files of a folder; other suffixes are left out. Of PDF files and pictures only with ``hooks``."""
    suffixes = [x[1:] for x in EXTENSIONS if x not in (".pdf", ".png", ".jpg", ".jpeg") or (hooks is not None and (hooks.pdf if x == ".pdf" else hooks.ocr))]
    return parse_files(spark.read.format("binaryFile").option("pathGlobFilter", f"*.{{{','.join(suffixes)}}}").load(folder), hooks)


def _raw_words(name: str, data: bytes) -> int | None:
    """Words of a file counted apart from its blocks: from the characters of its parts."""
    suffix = PurePosixPath(name).suffix.lower()
    count = lambda text: len(re.findall(r"\w+", text))
    if suffix in (".txt", ".md", ".markdown", ".csv"):
        return count(data.decode("utf-8-sig", "replace"))
    if suffix == ".docx":
        root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
        old = {id(p) for f in root.iter(f"{_MC}Fallback") for p in f.iter(f"{_W}p")}
        return sum(count(_w_text(p)) for p in root.iter(f"{_W}p") if id(p) not in old)
    if suffix == ".pptx":
        z = zipfile.ZipFile(io.BytesIO(data))
        return sum(count(_a_text(p)) for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n) for p in ElementTree.fromstring(z.read(n)).iter(f"{_A}p"))
    if suffix == ".xlsx":
        return sum(count(text) for _, grid in _grids(data) for r in grid.values() for text, _ in r.values())
    return None


def word_coverage(name: str, data: bytes, blocks: list[dict[str, Any]] | None = None) -> float | None:
    """Words of the blocks as a share of the words of the file; None for formats that are not counted and files without words."""
    raw = _raw_words(name, data)
    if not raw:
        return None
    words = lambda text: len(re.findall(r"\w+", text or ""))
    kept = sum(sum(words(c) for r in b["grid"] for c in r) if b.get("grid") else words(b.get("text")) for b in (parse(name, data) if blocks is None else blocks))
    return kept / raw


def documents(blocks: DataFrame) -> DataFrame:
    """``(path, filename, text, warnings, blocks)``: one row a file that could be read; a file's blocks came from one row and make one again."""
    kept = blocks.filter("type <> 'error'")
    item = F.struct("block_index", *[c for c in blocks.columns if c not in ("path", "filename", "block_index", "warnings")])
    grouped = kept.groupBy("path", "filename").agg(F.array_sort(F.collect_list(F.struct("block_index", "text"))).alias("texts"), F.array_sort(F.collect_list(item), lambda a, b: a["block_index"] - b["block_index"]).alias("blocks"), F.flatten(F.collect_list("warnings")).alias("warnings"))
    return grouped.select("path", "filename", F.array_join(F.transform("texts", lambda t: t["text"]), "\n").alias("text"), "warnings", "blocks")


__all__ = ["BLOCKS", "Hooks", "Row", "documents", "parse", "parse_files", "read_blocks", "word_coverage"]
