"""Documents of headings, paragraphs and tables as bytes of a DOCX file."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

_NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
_TYPES = '<?xml version="1.0"?><Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/></Types>'
_RELS = '<?xml version="1.0"?><Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="http://schemas.openxmlformats.org/officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/></Relationships>'
#: Kinds of items and the styles they are written in.
STYLES = {"title": "Title", "heading": "Heading2", "list_item": "ListBullet", "paragraph": ""}


def _legal(text: str) -> str:
    """The text without characters that XML may not hold."""
    return "".join(c for c in text if c in "\t\n\r" or " " <= c < "\ud800" or "" <= c < "￾" or c >= "\U00010000")


def _run(text: str, bold: bool = False) -> str:
    look = "<w:rPr><w:b/></w:rPr>" if bold else ""
    parts = []
    for k, line in enumerate(_legal(text).split("\n")):
        if k:
            parts.append("<w:br/>")
        parts.append("<w:tab/>".join(f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in line.split("\t")))
    return f"<w:r>{look}{''.join(parts)}</w:r>"


def write_docx(items: list[tuple[str, str | list[list[str]]]]) -> bytes:
    """A file of items in order: ``(kind, text)`` and ``("table", grid)``; the first row of a table is bold."""
    body = []
    for kind, content in items:
        if kind == "table":
            rows = "".join("<w:tr>" + "".join(f"<w:tc><w:p>{_run(c, i == 0)}</w:p></w:tc>" for c in row) + "</w:tr>" for i, row in enumerate(content))
            body.append(f"<w:tbl>{rows}</w:tbl>")
        else:
            style = STYLES[kind]
            look = f'<w:pPr><w:pStyle w:val="{style}"/></w:pPr>' if style else ""
            body.append(f"<w:p>{look}{_run(str(content))}</w:p>")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("[Content_Types].xml", _TYPES)
        z.writestr("_rels/.rels", _RELS)
        z.writestr("word/document.xml", f'<?xml version="1.0" encoding="UTF-8"?><w:document {_NS}><w:body>{"".join(body)}</w:body></w:document>')
    return out.getvalue()


def docx_files(items: DataFrame) -> DataFrame:
    """``(path, content)`` of rows ``(path, items array<struct<kind, text, grid>>)``; one row is one file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            files = [write_docx([(x["kind"], x["grid"] if x["kind"] == "table" else x["text"] or "") for x in given or []]) for given in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(files, pa.binary())], ["path", "content"])

    return items.select("path", "items").mapInArrow(run, "path string, content binary")
