"""Packing of document blocks into word chunks, and the index of chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a chunk, of the overlap, looked ahead for a sentence's end, and of the shortest chunk.
SIZE, OVERLAP, AHEAD, LEAST = 50, 10, 10, 10


def ends_sentence(word: str) -> bool:
    """Whether a word closes a sentence: with a full stop or semicolon, inside one closing mark at most."""
    return word[-1:] in (".", ";") or (word[-1:] in ("'", '"', ")", "]") and word[-2:-1] in (".", ";"))


def windows(words: list[str], size: int = SIZE, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """Spans of an oversized block: each ends behind a sentence's end up to ``AHEAD`` words on, else hard."""
    spans, start = [], 0
    while start < len(words):
        end = min(start + size, len(words))
        if end < len(words):
            end = next((k + 1 for k in range(end, min(end + AHEAD, len(words))) if ends_sentence(words[k])), end)
        if spans and end - start < LEAST:
            spans[-1] = (spans[-1][0], end)
        else:
            spans.append((start, end))
        if end >= len(words):
            break
        start = max(end - overlap, start + 1)
    return spans


def pack(blocks: list[tuple[Any, str]], size: int = SIZE, overlap: int = OVERLAP, same: Callable[[Any], Any] = lambda s: s) -> list[tuple[Any, str]]:
    """Chunks ``(section, text)`` of blocks ``(section, text)`` in order; sections are the same if ``same`` of them is.

    Blocks of one section are packed whole up to ``size`` words; larger ones are cut into windows. Chunks of fewer than ``LEAST`` words go in front
    of the next one, the last such one behind the one before; a chunk has the section of its first word.
    """
    raw: list[tuple[Any, list[str]]] = []
    open_section, open_words = None, []

    def close() -> None:
        if open_words:
            raw.append((open_section, list(open_words)))
            open_words.clear()

    last: Any = object()
    for section, text in blocks:
        words = (text or "").split()
        if not words:
            continue
        if same(section) != last:
            close()
            last = same(section)
        if len(words) > size:
            close()
            raw.extend((section, words[s:e]) for s, e in windows(words, size, overlap))
            continue
        if len(open_words) + len(words) > size:
            close()
        if not open_words:
            open_section = section
        open_words.extend(words)
    close()
    out: list[tuple[Any, list[str]]] = []
    carry: tuple[Any, list[str]] | None = None
    for section, words in raw:
        if carry:
            section, words, carry = carry[0], carry[1] + words, None
        if len(words) < LEAST:
            carry = (section, words)
        else:
            out.append((section, words))
    if carry:
        if out:
            out[-1] = (out[-1][0], out[-1][1] + carry[1])
        else:
            out.append(carry)
    return [(s, " ".join(w)) for s, w in out]


def chunk_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """``(doc_id, chunk_index, total_chunks, chunk_id, text)`` of texts whose blocks are their lines.

    Null and blank texts give no chunk. A document is cut in its own row, so none is gathered from others and nothing is shuffled.
    """
    src = documents.select(F.col(id_col).alias("doc_id"), (F.col(title_col) if title_col else F.lit(None).cast("string")).alias("title"), F.col(text_col).alias("text")).filter("text is not null")
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, index, total, text = [], [], [], []
            for doc, title, body in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                pieces = pack([(None, line) for line in body.split("\n")], size, overlap)
                for k, (_, t) in enumerate(pieces):
                    ids.append(doc)
                    index.append(k)
                    total.append(len(pieces))
                    text.append(f"{title}: {t}" if title and title.strip() else t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(index, pa.int32()), pa.array(total, pa.int32()), pa.array(text, pa.string())], ["doc_id", "chunk_index", "total_chunks", "text"])

    out = src.mapInArrow(run, f"doc_id {kind}, chunk_index int, total_chunks int, text string")
    return out.select("doc_id", "chunk_index", "total_chunks", content_id(F.col("text")).alias("chunk_id"), "text")


CHUNKS = "document_name string, product_name string, chunk_index int, total_chunks int, page_number int, slide_number int, section_heading string, text string"


def chunk_blocks(documents: DataFrame, names: DataFrame, size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """Chunks ``(chunk_id, document_name, product_name, chunk_index, total_chunks, page_number, slide_number, section_heading, text)`` of documents of blocks.

    Each heading's section and each table is packed for itself; a chunk has the section, page and slide of its first block, and its text begins with the
    product's name. ``names`` has ``(document_name, product_name)``; a document without one has its file's. A document is cut in its own row.
    """
    name = F.coalesce("product_name", F.regexp_replace("filename", r"\.[^.]*$", ""))
    block = lambda b: F.struct(*[b[c].alias(c) for c in ("type", "section", "page_number", "slide_number", "text")])
    src = documents.join(names.withColumnRenamed("document_name", "filename"), "filename", "left").select("filename", name.alias("product_name"), F.transform("blocks", block).alias("blocks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = ["document_name", "product_name", "chunk_index", "total_chunks", "page_number", "slide_number", "section_heading", "text"]
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string()]
        for batch in batches:
            rows: list[tuple] = []
            for file, product, blocks in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                # A table is a unit of its own, also between two texts of one section.
                units = [((k if b["type"] == "table" else -1, b["section"], b["page_number"], b["slide_number"]), b["text"]) for k, b in enumerate(blocks or [])]
                pieces = pack(units, size, overlap, same=lambda u: u[:2])
                rows += [(file, product, k, len(pieces), u[2], u[3], u[1], f"{product}: {t}") for k, (u, t) in enumerate(pieces)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], fields)

    return src.mapInArrow(run, CHUNKS).select(content_id(F.col("text")).alias("chunk_id"), *[f.split()[0] for f in CHUNKS.split(", ")])


def content_id(text: Column) -> Column:
    return F.sha2(text, 256)


def valid(chunks: DataFrame) -> DataFrame:
    return chunks.filter(F.trim(F.regexp_replace("text", r"(?U)\s+", " ")) != "")


def first_of_content(chunks: DataFrame, order: str = "row_id") -> DataFrame:
    """The first row of every text, by aggregation, so that a text that is a third of all rows is reduced map-side."""
    columns = [c for c in chunks.columns]
    kept = valid(chunks).withColumn("content", content_id(F.col("text")))
    return kept.groupBy("content").agg(F.min_by(F.struct(*columns), F.col(order)).alias("r")).select("content", "r.*")


def upserted(chunks: DataFrame, key: str = "chunk_id", when: str = "loaded_at", tie: str = "row_id") -> DataFrame:
    """The last delivery of every chunk."""
    columns = [c for c in chunks.columns if c != key]
    return valid(chunks).groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(when, tie)).alias("r")).select(key, "r.*")
