"""Generated replies as records: sections, points, outcomes, questions, tables."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.operators.cells import sections

#: Headers of the replies and the three outcomes.
POINT = "Right to Win"
POINT_PARTS = ["Why It Matters", "Evidence", "Questions"]
ADVICE = ["Confirmed Priorities", "Outcome", "Product", "Candidate Products", "Recommendation", "Missing Information"]
AID = ["Customer Priorities", "Title", "Use Case Framing", "Comparison", "Customer Summary"]
OUTCOMES = {"recommend": "Recommend", "trade-offs": "Trade-offs", "insufficient": "Insufficient"}
_ITEM = re.compile(r"^\s*(?:[-*•]|\d+[.)])\s+(.*\S)\s*$")


def items(block: str) -> list[str]:
    """Bulleted and numbered lines of a block, each once in any letter case."""
    out: dict[str, str] = {}
    for line in block.split("\n"):
        if m := _ITEM.match(line):
            out.setdefault(m[1].lower(), m[1])
    return list(out.values())


def lines(block: str) -> list[str]:
    return [x.strip() for x in block.split("\n") if x.strip()]


def points(text: str) -> list[dict]:
    """Title, why, evidence and questions of every point of a discovery reply."""
    out = []
    parts = re.split(rf"^{POINT}:[ \t]*", text or "", flags=re.M)[1:]
    for part in parts:
        title, _, rest = part.partition("\n")
        found = sections(rest, POINT_PARTS, inline=True)
        out.append({"title": title.strip(), "why": found.get("why it matters", ""), "evidence": found.get("evidence", ""), "questions": items(found.get("questions", ""))})
    return [p for p in out if p["title"]]


def advice(text: str) -> dict:
    """A recommendation reply: its outcome by exact label, the product only where it recommends, candidates only where it weighs."""
    found = sections(text or "", ADVICE)
    said = re.sub(r"[^a-z\-]+", "", found.get("outcome", "").lower())
    outcome = OUTCOMES.get(said, "Insufficient")
    names = [x.strip() for x in re.split(r"[,\n]", found.get("candidate products", "")) if x.strip()]
    return {
        "priorities": items(found.get("confirmed priorities", "")), "outcome": outcome, "product": found.get("product", "") if outcome == "Recommend" else "",
        "candidates": [re.sub(r"^[-*•]\s+", "", n) for n in names] if outcome == "Trade-offs" else [], "recommendation": found.get("recommendation", ""), "missing": found.get("missing information", ""),
    }


def aid(text: str) -> dict:
    """A sales aid reply with the data rows of its table."""
    found = sections(text or "", AID)
    table = [[c.strip() for c in x.strip("|").split("|")] for x in lines(found.get("comparison", "")) if "|" in x]
    table = [r for r in table if not all(re.fullmatch(r":?-+:?", c) for c in r)]
    return {"priorities": items(found.get("customer priorities", "")), "title": found.get("title", ""), "framing": found.get("use case framing", ""), "table": table, "summary": found.get("customer summary", "")}


def questions(text: str, missing: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """``(field, question)`` for every missing field ``(field, default question)``: the reply's or the default one."""
    said = {}
    for part in re.split(r"^Field:[ \t]*", text or "", flags=re.M)[1:]:
        key, _, rest = part.partition("\n")
        found = sections(rest, ["Question"], inline=True).get("question", "")
        if found:
            said[key.strip().lower()] = found.split("\n")[0].strip()
    return [(f, said.get(f, default)) for f, default in missing]


def declined(text: str | None) -> str | None:
    """A customer wording, or None where the reply says that there is none: blank, or one of these words alone at its start."""
    said = (text or "").strip()
    return None if not said or re.match(r"^(?:not requested|n/?a|none|omit(?:ted)?)\b\s*(?:[.:\-–]|$)", said, re.I) else said


def parse_points(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, pos, title, why, evidence, questions)`` of a table of discovery replies."""
    src = replies.select(F.col(id_col).cast("bigint").alias("id"), text_col)
    kind = "id bigint, pos int, title string, why string, evidence string, questions array<string>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i, k, p) for i, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k, p in enumerate(points(t or ""), 1)]
            text = lambda n: pa.array([p[n] for _, _, p in rows], pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()), text("title"), text("why"), text("evidence"), pa.array([p["questions"] for _, _, p in rows], pa.list_(pa.string()))], ["id", "pos", "title", "why", "evidence", "questions"])

    return src.mapInArrow(run, kind)


def _parsed(replies: DataFrame, id_col: str, text_col: str, kind: str, read) -> DataFrame:
    """``id`` and the fields of ``kind`` of what ``read`` makes of each text."""
    src = replies.select(F.col(id_col).cast("bigint").alias("id"), text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [read(t or "") for t in batch.column(1).to_pylist()]
            names = [f.split()[0] for f in kind.split(", ")]
            kinds = {"string": pa.string(), "array<string>": pa.list_(pa.string()), "array<array<string>>": pa.list_(pa.list_(pa.string()))}
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([x[n] for x in found], kinds[f.split()[1]]) for n, f in zip(names, kind.split(", "), strict=True))], ["id", *names])

    return src.mapInArrow(run, f"id bigint, {kind}")


def parse_advice(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, priorities, outcome, product, candidates, recommendation, missing)`` of a table of recommendation replies."""
    return _parsed(replies, id_col, text_col, "priorities array<string>, outcome string, product string, candidates array<string>, recommendation string, missing string", advice)


def parse_aids(replies: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, priorities, title, framing, table, summary)`` of a table of sales aid replies."""
    return _parsed(replies, id_col, text_col, "priorities array<string>, title string, framing string, table array<array<string>>, summary string", aid)


def parse_questions(replies: DataFrame, id_col: str, text_col: str, missing: list[tuple[str, str]]) -> DataFrame:
    """``(id, fields, questions)``: for every missing field the reply's question or the default one."""
    return _parsed(replies, id_col, text_col, "fields array<string>, questions array<string>", lambda t: dict(zip(("fields", "questions"), map(list, zip(*questions(t, missing), strict=True)), strict=True)))
