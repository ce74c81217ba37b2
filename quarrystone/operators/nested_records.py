"""Flat child tables of deeply nested records, linked to record and parent by position.

The JSON texts of an Arrow batch become arrays of nodes by kernels over their bytes (``json_nodes``); no record is
decoded or walked on its own. Keys, envelopes and lone or blank elements are told for the whole batch at once. A child table is then
the flat values of a list array over nodes: its parents come from the list's
offsets by the parent-index kernel, positions are the distance from the offset, and keys travel down by take.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.json_nodes import _SPACE, OPEN, STRING, Nodes, says

#: The child rows' columns.
CHILD_SCHEMA = "src_field string, record_id bigint, child string, pos1 bigint, pos2 bigint, pos3 bigint"
#: Names of members, each as the records write it, the first one present counts.
NAMES = {
    "priority": ["customer_priorities", "customerPriorities", "confirmed_priorities", "confirmedPriorities"],
    "candidate": ["candidate_products", "candidateProducts"],
    "source": ["sources"],
    "comparison": ["comparison"],
    "point": ["right_to_win", "rightToWin"],
    "answers": ["answers"],
    "questions": ["questions"],
    "follow_ups": ["follow_ups", "followUps"],
    "evidence": ["evidence"],
    "text": ["text"],
}
#: A record may be encoded so many times.
ENCODED = 4
_RULE = rf"^[{_SPACE}|:+=\-]*-[{_SPACE}|:+=\-]*$"


class _Child:
    """The elements of a list array with the keys of their parents."""

    def __init__(self, lists: pa.ListArray, keys: list[pa.Array]):
        parent = pc.list_parent_indices(lists)
        at = parent.to_numpy(zero_copy_only=False).astype(np.int64)
        starts = lists.offsets.to_numpy(zero_copy_only=False)[at] - lists.offsets[0].as_py()
        self.nodes = lists.flatten().to_numpy(zero_copy_only=False)
        self.keys = [k.take(parent) for k in keys] + [pa.array(np.arange(len(at)) - starts + 1, pa.int64())]


def _numbered(groups: np.ndarray) -> np.ndarray:
    """Places from 1 on inside runs of equal numbers."""
    fresh = np.concatenate([[True], groups[1:] != groups[:-1]]) if len(groups) else np.empty(0, bool)
    at = np.arange(len(groups))
    return at - np.maximum.accumulate(np.where(fresh, at, 0)) + 1 if len(groups) else at


class _Flat:
    """The child tables of the records of one array of nodes."""

    def __init__(self, nodes: Nodes, form: str):
        self.nodes = nodes
        self.members = nodes.named(sorted({n for ns in NAMES.values() for n in ns} | {"data", "attributes", form}))
        records = nodes.root.copy()
        for step in ("data", "attributes", form):
            under = self.members[step][records]
            records = np.where((under >= 0) & (nodes.kind[under] == OPEN), under, records) if len(nodes.kind) else records
        objects = records >= 0
        if len(nodes.kind):
            objects &= nodes.kind[records] == OPEN
        self.rows = np.flatnonzero(objects)
        self.records = records[objects]

    def member(self, owners: np.ndarray, field: str) -> np.ndarray:
        """The member of each node under one of a field's names, -1 where it has none or is no object."""
        out = np.full(len(owners), -1, np.int64)
        for name in NAMES[field]:
            out = np.where(out >= 0, out, self.members[name][owners])
        return out

    def said(self, found: np.ndarray) -> np.ndarray:
        return self.nodes.leaf_count(found) > 0

    def tables(self) -> Iterator[tuple[str, list[pa.Array]]]:
        """``(child, keys)``: of every child that says something, the row of its record and its positions."""
        n, row = self.nodes, pa.array(self.rows)
        keep = lambda child, mask: [k.filter(pa.array(mask)) for k in child.keys]
        for name in ("priority", "candidate", "source"):
            child = _Child(n.lists(self.member(self.records, name)), [row])
            yield name, keep(child, self.said(child.nodes))
        yield from self._comparison(row)
        points = _Child(n.lists(self.member(self.records, "point")), [row])
        yield "point", keep(points, self.said(points.nodes))
        questions = _Child(n.lists(self.member(points.nodes, "questions")), points.keys)
        # A question is an object with a text, or the text itself.
        objects = n.kind[questions.nodes] == OPEN if len(questions.nodes) else np.empty(0, bool)
        wording = np.where(objects, self.member(questions.nodes, "text"), questions.nodes)
        known = self.said(wording)
        asked = keep(questions, known)
        yield "question", asked
        follow = _Child(n.lists(self.member(questions.nodes, "follow_ups")), questions.keys)
        yield "follow_up", keep(follow, self.said(follow.nodes))
        yield "answer", self._answers(row, asked, n.text(n.first_leaf(wording[known])))

    def _answers(self, row: pa.Array, asked: list[pa.Array], wording: pa.Array) -> list[pa.Array]:
        """Answers take the positions of the question of their record that their key repeats; the last one of a key counts."""
        n = self.nodes
        answers = _Child(n.lists(self.member(self.records, "answers"), (OPEN,), lone=False), [row])
        label = lambda r, t: pc.binary_join_element_wise(r.cast(pa.string()), t, "\x00")
        keyed = label(answers.keys[0], n.text(n.key[answers.nodes]))
        codes = keyed.dictionary_encode().indices.to_numpy(zero_copy_only=False) if len(keyed) else np.empty(0, np.int64)
        last = np.full(len(keyed) + 1, -1, np.int64)
        last[codes] = np.arange(len(codes))
        place = pc.index_in(keyed, value_set=label(asked[0], wording))
        said = pa.array(np.asarray(place.is_valid(), bool) & self.said(answers.nodes) & (last[codes] == np.arange(len(codes))))
        place = place.filter(said)
        return [answers.keys[0].filter(said), asked[1].take(place), asked[2].take(place)]

    def _comparison(self, row: pa.Array) -> Iterator[tuple[str, list[pa.Array]]]:
        """Rows of the comparison and their evidence; a text table loses its heading and rule lines."""
        n = self.nodes
        lists = n.lists(self.member(self.records, "comparison"))
        items = _Child(lists, [row])
        owner = pc.list_parent_indices(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        plain = n.kind[items.nodes] == STRING if len(items.nodes) else np.empty(0, bool)
        lined = plain | n.null[items.nodes] if len(items.nodes) else plain
        sizes = np.bincount(owner, minlength=len(row))
        texts = np.bincount(owner[lined], minlength=len(row)) == sizes  # nothing but texts and nulls
        of_text = texts[owner]
        # Lines: of a single text with line feeds its own, else the texts themselves.
        here = np.flatnonzero(of_text)
        said = n.text(np.where(plain[here], items.nodes[here], -1))
        broken = np.asarray(pc.fill_null(pc.match_substring(said, "\n"), False), bool) & (sizes[owner[here]] == 1)
        parts = pc.split_pattern(pc.fill_null(said, ""), "\n")
        single = pa.ListArray.from_arrays(pa.array(np.arange(len(said) + 1), pa.int32()), pc.fill_null(said, ""))
        both = pa.concat_arrays([parts.filter(pa.array(broken)), single.filter(pa.array(~broken))])
        table = np.concatenate([owner[here][broken], owner[here][~broken]])[pc.list_parent_indices(both).to_numpy(zero_copy_only=False)] if len(both) else np.empty(0, np.int64)
        lines = both.flatten()
        order = np.argsort(table, kind="stable")
        table, lines = table[order], lines.take(pa.array(order))
        rule = np.asarray(pc.match_substring_regex(lines, _RULE), bool)
        ruled = np.cumsum(rule)
        first = np.searchsorted(table, table)  # where each line's table begins
        ahead = ruled - np.concatenate([[0], ruled])[first]  # rules of its table up to a line
        has = np.bincount(table[rule], minlength=len(row)) > 0
        kept = np.where(has[table], (ahead > 0) & ~rule, True)
        table, blank = table[kept], ~says(lines)[kept]
        pos = _numbered(table)
        yield "comparison_row", [row.take(pa.array(table[~blank])), pa.array(pos[~blank], pa.int64())]
        # Other comparisons: their elements, which say something besides their evidence.
        rest = np.flatnonzero(~of_text)
        found = items.nodes[rest]
        keys = [k.take(pa.array(rest)) for k in items.keys]
        evidence = self.member(found, "evidence")
        speaks = pa.array(n.leaf_count(found) > n.leaf_count(evidence))
        yield "comparison_row", [k.filter(speaks) for k in keys]
        proofs = _Child(n.lists(evidence), keys)
        yield "evidence", [k.filter(pa.array(self.said(proofs.nodes))) for k in proofs.keys]


def flatten(ids: pa.Array, texts: pa.Array, src_field: str, form: str) -> Iterator[pa.RecordBatch]:
    """The child tables of a batch of records; a record may be encoded more than once."""
    for _ in range(ENCODED):
        if not len(texts):
            return
        nodes = Nodes(texts)
        flat = _Flat(nodes, form)
        for name, keys in flat.tables():
            count = len(keys[0])
            zero = pa.array(np.zeros(count, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array([src_field] * count, pa.string()), ids.take(keys[0]), pa.array([name] * count, pa.string()), *[*keys[1:], zero, zero, zero][:3]], ["src_field", "record_id", "child", "pos1", "pos2", "pos3"])
        again = np.flatnonzero((nodes.root >= 0) & (nodes.kind[nodes.root] == STRING)) if len(nodes.kind) else np.empty(0, np.int64)
        ids, texts = ids.take(pa.array(again)), nodes.text(nodes.root[again])


def _parts(batches: Iterator[pa.RecordBatch], rows: int = 2000, most: int = 32_000_000) -> Iterator[pa.RecordBatch]:
    """Parts of at most ``rows`` rows and, unless a single row has more, ``most`` bytes."""
    for batch in batches:
        at = 0
        while at < batch.num_rows:
            part = batch.slice(at, rows)
            size = np.cumsum(np.asarray(pc.binary_length(part.column(1)), np.int64))
            n = max(1, int(np.searchsorted(size, most, "right")))
            yield part.slice(0, n)
            at += min(n, part.num_rows)


def child_rows(rows: DataFrame, id_col: str, text_col: str, src_field: str, form: str) -> DataFrame:
    """The child rows of one JSON column; ``form`` names the key an envelope may hold the record under.

    Children: priority, candidate, source, comparison_row, evidence, point, question, follow_up, answer. Positions
    count from 1 as stored and are 0 where unused; null and blank elements give no row but keep their position; a
    lone element is an array of one. Null, blank and incomplete texts and texts of other shapes give no row; of members of one name the last counts. Rows
    repeated under one id give each child once: the small child rows are made distinct, not the texts,
    and map-side first, so that an id repeated often does not gather in one task.
    """
    src = rows.select(F.col(id_col).cast("bigint").alias("record_id"), F.col(text_col).cast("string").alias("text")).filter(F.col("text").isNotNull() & F.col("record_id").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _parts(batches):
            yield from flatten(part.column(0), part.column(1), src_field, form)

    return src.mapInArrow(run, CHILD_SCHEMA).distinct()
