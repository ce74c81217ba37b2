"""The nodes of JSON texts against the standard decoder, and child tables against a walk over decoded records."""

import json
import random
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrystone.functions.json_nodes import Nodes
from quarrystone.operators.nested_records import flatten

LEAVES = st.none() | st.booleans() | st.integers(-5, 10**12) | st.floats(allow_nan=False, allow_infinity=False) | st.text(max_size=6) | st.sampled_from(["", " ", "\n", 'q"\\', "a\nb", "é ", "|-|"])
VALUES = st.recursive(LEAVES, lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=12)


def is_json(text):
    try:
        json.loads(text)
    except (ValueError, RecursionError):
        return False
    return True


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(VALUES, st.booleans(), st.integers(0, 200), st.sampled_from('{}[],:"\\ 1ntu\n\t-.é')), min_size=1, max_size=12))
def test_whole_texts_are_told(items):
    texts = []
    for value, ascii_, at, mark in items:
        t = json.dumps(value, ensure_ascii=ascii_, indent=1 if at % 3 == 0 else None)
        texts += [t, t[: at % (len(t) + 1)], t[: at % (len(t) + 1)] + mark + t[at % (len(t) + 1) :], t.replace("\\u", "\\x")]
    texts = [t.encode("utf-8", "replace").decode() for t in texts]
    assert Nodes(pa.array(texts)).whole.tolist() == [is_json(t) for t in texts]


@settings(max_examples=60, deadline=None)
@given(st.lists(VALUES, min_size=1, max_size=8))
def test_leaves_are_counted(values):
    def leaves(x):
        if isinstance(x, dict):
            return sum(map(leaves, x.values()))
        if isinstance(x, list):
            return sum(map(leaves, x))
        return int(x is not None and (not isinstance(x, str) or bool(x.strip())))

    nodes = Nodes(pa.array([json.dumps(v) for v in values]))
    assert nodes.leaf_count(nodes.root).tolist() == [leaves(v) for v in values]


def walk(text, form):
    """The children of one record, element by element."""
    value = text
    for _ in range(4):
        if isinstance(value, str):
            if not is_json(value):
                return set()
            value = json.loads(value)
    for step in ("data", "attributes", form):
        if isinstance(value, dict) and isinstance(value.get(step), dict):
            value = value[step]
    if not isinstance(value, dict):
        return set()
    pick = lambda x, *names: next((x[n] for n in names if n in x), None) if isinstance(x, dict) else None
    many = lambda x: x if isinstance(x, list) else [] if x is None else [x]

    def said(x):
        if isinstance(x, dict):
            return any(map(said, x.values()))
        if isinstance(x, list):
            return any(map(said, x))
        return bool(x.strip()) if isinstance(x, str) else x is not None

    out = set()
    lists = {"priority": ("customer_priorities", "customerPriorities", "confirmed_priorities", "confirmedPriorities"), "candidate": ("candidate_products", "candidateProducts"), "source": ("sources",)}
    for child, names in lists.items():
        out |= {(child, k, 0, 0) for k, x in enumerate(many(pick(value, *names)), 1) if said(x)}
    rows = many(value.get("comparison"))
    if len(rows) == 1 and isinstance(rows[0], str) and "\n" in rows[0]:
        rows = rows[0].split("\n")
    rule = lambda x: bool(x and re.fullmatch(r"[\s|:+=\-]*-[\s|:+=\-]*", x))
    if rows and all(isinstance(x, str) or x is None for x in rows) and any(map(rule, rows)):
        at = next(k for k, x in enumerate(rows) if rule(x))
        rows = [x for x in rows[at + 1 :] if not rule(x)]
    for k, x in enumerate(rows, 1):
        if said({a: b for a, b in x.items() if a != "evidence"} if isinstance(x, dict) else x):
            out.add(("comparison_row", k, 0, 0))
        out |= {("evidence", k, j, 0) for j, e in enumerate(many(pick(x, "evidence")), 1) if said(e)}
    places = {}
    for i, p in enumerate(many(pick(value, "right_to_win", "rightToWin")), 1):
        if said(p):
            out.add(("point", i, 0, 0))
        for j, q in enumerate(many(pick(p, "questions")), 1):
            words = q.get("text") if isinstance(q, dict) else q
            if said(words):
                out.add(("question", i, j, 0))
                if isinstance(words, str):
                    places.setdefault(words, (i, j))
            out |= {("follow_up", i, j, k) for k, f in enumerate(many(pick(q, "follow_ups", "followUps")), 1) if said(f)}
    answers = value.get("answers")
    for q, a in answers.items() if isinstance(answers, dict) else ():
        if said(a) and q in places:
            out.add(("answer", *places[q], 0))
    return out


TEXT = st.sampled_from(["", " ", "a", "b?", "c\nd", "é", "|-|-|", "| x |\n|-|\n| y |\n\n| z |", 'say "so"', "\\"])
ITEM = st.none() | TEXT | st.dictionaries(st.sampled_from(["text", "evidence", "topic", "questions"]), TEXT | st.none() | st.lists(TEXT, max_size=2), max_size=3)
LIST = st.none() | ITEM | st.lists(ITEM, max_size=4)
QUESTION = st.none() | TEXT | st.fixed_dictionaries({}, optional={"text": TEXT | st.none(), "follow_ups": LIST, "followUps": LIST})
POINT = ITEM | st.fixed_dictionaries({}, optional={"title": TEXT, "questions": st.none() | QUESTION | st.lists(QUESTION, max_size=3)})
RECORD = st.fixed_dictionaries(
    {}, optional={"customer_priorities": LIST, "confirmedPriorities": LIST, "candidate_products": LIST, "sources": LIST, "comparison": LIST, "rightToWin": st.none() | POINT | st.lists(POINT, max_size=3), "answers": st.dictionaries(TEXT, ITEM, max_size=4) | ITEM}
)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(RECORD, st.integers(0, 7), st.integers(0, 400)), min_size=1, max_size=10))
def test_child_tables_equal_a_walk(items):
    texts = []
    for record, form, at in items:
        t = json.dumps([record, {"data": record}, {"data": {"attributes": {"result": record}}}, {"result": record, "meta": {}}, json.dumps(record), json.dumps(json.dumps(record)), record, [record]][form])
        texts.append(t if at % 4 else t[: at % (len(t) + 1)])
    found = [set() for _ in texts]
    for b in flatten(pa.array(range(len(texts)), pa.int64()), pa.array(texts), "f", "result"):
        for r in zip(*[c.to_pylist() for c in b.columns], strict=True):
            found[r[1]].add(r[2:])
    assert found == [walk(t, "result") for t in texts]


def test_deep_and_odd_texts():
    deep = '{"a":' + "[" * 3000 + "]" * 3000 + ', "sources": ["s"]}'
    texts = [deep, "[" * 5000, "", " ", "{}", '{"sources": ["\\ud83d"]}', '{"sources": ["a"], "sources": ["b", "c"]}', "﻿{}", "nul", "1 2", '"a" "b"', '{"a" 1}', '{"a":,}', "[1,]", "[,1]", '{1:2}', "'a'"]
    nodes = Nodes(pa.array(texts))
    assert nodes.whole.tolist() == [True, False, False, False, True, True, True] + [False] * 10
    got = [b for b in flatten(pa.array(range(len(texts)), pa.int64()), pa.array(texts), "f", "result") if b.num_rows]
    assert sorted((r[1], r[3]) for b in got for r in zip(*[c.to_pylist() for c in b.columns], strict=True)) == [(0, 1), (5, 1), (6, 1), (6, 2)]
    assert Nodes(pa.array([], pa.string())).whole.tolist() == []


def test_slices_and_many_rows():
    rnd = random.Random(3)
    texts = [json.dumps({"sources": ["x" * rnd.randrange(4)] * rnd.randrange(4)}) for _ in range(500)]
    whole = pa.array(["junk \\", '{"a": "', *texts])
    part = whole.slice(2)
    assert np.array_equal(Nodes(part).root >= 0, np.ones(500, bool))
    assert Nodes(whole).whole.tolist() == [False, False] + [True] * 500
