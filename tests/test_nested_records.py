import json

from quarrystone.operators.nested_records import child_rows

RECORD = {
    "customer_priorities": ["a", None, " ", "b"],
    "comparison": ["| T | O |", "|-|-|", "| x | y |", "z | 1"],
    "sources": [["d", "s"], None, {"document": "e", "section": ""}],
}
DISCOVERY = {
    "right_to_win": [{"title": "t", "evidence": "text", "questions": ["q1?", {"text": "q2?", "follow_ups": ["f1", "", "f2"]}]}, "", {"title": "u", "questions": "lone?"}],
    "answers": {"q2?": "yes", "lone?": "  ", "old?": "x"},
}


def _rows(spark, rows, form, field="f"):
    df = spark.createDataFrame(rows, "id bigint, blob string, child string")
    return {tuple(r)[1:] for r in child_rows(df, "id", "blob", field, form).collect()}


def test_children_and_positions(spark):
    got = _rows(spark, [(1, json.dumps(RECORD), "x"), (1, json.dumps(RECORD), "x")], "result")
    assert got == {(1, "priority", 1, 0, 0), (1, "priority", 4, 0, 0), (1, "comparison_row", 1, 0, 0), (1, "comparison_row", 2, 0, 0), (1, "source", 1, 0, 0), (1, "source", 3, 0, 0)}


def test_discovery(spark):
    want = {(2, "point", 1, 0, 0), (2, "point", 3, 0, 0), (2, "question", 1, 1, 0), (2, "question", 1, 2, 0), (2, "question", 3, 1, 0), (2, "follow_up", 1, 2, 1), (2, "follow_up", 1, 2, 3), (2, "answer", 1, 2, 0)}
    for blob in (DISCOVERY, {"schema": 2, "discovery": DISCOVERY, "meta": {}}, {"data": {"attributes": {"discovery": DISCOVERY}}}, json.dumps(DISCOVERY)):
        assert _rows(spark, [(2, json.dumps(blob), None)], "discovery") == want


def test_camel_case_lone_elements_and_evidence(spark):
    blob = {"customerPriorities": "one", "comparison": [{"topic": "x", "evidence": [{"document": "d"}, {}]}, None, {"topic": "y", "evidence": {"document": "e"}}]}
    got = _rows(spark, [(3, json.dumps(blob), None)], "result")
    assert got == {(3, "priority", 1, 0, 0), (3, "comparison_row", 1, 0, 0), (3, "comparison_row", 3, 0, 0), (3, "evidence", 1, 1, 0), (3, "evidence", 3, 1, 0)}


def test_incomplete_and_empty_texts(spark):
    rows = [(1, None, None), (2, "", None), (3, '{"customer_priorities": ["a"', None), (4, "[]", None), (5, "7", None), (None, "{}", None), (6, json.dumps(json.dumps({"sources": ["s"]})[:-1]), None)]
    assert _rows(spark, rows, "result") == set()
    assert _rows(spark, [(7, json.dumps({"sources": ["s" * 100000] * 50}), None)], "result") == {(7, "source", k, 0, 0) for k in range(1, 51)}
    assert child_rows(spark.createDataFrame([], "id bigint, blob string"), "id", "blob", "f", "result").count() == 0
