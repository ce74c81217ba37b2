import io
import zipfile

import pytest

from quarrystone.operators.cells import composite_columns, coverage, header_rows, lines, list_items, pipe_rows, regions, row_text, sections, style, table_rows, wide_names
from quarrystone.operators.chunking import chunk_documents, first_of_content, pack, upserted, windows
from quarrystone.sources.documents import parse, read_blocks, word_coverage


def test_composite_columns_and_rows():
    grid = [["", "Q1", "Q1"], ["Company", "Rev", "Cost"], ["A", "1", ""], ["", "", ""]]
    assert composite_columns(grid, 2) == ["Company", "Q1 - Rev", "Q1 - Cost"]
    assert table_rows(grid, 2) == [("A", {"Q1 - Rev": "1", "Q1 - Cost": ""})]
    assert composite_columns([["a", "a", ""]], 1) == ["a", "a (2)", "Column 2"]
    assert row_text("L", {"A": "1", "B": "1"}) == "L: 1" and row_text("L", {"A": "1", "B": "2"}) == "L: A: 1, B: 2"
    assert wide_names(["x" * 101, "y"]) == ["x" * 101]
    assert style([["a" * 41, "1"], ["a" * 41, "2"]], set(), 1) == "keyvalue" and style([["a", "b", "c"]], set(), 2) == "complex" and style([], set(), 0) == "header"


def test_header_rows(spark):
    grids = {"one": [["Name", "Size"], ["x1234567", "12"]], "two": [["Group", "Group", ""], ["Name", "Size", "Unit"], ["12", "13", "14"]]}
    rows = [(t, i, j, c) for t, g in grids.items() for i, r in enumerate(g) for j, c in enumerate(r)]
    got = {r.table_id: r.header_rows for r in header_rows(spark.createDataFrame(rows, "table_id string, row_idx int, col_idx int, text string")).collect()}
    assert got == {"one": 1, "two": 1} or got == {"one": 1, "two": 2}


def test_coverage_is_a_difference_of_bags(spark):
    frame = lambda xs: spark.createDataFrame([("t", x) for x in xs], "table_id string, text string")
    assert sorted(r.text for r in coverage(frame(["a", "a", "b", ""]), frame(["a"])).collect()) == ["a", "b"]


def test_regions():
    rows = [["Title", "", ""], ["A", "B", "C"], ["1", "2", "3"], ["Next", "", ""], ["D", "E", ""], ["4", "5", ""]]
    assert regions(rows, [False, False, False, True, False, False]) == [([0], [1, 2]), ([3], [4, 5])]
    assert regions([["T", ""], ["s", ""], ["A", "B"]], [False, False, True]) == [([0, 1], [2])]
    kept = regions([["x", "1"], ["x", "2"], ["x", "3"]], [False] * 3)
    assert kept == [([], [0, 1, 2])]


def test_text_shapes(spark):
    df = spark.createDataFrame([(1, "Start Here\n- one\n- ONE\n2) two\nA line of text.\n| a | b |\n|---|:-:|\n| 1 | 2 |"), (2, None)], "doc_id bigint, text string")
    got = df.select("doc_id", list_items(df.text).alias("items"), pipe_rows(df.text).alias("rows")).collect()
    assert got[0]["items"] == ["one", "two"] and got[0]["rows"] == [["a", "b"], ["1", "2"]]
    kinds = [(r.kind, r.section) for r in lines(df).orderBy("block_index").collect()]
    assert kinds[0] == ("heading", "Start Here") and kinds[4] == ("paragraph", "Start Here") and kinds[5][0] == "table"
    assert sections("Outcome:\nfit\nProduct:\nX\nOutcome:\nno", ["Outcome", "Product"]) == {"outcome": "no", "product": "X"}
    assert sections("Why: because\nmore", ["Why"], inline=True) == {"why": "because\nmore"}


def test_windows_and_packing():
    assert windows(["w"] * 120) == [(0, 50), (40, 90), (80, 120)]
    words = ["w"] * 120
    words[54] = "end."
    assert windows(words)[0] == (0, 55)
    block = lambda n: " ".join(["w"] * n)
    assert [len(t.split()) for _, t in pack([(None, block(n)) for n in (20, 20, 20, 60)])] == [40, 20, 50, 20]
    carried = pack([("a", block(4)), ("b", block(30)), ("c", block(6))])
    assert [(s, len(t.split())) for s, t in carried] == [("a", 40)]
    assert pack([]) == [] and pack([(None, "few words")]) == [(None, "few words")]


def test_chunks_and_index(spark):
    df = spark.createDataFrame([(1, "T", "one two three"), (2, None, None), (3, "", " ")], "doc_id bigint, title string, text string")
    assert [(r.doc_id, r.chunk_index, r.text) for r in chunk_documents(df).collect()] == [(1, 0, "T: one two three")]
    rows = [(1, "k", "a", 1), (2, "k", "a", 2), (3, "m", "b", 1), (4, "n", "  ", 1), (5, "o", None, 1)]
    chunks = spark.createDataFrame(rows, "row_id bigint, chunk_id string, text string, loaded_at int")
    assert sorted(r.row_id for r in first_of_content(chunks).collect()) == [1, 3]
    assert sorted(r.row_id for r in upserted(chunks).collect()) == [2, 3]


def _zip(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return data.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
S = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
DOCX = _zip({"word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Unit A</w:t></w:r></w:p><w:p><w:r><w:t>A text.</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>k</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>v</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'})
XLSX = _zip({
    "xl/workbook.xml": f'<workbook {S}><sheets><sheet name="Data"/></sheets></workbook>',
    "xl/sharedStrings.xml": f"<sst {S}><si><t>Title</t></si><si><t>Name</t></si></sst>",
    "xl/worksheets/sheet1.xml": f'<worksheet {S}><sheetData><row><c r="A1" t="s"><v>0</v></c></row><row><c r="A2" t="s"><v>1</v></c><c r="B2" t="inlineStr"><is><t>Size</t></is></c></row><row><c r="A3"><v>7</v></c><c r="B3"><v>8</v></c></row></sheetData></worksheet>',
})


def test_formats():
    assert [(b["type"], b["section"]) for b in parse("a.docx", DOCX)] == [("heading", "Unit A"), ("paragraph", "Unit A"), ("table", "Unit A")]
    sheet = parse("a.xlsx", XLSX)
    assert sheet[0]["text"] == "Title" and sheet[1]["grid"] == [["Name", "Size"], ["7", "8"]] and sheet[1]["section"] == "Data"
    md = parse("a.md", b"# Head\ntext\n- item\n\n| a | b |\n|---|---|\n| 1 | 2 |\n")
    assert [b["type"] for b in md] == ["heading", "paragraph", "list_item", "table"] and md[3]["grid"] == [["a", "b"], ["1", "2"]]
    assert parse("a.csv", "﻿a,b\n1\n,\n".encode())[0]["grid"] == [["a", "b"], ["1", ""]]
    assert [b["type"] for b in parse("a.txt", b"BIG HEAD\n\nsome text.\n\n- item")] == ["heading", "paragraph", "list_item"]
    with pytest.raises(ValueError):
        parse("a.exe", b"")
    assert word_coverage("a.md", b"# Head\ntext | x") == 1.0 and word_coverage("a.docx", DOCX) == 1.0 and word_coverage("a.png", b"") is None


def test_folder(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(DOCX)
    (tmp_path / "~$a.docx").write_bytes(b"lock")
    (tmp_path / "b.docx").write_bytes(b"broken")
    (tmp_path / "c.txt").write_text("one\n\ntwo")
    (tmp_path / "d.exe").write_text("x")
    got = {(r.filename, r.type) for r in read_blocks(spark, str(tmp_path)).collect()}
    assert got == {("a.docx", "heading"), ("a.docx", "paragraph"), ("a.docx", "table"), ("b.docx", "error"), ("c.txt", "paragraph")}
