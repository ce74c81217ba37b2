"""Catalogues as files, through blocks, tables and ordering codes to a registry and chunks."""

import io
import zipfile

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import naming, registry_build
from quarrystone.operators.chunking import chunk_blocks
from quarrystone.operators.registry_build import Catalogue, build_registry, by_name, coded_choices, load_registry, named_choices, parse_registry, save_registry, selectable, span
from quarrystone.operators.tables import build_table, header_count, table_text
from quarrystone.sources.documents import Hooks, documents, parse, parse_files, read_blocks
from quarrystone.sources.docx_writer import write_docx

WALL = write_docx([
    ("title", "Ovanta Wall Series"), ("paragraph", "A portable leak detector for hydrogen (H2)."), ("paragraph", "Technology:  CMOS MEMS cell"), ("paragraph", "Housing: steel"),
    ("heading", "Product Ordering Nomenclature"), ("paragraph", "Ovanta\tWall\tHH\tG/P\tRR*\tVV*"), ("paragraph", "Series Name\tModel\tHousing\tGas\tRange\tOutput Signal"), ("paragraph", "2K\t4%"),
    ("paragraph", "2K - low"), ("paragraph", "4% – high"), ("paragraph", "other text"),
    ("table", [["Selectable Ranges", "A", "B"], ["Start", "0", "0"], ["Span", "2,000 ppm", "4 vol%"], ["MDL", "5", "5"], ["Resolution", "1", "2"], ["Certainty", "100%", "100%"]]),
    ("table", [["Selectable Probe Length", "short", "long", "long"], ["Length", "1 m", "2 m", "3 m"]]),
])
PLAIN = write_docx([("title", "Talvex"), ("paragraph", "A fixed analyzer.")])


def _files(spark, **files):
    return spark.createDataFrame([(f"/x/{k.replace('__', '.')}", v) for k, v in files.items()], "path string, content binary")


def test_registry_of_catalogues(spark):
    docs = documents(parse_files(_files(spark, Wall__docx=WALL, Talvex__docx=PLAIN, note__txt=b"no catalogue", bad__docx=b"x")))
    assert {r.filename for r in docs.collect()} == {"Wall.docx", "Talvex.docx", "note.txt"}
    heads = docs.select(F.col("filename").alias("document_name"), F.posexplode(F.filter("blocks", lambda b: b["type"] == "heading")).alias("pos", "b")).select("document_name", "pos", F.col("b.text").alias("heading"))
    got = {r.source_catalogue: r for r in build_registry(docs, naming.assign_names(heads)).collect()}
    assert set(got) == {"Wall.docx", "Talvex.docx"}
    wall, talvex = got["Wall.docx"], got["Talvex.docx"]
    assert (wall.product_name, wall.family, wall.product_type, wall.technology, wall.install_type, wall.target_gas) == ("Ovanta Wall Series", "Ovanta", "Leak Detector", "CMOS MEMS", "Portable", "H2")
    segments = {s.code: (s.pos, s.label, s.segment_values) for s in wall.nomenclature}
    assert segments == {
        "HH": (2, "Housing", {"*": "steel"}), "G/P": (3, "Gas", {"G": "Unknown", "P": "Unknown"}),
        "RR*": (4, "Range", {"2K": "Start: 0; Span: 2,000 ppm; MDL: 5; Resolution: 1", "4%": "Start: 0; Span: 4 vol%; MDL: 5; Resolution: 2"}), "VV*": (5, "Output Signal", {"2K": "low", "4%": "high"}),
    }
    assert set(wall.aliases) == {"Ovanta Wall Series", "Ovanta", "Ovanta Wall HH G/P RR", "Ovanta Wall HH G/P RR VV", "Ovanta Wall HH G/P RR 2K", "Ovanta Wall HH G/P RR 4%"}
    assert [(c.label, {v.code: v.text for v in c["values"]}) for c in wall.choices] == [("Probe Length", {"short": "Length: 1 m", "long": "Length: 2 m", "long (3)": "Length: 3 m"})]
    assert (talvex.product_type, talvex.install_type, talvex.technology, talvex.target_gas, talvex.nomenclature) == ("Analyzer", "Fixed", "Unknown", "Unknown", [])


def test_save_and_load(spark, tmp_path):
    docs = documents(parse_files(_files(spark, Wall__docx=WALL)))
    made = build_registry(docs, spark.createDataFrame([], "document_name string, product_name string"))
    save_registry(made, str(tmp_path / "r"))
    back = load_registry(spark, str(tmp_path / "r"))
    assert [tuple(r) for r in back.collect()] == [tuple(r) for r in made.select(*back.columns).collect()]
    assert by_name(back, spark.createDataFrame([(" wall ",)], "product_name string")).count() == 1
    odd = spark.createDataFrame([('{"product_name": "x", "nomenclature": "Unknown"}',), ("broken",), (None,)], "value string")
    assert [(r.product_name, r.nomenclature) for r in parse_registry(odd).collect()] == [("x", [])]


@pytest.mark.parametrize(("code", "want"), [("RR*", True), ("G/P/E", True), ("NN", True), ("XXX", True), ("XXXX", False), ("Ovanta", False), ("42", False), ("Ab", False), ("", False)])
def test_selectable(code, want):
    assert selectable(code) is want


def test_spans_and_choices():
    assert [span(t) for t in ("2K", "2.5k*", "2,000 ppm", "4%", "5 vol%", "V", "")] == ["2000", "2500", "2000", "4%", "5%", None, None]
    assert coded_choices([["Selectable Output", "Voltage (V)", "Current (C)", "(Industrial)"]], []) == {"V": "Voltage", "C": "Current"}
    assert coded_choices([["Selectable Output", "Voltage (V)", "Current (C)"], ["Load", "1", "2"], ["IP", "67", "67"]], []) == {"V": "Load: 1", "C": "Load: 2"}
    assert coded_choices([["one"]], []) == {} and coded_choices([], []) == {} and coded_choices([["Selectable", "a", "b"]], []) == {}
    assert named_choices([["Selectable X", "a", ""]]) == {"a": "Unknown"}
    assert Catalogue([]).ordering() == ([], [], [])
    inline = [{"text": "Product ordering information", "raw": "x"}, {"text": "A B NN VV*", "raw": "A\tB\tNN\tVV*"}, {"text": "Series Model Range Signal", "raw": "Series\tModel\tRange\tSignal"}, {"text": "0 to 5 ppm V", "raw": "\t\t0 to 5 ppm\tV"}]
    assert Catalogue(inline).ordering()[1] == [(2, "NN", "Range", {"*": "0 to 5 ppm"}), (3, "VV*", "Signal", {"*": "V"})]


def test_table_styles():
    kv = build_table([["Name", "Value"], ["S", "S"], ["a", "1"], ["", "2"], ["b", ""]], {(0, 0), (0, 1), (1, 0)})
    assert kv["style"] == "keyvalue" and [(r.section, r.label, r.values) for r in kv["rows"]] == [("S", "a", [("", "1")]), ("S", "b", [("", "")])]
    assert table_text(kv) == "S - a: 1. S - b" and kv["dropped"] == ["2"]
    plain = build_table([["A", "B", ""], ["x", "1", "2"], ["", "", ""], ["y", "3", ""]])
    assert plain["style"] == "header" and plain["columns"] == ["A", "B", "Column 2"] and plain["dropped"] == [] and table_text(plain) == "x: B: 1, Column 2: 2. y: B: 3"
    deep = build_table([["", "Q1", "Q1"], ["Company", "Rev", ""], ["North", "", ""], ["a", "1", "1"], ["opt", "", ""], ["South", "South", "South"], ["b", "2", "3"]], {(2, 0), (5, 0)})
    assert deep["style"] == "complex" and deep["columns"] == ["Company", "Q1 - Rev", "Q1"] and deep["dropped"] == []
    assert table_text(deep) == "North - a: 1. North options: opt. South - b: Q1 - Rev: 2, Q1: 3"
    assert build_table([["x" * 41, "1"], ["x" * 41, "2"]])["style"] == "keyvalue" and build_table([["k", "v"]])["style"] == "keyvalue" and build_table([])["rows"] == []
    assert build_table([["", "y" * 120, "z"], ["a", "1", "2"]])["suspicious"] == ["y" * 120]
    assert [header_count(g) for g in ([["a"]], [["Name", "Size"], ["x1234567", "12"]], [["Group", "Group", ""], ["Name", "Size", ""], ["12", "13", ""]])] == [1, 1, 2]


def _zip(files):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name, text in files.items():
            z.writestr(name, text)
    return data.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main" xmlns:mc="http://schemas.openxmlformats.org/markup-compatibility/2006"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'


def test_merged_cells_and_text_boxes():
    cell = lambda t, p="", b="": f"<w:tc><w:tcPr>{p}</w:tcPr><w:p><w:r><w:rPr>{b}</w:rPr><w:t>{t}</w:t></w:r></w:p></w:tc>"
    table = f'<w:tbl><w:tr>{cell("Wide", "<w:gridSpan w:val=\'2\'/>")}{cell("C")}</w:tr><w:tr>{cell("Down", "<w:vMerge w:val=\'restart\'/>", "<w:b/>")}{cell("1")}{cell("2")}</w:tr><w:tr>{cell("", "<w:vMerge/>")}{cell("3")}{cell("4")}</w:tr></w:tbl>'
    box = lambda t: f"<w:txbxContent><w:p><w:pPr><w:pStyle w:val='Heading1'/></w:pPr><w:r><w:t>{t}</w:t></w:r></w:p></w:txbxContent>"
    body = f'<w:p><w:r><w:rPr><w:sz w:val="28"/></w:rPr><w:t>Large</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r><w:r><mc:AlternateContent><mc:Choice>{box("Caption")}</mc:Choice><mc:Fallback>{box("Caption")}</mc:Fallback></mc:AlternateContent></w:r></w:p>{table}'
    data = _zip({"word/document.xml": f"<w:document {W}><w:body>{body}</w:body></w:document>"})
    found = parse("a.docx", data)
    assert [(b["type"], b["text"], b["section"]) for b in found[:3]] == [("heading", "Large", "Large"), ("paragraph", "Text", "Large"), ("heading", "Caption", "Large")]
    assert found[3]["grid"] == [["Wide", "Wide", "C"], ["Down", "1", "2"], ["Down", "3", "4"]]


def test_slides_with_groups_tables_and_pictures():
    sp = lambda t, kind="", b="0": f'<p:sp><p:nvSpPr><p:nvPr>{f"<p:ph type=\'{kind}\'/>" if kind else ""}</p:nvPr></p:nvSpPr><p:txBody><a:p><a:r><a:rPr b="{b}"/><a:t>{t}</a:t></a:r></a:p></p:txBody></p:sp>'
    tc = lambda t, more="": f"<a:tc {more}><a:txBody><a:p><a:r><a:t>{t}</a:t></a:r></a:p></a:txBody></a:tc>"
    table = f"<p:graphicFrame><a:graphic><a:tbl><a:tr>{tc('H', 'gridSpan=\"2\"')}{tc('', 'hMerge=\"1\"')}</a:tr><a:tr>{tc('x')}{tc('y')}</a:tr></a:tbl></a:graphic></p:graphicFrame>"
    one = f"<p:sld {A}><p:cSld><p:spTree>{sp('Title', 'title')}<p:grpSp>{sp('inside')}<p:grpSp>{sp('Bold head', b='1')}</p:grpSp></p:grpSp>{table}<p:pic><p:blipFill><a:blip r:embed='r1'/></p:blipFill></p:pic></p:spTree></p:cSld></p:sld>"
    rels = '<Relationships><Relationship Id="r1" Type="x/image" Target="../media/i.png"/></Relationships>'
    order = '<Relationships><Relationship Id="a" Type="x/slide" Target="slides/slide2.xml"/><Relationship Id="b" Type="x/slide" Target="slides/slide1.xml"/></Relationships>'
    data = _zip({
        "ppt/presentation.xml": f"<p:presentation {A}><p:sldIdLst><p:sldId r:id='a'/><p:sldId r:id='b'/></p:sldIdLst></p:presentation>", "ppt/_rels/presentation.xml.rels": order, "ppt/slides/slide1.xml": one,
        "ppt/slides/_rels/slide1.xml.rels": rels, "ppt/media/i.png": "PIC", "ppt/slides/slide2.xml": f"<p:sld {A}><p:cSld><p:spTree>{sp('First')}</p:spTree></p:cSld></p:sld>",
    })
    found = parse("a.pptx", data, Hooks(ocr=lambda b: f"read {b.decode()}\n\n- item"))
    assert [(b["type"], b.get("text"), b["section"], b["slide_number"]) for b in found if b["type"] != "table"] == [
        ("paragraph", "First", None, 1), ("heading", "Title", "Title", 2), ("paragraph", "inside", "Title", 2), ("heading", "Bold head", "Bold head", 2), ("paragraph", "read PIC", "Bold head", 2), ("list_item", "- item", "Bold head", 2),
    ]
    assert next(b["grid"] for b in found if b["type"] == "table") == [["H", "H"], ["x", "y"]]
    assert not [b for b in parse("a.pptx", data) if b.get("method") == "ocr"]


def test_sheets_by_relation():
    s, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    sheet = lambda *rows: f"<worksheet {s}><sheetData>" + "".join(f'<row>{"".join(f"<c r=\'{c}{i}\' t=\'inlineStr\' s=\'{k}\'><is><t>{t}</t></is></c>" for c, t, k in row)}</row>' for i, row in rows) + "</sheetData></worksheet>"
    data = _zip({
        "xl/workbook.xml": f"<workbook {s} {r}><sheets><sheet name='Second' r:id='b'/><sheet name='First' r:id='a'/></sheets></workbook>",
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Type="x/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="b" Type="x/worksheet" Target="/xl/worksheets/sheet2.xml"/></Relationships>',
        "xl/styles.xml": f"<styleSheet {s}><fonts><font/><font><b/></font></fonts><cellXfs><xf fontId='0'/><xf fontId='1'/></cellXfs></styleSheet>",
        "xl/worksheets/sheet1.xml": sheet((1, [("A", "k", 1), ("B", "v", 0)]), (2, [("A", "m", 1), ("B", "w", 0)])), "xl/worksheets/sheet2.xml": sheet((1, [("C", "x", 0), ("E", "y", 0)]), (2, [("C", "1", 0), ("E", "2", 0)])),
    })
    found = parse("a.xlsx", data)
    assert [(b["section"], b["grid"], b["style"]) for b in found] == [("Second", [["x", "y"], ["1", "2"]], "header"), ("First", [["k", "v"], ["m", "w"]], "keyvalue")]


def test_pages_and_pictures_by_hooks(spark, tmp_path):
    hooks = Hooks(ocr=lambda b: "SCANNED PAGE\n\nwith a text.", pdf=lambda b: [("A PAGE\n\nof enough text to be read as it is.", lambda: b""), ("", lambda: b"x")])
    assert [(b["type"], b["text"], b["page_number"], b.get("method")) for b in parse("a.pdf", b"", hooks)] == [
        ("heading", "A PAGE", 1, None), ("paragraph", "of enough text to be read as it is.", 1, None), ("heading", "SCANNED PAGE", 2, "ocr"), ("paragraph", "with a text.", 2, "ocr"),
    ]
    with pytest.raises(ValueError):
        parse("a.pdf", b"")
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.png").write_bytes(b"x")
    assert read_blocks(spark, str(tmp_path)).count() == 0
    assert {r.filename for r in read_blocks(spark, str(tmp_path), hooks).collect()} == {"a.pdf", "b.png"}


def test_chunks_of_blocks(spark):
    docs = documents(parse_files(_files(spark, Wall__docx=WALL, a__md=b"# One\nfew words\n\n| k | v |\n|---|---|\n| a b c d e | f g h i j |\n\n# Two\n" + b"w " * 60)))
    names = spark.createDataFrame([("Wall.docx", "Ovanta Wall")], "document_name string, product_name string")
    got = chunk_blocks(docs, names).orderBy("document_name", "chunk_index").collect()
    wall, md = [r for r in got if r.document_name == "Wall.docx"], [r for r in got if r.document_name == "a.md"]
    assert all(r.text.startswith("Ovanta Wall: ") for r in wall) and [r.total_chunks for r in wall] == [len(wall)] * len(wall)
    assert any("Start: A: 0, B: 0" in r.text or "Start: 0" in r.text for r in wall)
    assert [(r.section_heading, len(r.text.split()) - 1) for r in md] == [("One", 14), ("Two", 51), ("Two", 20)] or [r.section_heading for r in md][0] == "One"
    assert all(len(r.chunk_id) == 64 for r in got) and chunk_blocks(docs.limit(0), names).count() == 0
    assert registry_build.ordering_codes(docs.limit(0)).count() == 0
