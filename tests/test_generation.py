"""Batch generation with offline models, texts around answers and saved results, with nulls and empty tables."""

import pytest
from pyspark.sql import functions as F

from quarrystone.operators import answers, saved, settings, stores
from quarrystone.plans import generation, pipeline
from quarrystone.streaming.index import points, read_stream

CHUNKS = [
    (1, "Ovanta Wall: The wall sensor settles within ten seconds. More text.", "wall.docx", "Ovanta Wall"),
    (2, "Ovanta Duct: The duct sensor needs a filter.", "duct.docx", "Ovanta Duct"),
    (3, "Ask early for the pain and the metrics of a hydrogen hall.", "methods.md", None),
    (4, "A competitor has a sensor without a filter.", "competitor.md", None),
    (5, None, "x.md", None),
]
TYPES = [("wall.docx", "Product Catalogue"), ("duct.docx", "Product Catalogue"), ("methods.md", settings.METHODS)]
PRODUCTS = [(k, n, "Leak Detector", "Fixed", "MEMS", f, [n], [(0, "VV*", "Range", {"01": "0 to 5 ppm"})]) for k, n, f in ((1, "Ovanta Wall", "wall.docx"), (2, "Ovanta Duct", "duct.docx"))]
SCHEMA = "product_id bigint, product_name string, product_type string, install_type string, technology string, source_catalogue string, aliases array<string>, nomenclature array<struct<pos:int,code:string,label:string,segment_values:map<string,string>>>"


@pytest.fixture(scope="module")
def index(spark):
    return pipeline.build_index(spark.createDataFrame(CHUNKS, "row_id bigint, text string, document_name string, product_name string"))


@pytest.fixture(scope="module")
def uses(spark):
    return spark.createDataFrame([(1, "wall sensor settles within seconds", "competitor"), (2, "duct sensor filter", None), (3, None, "")], "id bigint, use_case string, compare_against string")


def test_discoveries(spark, index, uses):
    got = {r.id: r for r in generation.discoveries(index, uses).collect()}
    assert got[1].title == "wall.docx" and got[1].why.startswith("Ovanta Wall: The wall sensor settles") and got[1].questions == ["What does wall.docx have to do?"] and "wall.docx" in got[1].sources
    assert got[3].title == "nothing" and got[3].sources is None
    assert generation.discoveries(index, uses.limit(0)).count() == 0
    assert {r.title for r in generation.discoveries(index, uses, lambda ms: ["Right to Win: Own\n"] * len(ms)).collect()} == {"Own"}


def test_recommendations(spark, index, uses):
    given = spark.createDataFrame([(1, "a?", "ten seconds"), (1, "b?", " wall sensor "), (1, "c?", " "), (2, "a?", "yes"), (2, "b?", None)], "id bigint, question string, answer string")
    got = {r.id: r for r in generation.recommendations(index, uses, given, spark.createDataFrame(TYPES, "document_name string, doc_type string")).collect()}
    assert (got[1].outcome, got[1].product) == ("Recommend", "wall.docx") and set(got[1].sources) <= {"wall.docx", "duct.docx"}
    assert (got[2].outcome, got[2].missing) == ("Insufficient", "At least 2 discovery questions need an answer; 1 have one.") and got[3].missing.endswith("0 have one.")
    none = generation.recommendations(index, uses, given, spark.createDataFrame([], "document_name string, doc_type string"), lambda ms: [m and "junk" for m in ms]).collect()
    assert {r.outcome for r in none} == {"Insufficient"}


def test_qualifications(spark, index):
    blank = {f: "" for f in stores.FIELDS}
    deals = spark.createDataFrame([(1, "hydrogen hall", *{**blank, "metrics": "x"}.values()), (2, None, *["x"] * len(blank))], "id bigint, use_case string, " + ", ".join(f"{f} string" for f in stores.FIELDS))
    got = {(r.id, r.field): r.question for r in generation.qualifications(index, deals, spark.createDataFrame(TYPES, "document_name string, doc_type string")).collect()}
    assert set(got) == {(1, "identify_pain"), (1, "economic_buyer"), (1, "champion")}
    assert got[1, "identify_pain"].startswith("Ask early") and got[1, "champion"] == "What can you say of the champion?"


def test_sales_aids_and_wordings(spark, index, uses):
    got = {r.id: r for r in generation.sales_aids(index, uses, spark.createDataFrame([("competitor.md",)], "document_name string")).collect()}
    assert got[1].title == "wall.docx" and got[1].rows == 1 and got[1].ready and "competitor.md" in got[1].sources
    drafts = spark.createDataFrame([(1, "q", "It is so.", False), (2, "q", "x", True), (3, None, None, None), (4, "q", "None of the units leak.", False)], "id bigint, question string, answer string, blocked boolean")
    assert {r.id: r.wording for r in generation.wordings(drafts).collect()} == {1: "It is so.", 2: None, 3: None, 4: "None of the units leak."}
    assert {r.wording for r in generation.wordings(drafts, lambda ms: ["n/a"] * len(ms)).collect()} == {None}


def test_answers_by_rules(spark, index):
    products = spark.createDataFrame(PRODUCTS, SCHEMA)
    q = spark.createDataFrame([(1, "list all"), (2, "How fast does the Ovanta Wall sensor settle?"), (3, None), (4, "zzz qqq")], "id bigint, question string")
    got = {r.id: r for r in generation.answer_questions(index, q, products).collect()}
    assert (got[1].kind, got[1].source, got[1].confidence) == ("direct", "duct.docx, wall.docx", "High") and got[1].answer.startswith("2 product(s) match")
    assert (got[2].rule, got[2].source) == ("one_product", "wall.docx") and got[2].answer == "Ovanta Wall: The wall sensor settles within ten seconds."
    assert (got[4].answer, got[4].confidence) == (pipeline.NO_SOURCE, "Low") and got[3].answer == pipeline.NO_SOURCE
    mail = pipeline.build_index(spark.createDataFrame([(1, "Write to a@b.com for the Ovanta Wall.", "wall.docx", "Ovanta Wall")], "row_id bigint, text string, document_name string, product_name string"))
    assert generation.answer_questions(mail, spark.createDataFrame([(1, "whom to write to for the ovanta wall")], "id bigint, question string"), products).first().answer.startswith("Write to a@b.com")


def test_texts_around_answers(spark):
    m = spark.createDataFrame([(1, 1, "a.md", "A"), (1, 2, answers.CLAIMS_FILE, "claim"), (1, 3, "b.md", None), (2, 1, answers.CLAIMS_FILE, "claim"), (3, 1, None, "N")], "query_id bigint, rank int, document_name string, text string")
    assert {r.query_id: r.source for r in answers.guard_source_text(m).collect()} == {1: "A ", 2: "", 3: "N"}
    q = spark.createDataFrame([("What is 2,000 ppm in % LEL?",), ("nothing",), (None,)], "q string")
    assert [r[0] for r in q.select(answers.conversion_note(q.q)).collect()] == ["2,000 ppm = 0.2% v/v = 5% LEL. In % LEL: 5%.", None, None]
    products = spark.createDataFrame(PRODUCTS, SCHEMA)
    told = spark.createDataFrame([(1, "Ovanta Wall"), (1, "Ovanta Duct"), (2, "Ovanta Wall"), (3, "Ovanta Wall"), (3, "Ovanta Duct"), (3, None)], "query_id bigint, product_name string")
    assert [tuple(r) for r in answers.coverage_note(told, products).collect()] == [(1, "Every approved product was checked: Ovanta Duct, Ovanta Wall.")]
    noted = answers.with_notes(m.withColumn("sim", F.lit(0.5)).select("query_id", "rank", "sim", "document_name", "text"), spark.createDataFrame([(1, "Ovanta Wall"), (9, "Ovanta Duct")], "query_id bigint, product_name string"), answers.nomenclature_notes(products))
    assert {(r.query_id, r["rank"], r.text) for r in noted.filter("sim = 1.0").collect()} == {(1, 4, "Ovanta Wall ordering configuration -- Range: 01 = 0 to 5 ppm"), (9, 1, "Ovanta Duct ordering configuration -- Range: 01 = 0 to 5 ppm")}
    pieces = spark.createDataFrame([("s", 1, "short "), ("s", 2, "and then a longer one"), ("s", 3, None), ("s", 4, "end"), ("t", 1, "")], "stream_id string, seq int, delta string")
    assert {(r.stream_id, r.pos, r.text) for r in answers.batched_pieces(pieces).collect()} == {("s", 0, "short and then a longer one"), ("s", 1, "end")}


def test_pieces_stream_as_points(spark, tmp_path):
    """A reply cut into pieces gives its points as a stream, and leaves no state behind."""
    text = "Right to Win: One\nEvidence: a\nRight to Win: Two\nEvidence: b\n"
    cut = generation.pieces(spark.createDataFrame([(7, text), (8, "")], "id bigint, reply string"), 9)
    assert "".join(r.delta for r in cut.filter("stream_id = '7'").orderBy("seq").collect()) == text and cut.filter("last").count() == 2
    cut.coalesce(1).write.parquet(str(tmp_path / "in"))
    query = points(read_stream(spark, str(tmp_path / "in"), cut.schema)).writeStream.outputMode("append").format("memory").queryName("cut").trigger(availableNow=True).start()
    query.awaitTermination()
    assert sorted((r.stream_id, r.pos, r.title) for r in spark.table("cut").collect()) == [("7", 1, "One"), ("7", 2, "Two")]


def test_saved_results(spark, tmp_path):
    deals = spark.createDataFrame([(1, '{"answers": {"q": "yes", "r": " "}}'), (2, "broken {"), (3, None)], "id bigint, last_discovery string")
    assert [tuple(r) for r in saved.question_answers(deals).collect()] == [(1, "q", "yes")]
    made = generation.save_generated(deals, spark.createDataFrame([(1, "t"), (9, "u")], "id bigint, title string"), "last_discovery")
    assert {r.id: r.last_discovery for r in made.collect()} == {1: '[{"title":"t"}]', 2: "broken {", 3: None}
    assert saved.without_deal(deals, 1).count() == 2 and saved.without_deal(deals.limit(0), 1).count() == 0
    m = spark.createDataFrame([({"q": "a"},), (None,)], "m map<string,string>")
    assert [r[0] for r in m.select(saved.answered(m.m, "q", "b")).collect()] == [{"q": "b"}, {"q": "b"}]
    assert saved.copy_store({"deals": deals, "empty": deals.limit(0)}, str(tmp_path / "store")) == {"deals": 3, "empty": 0}


def test_settings_change(spark):
    o, h = spark.createDataFrame([], "product_name string, label string, kind string, options map<string,string>"), spark.createDataFrame([("p", "L")], "product_name string, label string")
    o1, h1 = settings.set_field(o, h, "p", "L", {"a": "1"})
    assert o1.count() == 1 and h1.count() == 0
    o2, h2 = settings.remove_field(o1, h1, "p", "L")
    assert o2.count() == 0 and h2.count() == 1 and settings.remove_field(o2, h2, "p", "L")[1].count() == 1 and settings.unhide_field(h2, "p", "L").count() == 0
    names = spark.createDataFrame([("a.md", "A")], "document_name string, product_name string")
    assert settings.set_name(names, "a.md", " B ").collect()[0].product_name == "B" and settings.set_name(names, "a.md", None).count() == 0
    types = settings.set_type(spark.createDataFrame([], "document_name string, doc_type string"), "a", "Other")
    assert settings.remove_type(types, "a").count() == 0
    with pytest.raises(ValueError):
        settings.set_type(types, "a", "Leaflet")
    entries = spark.createDataFrame([(1, "c", " ATEX, atex ,, Peso", False, ""), (2, " ", "x", False, ""), (3, "d", None, True, "")], "position int, category string, keywords string, always_unsupported boolean, note string")
    rows = settings.policy_rows(entries)
    assert [r.keywords for r in rows.collect()] == [["atex", "peso"]] and settings.policy_text(rows).first().keywords == "atex, peso"
    feedback = spark.createDataFrame([(1, "q", "correct")], "id bigint, question string, verdict string")
    assert stores.record(feedback, feedback.select("question", "verdict")).count() == 2 and stores.cleared(feedback).count() == 0
    with pytest.raises(ValueError):
        stores.record(feedback, spark.createDataFrame([("q", "great")], "question string, verdict string"))


def test_documents_are_written(spark, tmp_path):
    stored = saved.store_documents(spark.createDataFrame([], "document_name string, content binary, size_bytes bigint, uploaded_at timestamp"), spark.createDataFrame([("a.md", b"x"), ("b.md", b""), (None, b"y")], "document_name string, content binary"))
    assert sorted(tuple(r) for r in saved.write_documents(stored, f"file://{tmp_path}/docs").collect()) == [("a.md", 1), ("b.md", 0)]
    assert (tmp_path / "docs" / "a.md").read_bytes() == b"x" and saved.document_bytes(stored, "a.md").first().content == b"x" and saved.document_bytes(stored, "z").count() == 0
    from quarrystone.sources.documents import parse

    aids = spark.createDataFrame([(1, "T", ["p\u0001"], None, [["h", "k"], ["a", "b"]], " "), (2, None, None, None, None, None)], "id bigint, title string, priorities array<string>, framing string, table array<array<string>>, summary string")
    files = {r.path: bytes(r.content) for r in saved.aid_files(aids).collect()}
    assert [(b["type"], b["text"]) for b in parse("x.docx", files["sales_aid_1.docx"])] == [("heading", "T"), ("heading", "Customer Priorities"), ("list_item", "p"), ("table", "a: k: b")] and parse("x.docx", files["sales_aid_2.docx"]) == []


def test_search_in_slices_against_all_at_once(spark, monkeypatch):
    """The best of every search do not depend on how many chunks are compared at once."""
    import numpy as np

    rng = np.random.default_rng(3)
    rows = [(int(k), f"word{k % 7} text", "abc"[k % 3], [float(x) for x in rng.integers(-2, 3, 6)]) for k in rng.permutation(400)]
    index = spark.createDataFrame(rows, "row_id bigint, text string, product_name string, embedding array<float>").coalesce(1)
    asked = [(s, int(s % 9), "main" if s % 2 else "more", [None, "a", "b"][s % 3], 3 + s % 2, [float(x) for x in rng.integers(-2, 3, 6)] if s < 9 else None, ["word1", "text4"] if s % 2 else []) for s in range(18)]
    asked = [(*a[:5], asked[a[0] % 9][5], a[6]) for a in asked]
    questions = spark.createDataFrame(asked, "search bigint, id bigint, part string, product_name string, n int, embedding array<float>, words array<string>")
    found = {}
    for size in (7, 50, 2000):
        monkeypatch.setattr(pipeline, "SLICE", size)
        found[size] = sorted(map(tuple, pipeline._search(index, questions).collect()))
    assert found[7] == found[50] == found[2000] and len(found[7]) > 50
    unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
    for search, _, part, product, n, vec, words in asked:
        best = sorted((-round(float(unit(vec) @ unit(v)), 5), i) for i, _, p, v in rows if product in (None, p))[:n]
        assert [(i, round(-s, 5)) for s, i in best] == sorted([(i, round(s, 5)) for q, i, s, w in found[7] if q == search and not w], key=lambda x: (-x[1], x[0]))
