import pytest

from quarrystone.llm.scans import analyse, is_misreading, is_page_number, repaired_pages, repaired_paragraphs, scan_defects

WORDS = "the sensor of the unit was sealed before each shift and the reading stays below the limit while the cover is open self-test routine runs twice enclosure minutes"


def _chunks():
    rows = [(100 + k, "Sound.docx", None, WORDS, "x") for k in range(60)]
    pages = [
        "Ovanta Series Manual\nthe sensor of the unit was sea-\nled before each shift and the self-\ntest routine runs twice while the\ncover is open the reading stays be-\n- 1 -",
        "Ovanta Scries Manual\nlow the limit while the covcr is\nopen the unit was sealed before 1O5\nminutes and the enclo¬\nsiire is open\n- 2 -",
        "  Ovanta Series Manual\nthe reading stays below the limit\nwhile the cover is open and the\nunit was sealed before each shift\n\n- l -",
        "Ovanta Series Manual\nthe sensor of the unit was sealed\nbefore each shift and the reading\nstays below the limit\niv",
    ]
    rows += [(k, "Scan.pdf", k, text, None) for k, text in enumerate(pages, 1)]
    rows += [(50, None, 1, "a\nb", None), (51, "Scan.pdf", None, "a", None), (52, "Null.pdf", 1, None, None), (53, "Empty.pdf", 2, "", None)]
    return rows


SCHEMA = "row_id bigint, document_name string, page_number int, text string, line string"


def test_defects(spark):
    got = {tuple(r) for r in scan_defects(spark.createDataFrame(_chunks(), SCHEMA)).collect()}
    want = {(k, 1, "running_header") for k in range(1, 5)}
    want |= {(1, 6, "page_number"), (2, 6, "page_number"), (3, 6, "page_number"), (4, 5, "page_number")}
    want |= {(1, 2, "split_word"), (1, 5, "split_word"), (2, 4, "split_word")}
    want |= {(2, 2, "misread"), (2, 3, "misread"), (2, 5, "misread")}
    assert got == want


def test_repaired_text(spark):
    pages = {r.row_id: r for r in repaired_pages(spark.createDataFrame(_chunks(), SCHEMA)).collect()}
    assert pages[1].text == "the sensor of the unit was sealed before each shift and the self-test routine runs twice while the cover is open the reading stays below"
    assert pages[2].text == "the limit while the cover is open the unit was sealed before 105 minutes and the enclosure is open"
    assert pages[1].runs_on


def test_paragraphs_over_pages(spark):
    got = {(r.first_page, r.paragraph): r.text for r in repaired_paragraphs(spark.createDataFrame(_chunks(), SCHEMA)).collect()}
    # No page of the document ends a sentence, so it is one paragraph.
    assert set(got) == {(1, 0)}
    assert "stays below the limit while the cover is open the unit was sealed before 105" in got[1, 0]
    assert got[1, 0].endswith("stays below the limit")
    ended = [(i, d, n, t.replace("each shift\n\n", "each shift.\n\n") if i == 3 else t, x) for i, d, n, t, x in _chunks() if t]
    got = {(r.first_page, r.paragraph) for r in repaired_paragraphs(spark.createDataFrame(ended, SCHEMA)).collect()}
    assert got == {(1, 0), (4, 0)}


def test_no_pages(spark):
    df = spark.createDataFrame(_chunks(), SCHEMA)
    assert scan_defects(df.limit(0)).count() == 0
    assert scan_defects(df.filter("page_number is null")).count() == 0
    assert analyse(df)[0].count() > 0


@pytest.mark.parametrize(("wrong", "right"), [("scrvice", "service"), ("alarrn", "alarm"), ("termirial", "terminal"), ("hoiise", "house"), ("mmutes", "minutes"), ("interriiptcd", "interrupted")])
def test_misreadings(wrong, right):
    assert is_misreading(wrong, right)
    assert not is_misreading(wrong + "x", right)


@pytest.mark.parametrize(("line", "number"), [("12", True), ("- 3 -", True), ("Page l2 of 22", True), ("[4]", True), ("xiv", True), ("p. 7", True), ("5 |", True), ("sis.", False), ("111 s", False), ("dry.", False), ("", False)])
def test_page_numbers(line, number):
    assert is_page_number(line) == number


def test_words_of_any_length(spark):
    """Words of more letters than any limit are corrections and are corrected, and the hash stays a long."""
    from pyspark.sql import functions as F

    from quarrystone.llm.scans import PRIME, _power, anagram_hash, corrections

    long = "electro" * 12
    wrong = long.replace("e", "c", 1)
    vocabulary = spark.createDataFrame([(long, 100), (wrong, 1)], "word string, n bigint")
    got = [tuple(r) for r in corrections(spark.createDataFrame([(wrong,), ("z" * 30_000,)], "word string"), vocabulary).collect()]
    assert got == [(wrong, long, 100)]
    row = spark.createDataFrame([("é" * 50_000,)], "w string").select(anagram_hash(F.col("w")).alias("h")).first()
    assert row.h == _power("é" * 50_000) % PRIME
