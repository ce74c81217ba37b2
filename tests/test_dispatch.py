"""Every rule of the dispatcher, and near spellings against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.wording import asks
from quarrystone.operators import naming
from quarrystone.operators.dispatch import attributes, dispatch, named_products, type_ambiguous

PRODUCTS = [
    (1, "Ovanta Wall 11", "Leak Detector", "Portable", "CMOS MEMS", "ovanta_wall.docx", ["Ovanta", "Ovanta Wall", "Ovanta Wall V"], [(0, "VV*", "Output Signal", {"V": "Analogue Voltage Output", "C": "Resolution: 5 ppm; Accuracy: 2 %"})]),
    (2, "Ovanta Duct 12", "Leak Detector", "Fixed", "MEMS", "ovanta_duct.docx", ["Ovanta", "Ovanta Duct", "Ovanta Duct C"], [(0, "VV*", "Range", {"C": "Resolution: 5 ppm; Accuracy: 2 %"})]),
    (3, "Talvex 400", "Analyzer", "Fixed", "Solid State Electrochemical", "talvex.docx", ["Talvex"], []),
    (4, "Quillon Mini", "Unknown", "Portable", "Unknown", "quillon.docx", None, []),
]
SCHEMA = "product_id bigint, product_name string, product_type string, install_type string, technology string, source_catalogue string, aliases array<string>, nomenclature array<struct<pos:int,code:string,label:string,segment_values:map<string,string>>>"
ALL = sorted(p[1] for p in PRODUCTS)
CASES = [
    ("What does Ovanta Wall V mean?", "decode", ["Ovanta Wall 11"]),
    ("What is the resolution of Ovanta Duct C?", "decode", ["Ovanta Duct 12"]),
    ("How heavy is the Talvex?", "one_product", ["Talvex 400"]),
    ("Is quillon mini sealed?", "one_product", ["Quillon Mini"]),
    ("List all products of the Ovanta family", "family_list", ["Ovanta Duct 12", "Ovanta Wall 11"]),
    ("How long does an Ovanta last?", "several_products", ["Ovanta Duct 12", "Ovanta Wall 11"]),
    ("Talvex or Ovanta Wall in a hall?", "several_products", ["Ovanta Wall 11", "Talvex 400"]),
    ("Is the talvexx sealed?", "one_product", ["Talvex 400"]),
    ("list all", "catalog", ALL),
    ("Show portable products", "catalog", ["Ovanta Wall 11", "Quillon Mini"]),
    ("Which products use SSEC?", "catalog", ["Talvex 400"]),
    ("Which sensors are MEMS or portable?", "catalog", ["Ovanta Duct 12", "Ovanta Wall 11", "Quillon Mini"]),
    ("Which products are the lightest?", "whole_catalog", ALL),
    ("Tell me about fixed analyzers", "catalog", ["Ovanta Duct 12", "Talvex 400"]),
    ("Tell me about recovery", "whole_catalog", ALL),
    ("Is the portable sensor sealed?", "attribute", ["Ovanta Wall 11", "Quillon Mini"]),
    ("Is the sensor sealed?", "whole_catalog", ALL),
    ("Do we beat them?", "whole_catalog", ALL),
    ("Talvex versus Zorbex", "search", []),
    ("Which products beat Talvex?", "search", []),
    ("", "whole_catalog", ALL),
    (None, "whole_catalog", ALL),
]


@pytest.fixture(scope="module")
def products(spark):
    return spark.createDataFrame(PRODUCTS, SCHEMA)


def test_every_rule(spark, products):
    rows = [(k, q, "x") for k, (q, _, _) in enumerate(CASES)]
    got = {r.id: r for r in dispatch(spark.createDataFrame([*rows, rows[0]], "id bigint, q string, rule string"), "id", "q", products).collect()}
    assert len(got) == len(CASES)
    for k, (q, rule, names) in enumerate(CASES):
        assert (got[k].rule, got[k].products) == (rule, names), q
    assert {r.rule for r in got.values()} == {"decode", "one_product", "family_list", "several_products", "catalog", "attribute", "whole_catalog", "search"}
    assert got[0].answer == 'For the Ovanta Wall 11, code "V" in the Output Signal segment means: Analogue Voltage Output.'
    assert got[1].answer == 'For the Ovanta Duct 12, code "C" -- Resolution: 5 ppm.'
    assert got[4].answer == '2 product(s) in the "ovanta" family: Ovanta Duct 12, Ovanta Wall 11.'
    assert got[10].answer == '1 product(s) match technology "Solid State Electrochemical": Talvex 400.'
    assert got[11].answer.startswith('3 product(s) match technology "MEMS" and install type "Portable": ')
    assert [got[k].exclude_references for k in (2, 12, 17, 18)] == [True, False, True, False]
    assert all((r.answer is not None) == (r.kind == "direct") for r in got.values())
    assert dispatch(spark.createDataFrame([], "id bigint, q string"), "id", "q", products).count() == 0
    assert {r.rule for r in dispatch(spark.createDataFrame([(1, "list all"), (2, "Talvex?")], "id bigint, q string"), "id", "q", products.limit(0)).collect()} == {"catalog", "whole_catalog"}


def test_nothing_found_is_said(spark, products):
    got = dispatch(spark.createDataFrame([(1, "list all SSEC products")], "id bigint, q string"), "id", "q", products.filter("product_id <> 3")).first()
    assert (got.rule, got.products, got.answer) == ("catalog", [], 'No approved products are documented with technology "Solid State Electrochemical".')


def test_names_inside_longer_names(spark, products):
    q = spark.createDataFrame([(1, "the ovanta wall 11 (v2)"), (2, "xovanta"), (3, "Ovanta-Wall")], "id bigint, q string")
    got = {(r.id, r.product_id, r.alias) for r in named_products(q, "id", "q", products, fuzzy=False).collect()}
    assert got == {(1, 1, "ovanta wall 11"), (3, 1, "ovanta"), (3, 2, "ovanta")}


def test_near_spellings_against_all_pairs(spark):
    rnd = random.Random(4)
    brands = ["".join(rnd.choice("abcd") for _ in range(n)) for n in (3, 3, 4, 4, 4, 5, 6, 8)]
    words = list({"".join(rnd.choice("abcd") for _ in range(rnd.randint(3, 9))) for _ in range(700)})
    got = {(r.word, r.brand) for r in naming.fuzzy_words(spark.createDataFrame(list(enumerate(words)), "id bigint, t string"), "id", "t", spark.createDataFrame([(b,) for b in brands], "brand string")).collect()}
    want = {(w, b) for w in words for b in brands if len(w) >= 4 and abs(len(w) - len(b)) <= 2 and w not in brands and SequenceMatcher(None, w, b).ratio() >= 0.75}
    assert got == want and len(want) > 20


def test_attributes_and_wordings(spark):
    df = spark.createDataFrame([("SSEC or cmos mems, portable leak detector",), (None,)], "q string")
    assert [[(x.field, x.value) for x in r[0]] for r in df.select(attributes(df.q)).collect()] == [
        [("technology", "Solid State Electrochemical"), ("technology", "MEMS"), ("product_type", "Leak Detector"), ("install_type", "Portable"), ("technology", "CMOS MEMS")], [],
    ]
    said = {
        "list_all": ["show me all your sensors", "what products are available", "product lineup", "list of the units"], "superlative": ["the lightest one", "most rugged", "is it better"],
        "reference": ["is this sealed", "the hydrogen sensor"], "self_reference": ["are we certified", "the company"], "comparison": ["a vs b", "a vs. b", "compared to c", "the difference between them"],
    }
    for wording, yes in said.items():
        rows = spark.createDataFrame([(t,) for t in yes], "q string")
        assert all(r[0] for r in rows.select(asks(F.upper("q"), wording)).collect()), wording
    no = spark.createDataFrame([("how is the valve opened",), (None,)], "q string")
    assert not any(r[0] for w in said for r in no.select(asks(F.col("q"), w)).collect())


def test_kinds_of_product(spark, products):
    terms = {"leak detector": "Leak Detector", "detector": "Leak Detector", "analyzer": "Analyzer"}
    q = spark.createDataFrame([(1, "is the leak detector sealed"), (2, "detector Ovanta Wall 11"), (3, "an analyzer"), (4, "ovanta detector"), (5, None)], "id bigint, q string")
    assert {r.id for r in type_ambiguous(q, "id", "q", products, terms).collect()} == {1, 4}
