import random

import pytest
from pyspark.sql import functions as F

from quarrystone.functions.text import inflected, longest_contained, slug, unnegated, whole
from quarrystone.operators import guard, naming, registry, stores, vectors


def test_vectors_against_brute_force(spark):
    rng = random.Random(1)
    rows = [(k, [rng.gauss(0, 1) for _ in range(8)], k % 3) for k in range(150)] + [(900, None, 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(5)
    asked = df.filter("vec_id % 50 = 0")
    got = {(r.query_id, r.rank): r.vec_id for r in vectors.top_k(df, asked, 4).collect()}
    stored = {r.vec_id: list(r.embedding) for r in df.filter("embedding is not null").collect()}
    norm = lambda v: sum(x * x for x in v) ** 0.5
    for q in (0, 50, 100):
        sims = sorted((-round(sum(a * b for a, b in zip(stored[q], v, strict=True)) / norm(stored[q]) / norm(v), 5), k) for k, v in stored.items() if k != q)
        assert [got[q, r] for r in range(1, 5)] == [k for _, k in sims[:4]]
    same = vectors.top_k(df, asked, 4, scope="label", mode="same").collect()
    assert all(r.vec_id % 3 == r.query_id % 3 for r in same) and len(same) == 12
    each = vectors.top_k(df, asked, 2, scope="label", mode="each")
    assert each.count() == 18
    order = [r.label for r in vectors.interleave(each, "label").filter("query_id = 0").orderBy("position").collect()]
    assert order == ["0", "1", "2"] * 2
    assert vectors.top_k(df, asked.limit(0), 4).count() == 0 and vectors.top_k(df.limit(0), asked, 4).count() == 0


def test_gates(spark):
    df = spark.createDataFrame([(None,), (0.31,), (0.32,), (0.56,)], "s double")
    assert [r[0] for r in df.select(vectors.confidence(df.s)).collect()] == ["none", "none", "low", "high"]


@pytest.mark.parametrize(("text", "want"), [("What does it cost to install?", "pricing"), ("Is it certified?", "compliance"), ("Which sensors are there?", "product"), ("Send the datasheet", "document_request"), ("hello", "unknown"), (None, "unknown")])
def test_intents(spark, text, want):
    df = spark.createDataFrame([(text,)], "q string")
    assert df.select(guard.intent(df.q)).first()[0] == want


def test_terms(spark):
    df = spark.createDataFrame([("two hazardous areas",), ("a non-hazardous area",), ("RS485x",)], "t string")
    assert [r[0] for r in df.select(df.t.rlike(inflected("hazardous area"))).collect()] == [True, True, False]
    assert [r[0] for r in df.select(df.t.rlike(unnegated("hazardous"))).collect()] == [True, False, False]
    assert [r[0] for r in df.select(df.t.rlike(whole("RS485"))).collect()] == [False, False, False]
    assert df.select(longest_contained(F.lit("new cmos mems part"), ["MEMS", "CMOS MEMS"])).first()[0] == "CMOS MEMS"
    assert df.select(slug(F.lit("  My Field! ")), slug(F.lit("??"))).first()[:] == ("my_field", "field")


def test_claims(spark):
    rows = [("Is it ATEX?", "Yes, atex.", "atex paper"), ("Is it ATEX?", "Yes.", ""), ("x", "On the roadmap.", "roadmap"), ("x", "non-certified", ""), ("x", None, None), ("warranty?", "It is certified.", "")]
    got = guard.check_claims(spark.createDataFrame(rows, "q string, a string, s string"), "q", "a", "s").collect()
    assert [(r.category, r.unsupported, r.blocked) for r in got] == [
        ("certification", [], False), ("certification", ["atex"], True), ("future", ["roadmap"], True), (None, [], False), (None, [], False), ("warranty", ["warranty"], True),
    ]
    df = spark.createDataFrame([("write to a@b.com.", "A@B.com is it"), ("c@d.org", None)], "a string, s string")
    assert [r[0] for r in df.select(guard.ungrounded_addresses(df.a, df.s)).collect()] == [[], ["c@d.org"]]


def test_names(spark):
    products = spark.createDataFrame([(k, n, a) for k, (n, a) in enumerate([("Ovanta Wall 1x1", ["OW"]), ("Ovanta Duct 2x2", None), ("Ovanta Mini 3x3", []), ("Talvex Wall 4x4", ["the Talvex"])])], "product_id bigint, product_name string, aliases array<string>")
    texts = spark.createDataFrame([(1, "the talvex wall and Ovanta Duct 2x2"), (2, None), (3, "ovantta unit"), (4, "ow")], "id bigint, t string")
    assert {r.token for r in naming.families(products).collect()} == {"ovanta"}
    assert {tuple(r) for r in naming.mentions(texts, "id", "t", products).collect()} >= {(1, "Talvex Wall 4x4"), (1, "Ovanta Duct 2x2")}
    assert {tuple(r) for r in naming.brands_mentioned(texts, "id", "t", products).collect()} == {(1, 2, True)}
    assert [(r.id, r.word, r.brand) for r in naming.fuzzy_brands(texts, "id", "t", products).collect()] == [(3, "ovantta", "ovanta")]
    assert {tuple(r) for r in naming.longest_alias(texts, "id", "t", products).collect()} == {(1, 3, "the talvex"), (1, 1, "ovanta duct 2x2"), (4, 0, "ow")}


def test_stores(spark):
    rows = spark.createDataFrame([(1, "a", "2024-01-01 10:00:00"), (2, "b", "2024-01-02 10:00:00")], "id bigint, v string, created_at string")
    assert {tuple(r)[:2] for r in stores.upsert(rows, spark.createDataFrame([(2, "c")], "id bigint, v string"), "id").collect()} == {(1, "a"), (2, "c")}
    assert sorted(r.id for r in stores.append(rows, spark.createDataFrame([("n",), ("m",)], "v string")).collect()) == [1, 2, 3, 4]
    assert [r.id for r in stores.delete(rows, [1]).collect()] == [2]
    new = spark.createDataFrame([(1, " "), (2, "z")], "id bigint, v string")
    assert {r.id: r.v for r in stores.partial_update(rows, new, "id", ["v"]).collect()} == {1: "a", 2: "z"}
    made = stores.unique_slugs(spark.createDataFrame([(1, "My Field"), (2, "my field"), (3, "x")], "id bigint, label string"), "label", "id")
    assert {r.id: r.slug for r in made.collect()} == {1: "my_field", 2: "my_field_2", 3: "x"}


def test_weeks_close_on_monday(spark):
    days = ["2024-01-01", "2024-01-02", "2024-01-08", "2024-01-09"]
    rows = [(k, f"{d} 08:00:00", f"{d} 09:00:00", "q", "a", " Correct", 0) for k, d in enumerate(days)] + [(0, "2024-01-01 08:00:00", "2024-03-01 09:00:00", "q", "a", " Correct", 0), (9, "2024-01-09 08:00:00", "2024-01-09 09:00:00", "q", "a", "odd", 0)]
    df = spark.createDataFrame(rows, "id bigint, created_at string, loaded_at string, question string, answer string, verdict string, resolved int").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    assert {(str(r.week), r.correct) for r in stores.weekly(df).collect()} == {("2024-01-01", 1), ("2024-01-08", 2), ("2024-01-15", 1)}
    assert stores.daily(df).count() == 4
    one = stores.accuracy(df).first()
    assert (one.total, one.accuracy, one.days) == (4, 100.0, 4)
    assert stores.accuracy(df.limit(0)).first().accuracy == 0.0


def test_children_are_numbered_over_months(spark):
    rows = [(k, 1 if k % 4 else 2, f"2024-{1 + k % 5:02d}-{1 + k % 20:02d} 00:00:00") for k in range(60)] + [(99, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id bigint, deal_id bigint, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    got = {(r.deal_id, r.id): r.pos for r in stores.numbered_children(df).collect()}
    for deal in (1, 2):
        order = [k for _, k in sorted((t, k) for k, d, t in rows if d == deal)]
        assert [got[deal, k] for k in order] == list(range(1, len(order) + 1))


def test_registry(spark):
    df = spark.createDataFrame([(1, [(1, "VV*", "b", {"01": "x", "02": "y"}), (0, "RR*", "a", {"7": "01 to 03"})])], "product_id bigint, nomenclature array<struct<pos:int,code:string,label:string,segment_values:map<string,string>>>")
    assert registry.suggested_code(df).first().suggested == "7-VV"
    assert registry.selectable(df).first().label == "b"
    o = registry.options(df)
    assert [r[0] for r in o.filter("code = 'RR*'").select(registry.code_range(F.col("option_text"))).collect()] == [["01", "02", "03"]]
    assert registry.decode(df, "02").first().option_text == "y"
