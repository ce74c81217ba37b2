import pytest
from pyspark.sql import functions as F

from quarrystone.functions import units
from quarrystone.operators import settings


def test_units(spark):
    df = spark.createDataFrame([(15000.0,)], "x double")
    c = df.select(units.from_ppm(df.x).alias("c")).first()["c"]
    assert (c.ppm, c.percent_vv, c.percent_lel) == (15000.0, 1.5, 37.5)
    assert df.select(units.from_percent_lel(F.lit(5.0))["ppm"]).first()[0] == 2000.0
    assert df.select(units.said(units.from_ppm(F.lit(2000.0)))).first()[0] == "2,000 ppm = 0.2% v/v = 5% LEL"
    inside = units.contains(units.from_ppm(F.lit(0.0)), units.from_ppm(df.x), units.from_percent_vv(F.lit(1.5)))
    assert df.select(inside).first()[0]


@pytest.mark.parametrize(("question", "want"), [("What is 4 % in ppm?", (40000.0, "ppm")), ("4% in ppm", (40000.0, "ppm")), ("2,000 ppm in % LEL", (2000.0, "percent_lel")), ("50 percent lel in percent", (20000.0, "percent_vv")), ("5 ppm in ppm", None), ("in ppm", None), (None, None)])
def test_conversions(spark, question, want):
    df = spark.createDataFrame([(question,)], "q string")
    got = df.select(units.conversion(df.q).alias("c")).first()["c"]
    assert (got and (got.amount.ppm, got.target)) == want


def test_codes(spark):
    df = spark.createDataFrame([("2K",), ("5 %",), ("abc",), ("2,000 ppm",), ("5 vol%",)], "t string")
    assert [r[0] for r in df.select(units.range_code(df.t)).collect()] == ["2000", "5%", None, None, None]
    assert [r[0] for r in df.select(units.span_cell(df.t)).collect()] == [None, "5%", None, "2000", "5%"]


def test_claims(spark):
    df = spark.createDataFrame([("c.md", "# Head\nline\n- one\nlost\n- two\n- "), ("d.md", "no bullet"), ("e.md", None)], "name string, text string")
    got = df.select(settings.claims(df.text).alias("c")).collect()
    assert got[0]["c"].header == "# Head\nline" and got[0]["c"].bullets == ["one", "two"]
    assert got[1]["c"].bullets == [] and got[1]["c"].header == "no bullet"
    chunks = settings.claim_chunks(df, "name", "text").collect()
    assert [(r.chunk_index, r.total_chunks, r.text) for r in chunks] == [(0, 2, "Approved Claims: one"), (1, 2, "Approved Claims: two")]


def test_types_and_fields(spark):
    types = spark.createDataFrame([("a", "Competitive & Internal Strategy")], "document_name string, doc_type string")
    types = settings.set_type(types, "b", "Product Catalogue")
    with pytest.raises(ValueError):
        settings.set_type(types, "b", "Novel")
    chunks = spark.createDataFrame([("a",), ("b",), ("c",)], "document_name string")
    assert {r[0] for r in settings.searched(chunks, types).collect()} == {"b", "c"}
    assert {r[0] for r in settings.catalogues(chunks, types).collect()} == {"b"}
    field = "product_name string, label string, options map<string,string>"
    got = settings.effective_fields(
        spark.createDataFrame([("p", "x", {"1": "a"}), ("p", "y", {"1": "b"})], field), spark.createDataFrame([("p", "y", {"1": "c"}), ("p", "z", {"2": "d"})], field), spark.createDataFrame([("p", "x")], "product_name string, label string")
    )
    assert {(r.label, tuple(r.options.items())) for r in got.collect()} == {("y", (("1", "c"),)), ("z", (("2", "d"),))}
    form = settings.form_fields(spark.createDataFrame([("k", "K", True)], "key string, label string, visible boolean"), spark.createDataFrame([("k", "K"), ("m", "M")], "key string, label string"))
    assert {(r.key, r.visible) for r in form.collect()} == {("k", True), ("m", False)}


def test_texts(spark):
    df = spark.createDataFrame([("A: x\nB\n\nA: y: z",)], "t string")
    assert df.select(settings.options_map(df.t)).first()[0] == {"B": "Unknown", "A": "y: z"}
    assert df.select(settings.options_text(F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2")))).first()[0] == "a: 1\nb: 2"
    assert df.select(settings.picked_field(F.lit("Span: 0-5; MDL: 3 ppm"), "mdl"), settings.picked_field(F.lit("Span: 1"), "mdl")).first()[:] == ("3 ppm", None)
    null = F.lit(None).cast("string")
    assert df.select(settings.source_label(F.lit("S"), F.lit(2), null), settings.source_label(null, null, null)).first()[:] == ("S, page 2", "General")
    rows = spark.createDataFrame([(1, 1, "d", "l", "t"), (1, 2, "d", "l", " t "), (1, 3, "e", "l", "u")], "query_id int, rank int, document_name string, label string, text string")
    assert [(r.document_name, r.pos) for r in settings.sources_once(rows).orderBy("pos").collect()] == [("d", 1), ("e", 2)]
    assert settings.context(rows.filter("rank = 3")).first().context == "[3] e:\nu"


def test_long_bullet(spark):
    from quarrystone.operators.settings import claims

    row = spark.createDataFrame([("head\n- " + "x" * 150_000,)], "t string").select(claims(F.col("t")).alias("c")).first().c
    assert row.header == "head" and len(row.bullets[0]) == 150_000


def test_shared_folder_is_asked_for(spark):
    from quarrystone.session import shared_folder

    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Session:
        def __init__(self, **values):
            self.conf = Conf({k.replace("_", "."): v for k, v in values.items()})

    with pytest.raises(RuntimeError):
        shared_folder(Session(spark_master="spark://host:7077"))
    with pytest.raises(RuntimeError):
        shared_folder(Session(spark_master="local-cluster[3,2,1024]"))
    assert shared_folder(Session(spark_master="yarn", **{"spark_checkpoint_dir": "hdfs://x/y/"})) == "hdfs://x/y"


def test_released_tables_are_gone(spark):
    import os

    from quarrystone.session import materialise, release

    df = materialise(spark.range(3), "release")
    path = df.inputFiles()[0].removeprefix("file://").rsplit("/", 1)[0]
    assert os.path.isdir(path)
    release(df)
    assert not os.path.exists(path)
    release(spark.range(1))
