"""The product registry: ordering codes, catalog questions and typed facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions.text import longest_contained

#: Vocabularies of the typed facts.
TYPES, INSTALLS, TECHNOLOGIES = ["Leak Detector", "Analyzer"], ["Portable", "Fixed"], ["Solid State Electrochemical", "CMOS MEMS", "MEMS"]
#: Characters that tell the typed facts, of a text and of its line of technology.
FACT_CHARS, LINE_CHARS = 4000, 200
TECHNOLOGY_ALIASES = {"SSEC": "Solid State Electrochemical", "MEMS": "MEMS"}


def options(products: DataFrame) -> DataFrame:
    """``(product_id, pos, code, label, option_code, option_text)``: every option of every segment; empty ones give none."""
    return products.select("product_id", F.explode("nomenclature").alias("s")).select("product_id", "s.pos", "s.code", "s.label", F.explode("s.segment_values").alias("option_code", "option_text"))


def selectable(products: DataFrame) -> DataFrame:
    """Segments with two options or more: ``(product_id, pos, code, label, options)``."""
    return options(products).groupBy("product_id", "pos", "code", "label").agg(F.count(F.lit(1)).alias("options")).filter("options >= 2")


def decode(products: DataFrame, code: str) -> DataFrame:
    """What a code means for every product that has it."""
    return options(products).filter(F.lower("option_code") == code.lower()).select("product_id", "label", "option_text")


def is_selectable_code(code: Column) -> Column:
    return code.rlike(r"\*$|/|^([A-Za-z])\1{1,2}$")


def code_range(text: Column) -> Column:
    """``01 to 40`` as all its codes of the same width, null for other texts."""
    low, high = (F.regexp_extract(text, r"^\s*(\d+)\s+to\s+(\d+)\s*$", k) for k in (1, 2))
    n = F.sequence(F.greatest(low, F.lit("0")).cast("int"), F.greatest(high, F.lit("0")).cast("int"))
    return F.when(text.rlike(r"^\s*\d+\s+to\s+\d+\s*$"), F.transform(n, lambda x: F.lpad(x.cast("string"), F.length(low), F.lit("0"))))


def suggested_code(products: DataFrame) -> DataFrame:
    """``(product_id, suggested)``: per position the only option's code, else the placeholder without its star."""
    one = lambda s: F.when(F.size(s["segment_values"]) == 1, F.element_at(F.map_keys(s["segment_values"]), 1)).otherwise(F.rtrim(s["code"], F.lit("*")))
    ordered = F.array_sort("nomenclature", lambda a, b: F.when(a["pos"] < b["pos"], -1).when(a["pos"] > b["pos"], 1).otherwise(0))
    return products.filter(F.size("nomenclature") > 0).select("product_id", F.array_join(F.transform(ordered, one), "-").alias("suggested"))


def typed_facts(texts: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Product type, way of installation and technology that the first characters of a text name, Unknown where they name none.

    The technology is that of the line ``Technology:``, wherever it stands, if it names one.
    """
    whole = F.coalesce(F.col(text_col), F.lit(""))
    t, line = F.substring(whole, 1, FACT_CHARS), F.substring(F.regexp_extract(whole, r"Technology:\s*(.+)", 1), 1, LINE_CHARS)
    told = longest_contained(line, TECHNOLOGIES)
    return texts.select(F.col(id_col).alias("id"), longest_contained(t, TYPES).alias("product_type"), longest_contained(t, INSTALLS).alias("install_type"), F.when(told != "Unknown", told).otherwise(longest_contained(t, TECHNOLOGIES)).alias("technology"))


def catalog(products: DataFrame, product_type: str | None = None, install_type: str | None = None, technology: str | None = None) -> DataFrame:
    """One row ``(products, names)``: the products that meet any of the given filters, all without one."""
    tests = [F.lower(F.col(c)) == v.lower() for c, v in (("product_type", product_type), ("install_type", install_type)) if v]
    if technology:
        tests.append(F.contains(F.lower("technology"), F.lit(technology.lower())))
    hit = products
    if tests:
        any_of = tests[0]
        for t in tests[1:]:
            any_of = any_of | t
        hit = products.filter(any_of)
    return hit.select("product_name").distinct().agg(F.count(F.lit(1)).alias("products"), F.array_join(F.array_sort(F.collect_list("product_name")), ", ").alias("names"))
