"""What stands around a generated answer: sources, notes, context, guard text, confidence, and when to ask back instead."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrystone.functions import units
from quarrystone.operators import registry
from quarrystone.operators.settings import source_label

#: The file of approved claims, which is no evidence for a restricted claim, and how confidence is shown.
CLAIMS_FILE = "Approved_Claims.md"
SHOWN = {"high": "High", "low": "Low"}
#: The parts of a message to a model, and what stands where nothing was found.
INTENT, EXCERPTS, QUESTION = "Question intent: ", "Approved knowledge base excerpts:\n", "Question: "
NO_EXCERPTS = "(no approved excerpts were retrieved for this question)"
#: Units of a conversion as they are said.
SAID = {"ppm": "ppm", "percent_vv": "% v/v", "percent_lel": "% LEL"}


def guard_source_text(matches: DataFrame, claims_file: str = CLAIMS_FILE) -> DataFrame:
    """``(query_id, source)``: the texts of a query's matches by rank, without those of the claims file: a claim cannot prove itself."""
    kept = matches.withColumn("t", F.when(~F.col("document_name").eqNullSafe(F.lit(claims_file)), F.coalesce("text", F.lit(""))))
    ordered = F.array_sort(F.collect_list(F.when(F.col("t").isNotNull(), F.struct("rank", "t"))))  # the matches of one query
    return kept.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["t"]), " ").alias("source"))


def nomenclature_notes(products: DataFrame) -> DataFrame:
    """``(product_name, document_name, text)``: the ordering configuration of each product as one line; products without options have none."""
    each = registry.options(products).groupBy("product_id", "pos", "label").agg(F.array_sort(F.collect_list(F.struct("option_code", "option_text"))).alias("o"))
    line = F.concat("label", F.lit(": "), F.array_join(F.transform("o", lambda x: F.concat(x["option_code"], F.lit(" = "), F.coalesce(x["option_text"], F.lit("")))), "; "))
    lines = each.groupBy("product_id").agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("lines"))
    text = F.concat("product_name", F.lit(" ordering configuration -- "), F.array_join(F.transform("lines", lambda x: x["line"]), " | "))
    return lines.join(products.select("product_id", "product_name", F.col("source_catalogue").alias("document_name")), "product_id").select("product_name", "document_name", text.alias("text"))


def with_notes(matches: DataFrame, scoped: DataFrame, notes: DataFrame) -> DataFrame:
    """Matches ``(query_id, rank, sim, document_name, text)`` with the notes of the products ``scoped(query_id, product_name)`` behind them, as certain as can be.

    Confidence is told from the matches before, so that notes do not raise it.
    """
    last = matches.groupBy("query_id").agg(F.max("rank").alias("last"))
    place = F.row_number().over(_by_query("document_name"))
    own = scoped.distinct().join(notes, "product_name").join(last, "query_id", "left").withColumn("k", place)
    added = own.select("query_id", (F.coalesce("last", F.lit(0)) + F.col("k")).cast("int").alias("rank"), F.lit(1.0).alias("sim"), "document_name", "text")
    return matches.select("query_id", F.col("rank").cast("int").alias("rank"), "sim", "document_name", "text").unionByName(added)


def _by_query(*order: str):
    from pyspark.sql import Window

    return Window.partitionBy("query_id").orderBy(*order)  # the notes of one query


def conversion_note(question: Column) -> Column:
    """The exact amount of a question that asks to convert one, for the context of an answer; null if it does not."""
    c = units.conversion(question)
    said = F.create_map(*[F.lit(x) for kv in SAID.items() for x in kv])[c["target"]]
    value = F.when(c["target"] == "ppm", c["amount"]["ppm"]).when(c["target"] == "percent_vv", c["amount"]["percent_vv"]).otherwise(c["amount"]["percent_lel"])
    return F.when(c.isNotNull(), F.concat(units.said(c["amount"]), F.lit(". In "), said, F.lit(": "), units.short(value), F.when(c["target"] == "ppm", " ppm").otherwise("%"), F.lit(".")))


def coverage_note(matches: DataFrame, products: DataFrame) -> DataFrame:
    """``(query_id, note)`` of queries whose matches come from every product of two or more: all were checked, and are to be named."""
    names = products.select("product_name").distinct()
    total = names.agg(F.count(F.lit(1)).alias("total"), F.array_join(F.array_sort(F.collect_list("product_name")), ", ").alias("names"))
    met = matches.groupBy("query_id").agg(F.count_distinct("product_name").alias("met"), F.count_if(F.col("product_name").isNull()).alias("odd"))
    hit = matches.join(names, "product_name", "left_semi").groupBy("query_id").agg(F.count_distinct("product_name").alias("known"))
    whole = met.join(hit, "query_id").join(F.broadcast(total)).filter("total >= 2 and odd = 0 and met = known and known = total")
    return whole.select("query_id", F.concat(F.lit("Every approved product was checked: "), "names", F.lit(".")).alias("note"))


def user_message(matches: DataFrame, questions: DataFrame) -> DataFrame:
    """``(query_id, message)``: intent, numbered excerpts with where they stand, and the question; ``questions`` has ``(query_id, question, intent)``."""
    where = source_label(F.col("section_heading"), F.col("page_number"), F.col("slide_number"))
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "document_name", F.lit(" ("), where, F.lit("):\n"), F.coalesce("text", F.lit(""))).alias("b")
    blocks = matches.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", block))), lambda x: x["b"]), "\n\n").alias("blocks"))
    text = F.concat(F.lit(INTENT), "intent", F.lit("\n\n" + EXCERPTS), F.coalesce("blocks", F.lit(NO_EXCERPTS)), F.lit("\n\n" + QUESTION), "question")
    return questions.join(blocks, "query_id", "left").select("query_id", text.alias("message"))


def shown_confidence(confidence: Column, declined: Column) -> Column:
    """High or Low as it is shown; an answer that declines is never certain."""
    return F.when(declined, "Low").when(confidence == "high", "High").otherwise("Low")


def batched_pieces(pieces: DataFrame, least: int = 20) -> DataFrame:
    """``(stream_id, pos, text)``: pieces ``(stream_id, seq, delta)`` of a reply passed on together from ``least`` characters on, the rest at the end.

    The pieces of one reply are one row's array; where to cut follows from the characters so far, without a window over all replies.
    """
    ordered = pieces.groupBy("stream_id").agg(F.array_sort(F.collect_list(F.struct("seq", F.coalesce("delta", F.lit("")).alias("delta")))).alias("p"))
    step = F.aggregate(
        "p", F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("done")),
        lambda acc, x: F.when(F.length(F.concat(acc["open"], x["delta"])) >= least, F.struct(F.lit("").alias("open"), F.array_append(acc["done"], F.concat(acc["open"], x["delta"])).alias("done"))).otherwise(F.struct(F.concat(acc["open"], x["delta"]).alias("open"), acc["done"].alias("done"))),
        lambda acc: F.when(acc["open"] != "", F.array_append(acc["done"], acc["open"])).otherwise(acc["done"]),
    )
    return ordered.select("stream_id", F.posexplode(step).alias("pos", "text"))
