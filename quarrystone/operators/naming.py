"""Names of products in texts: tokens that tell them apart, families, mentions, aliases and near spellings."""

from __future__ import annotations

from collections.abc import Iterator
from difflib import SequenceMatcher

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.functions.text import STOPWORDS, tokens

#: Shortest word and least ratio of a near spelling.
FUZZY_LENGTH, FUZZY_RATIO = 4, 0.75


def name_tokens(products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(product_name, token)`` of every distinct name, without stop words."""
    stop = F.array(*map(F.lit, STOPWORDS))
    return products.select(F.col(name).alias("product_name")).filter("product_name is not null").distinct().select("product_name", F.explode(F.array_distinct(tokens(F.col("product_name")))).alias("token")).filter(~F.array_contains(stop, F.col("token")))


def token_frequency(products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(token, names, distinctive)``: a token is distinctive if at most max(2, a third of all names) have it."""
    each = name_tokens(products, name)
    total = each.agg(F.count_distinct("product_name").alias("total"))
    counted = each.groupBy("token").agg(F.count(F.lit(1)).alias("names"))
    return counted.join(F.broadcast(total)).select("token", "names", (F.col("names") <= F.greatest(F.lit(2), F.floor(F.col("total") / 3))).alias("distinctive"))


def families(products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(token, members)``: tokens shared too widely to be distinctive, with the number of names."""
    return token_frequency(products, name).filter("not distinctive").select("token", F.col("names").alias("members"))


def mentions(texts: DataFrame, id_col: str, text_col: str, products: DataFrame, name: str = "product_name", least: int = 3) -> DataFrame:
    """``(id, product_name)``: products of which a distinctive token of three or more characters stands in the text.

    Tokens meet in a hash join; the tokens of a text are made distinct before, so that a word repeated often is shuffled once.
    """
    telling = name_tokens(products, name).join(token_frequency(products, name).filter("distinctive"), "token").filter(F.length("token") >= least).select("token", "product_name")
    said = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    return said.join(telling, "token").select("id", "product_name").distinct()


def brand_root(name):
    """The first token of a name."""
    return F.regexp_extract(F.lower(name), "([a-z0-9]+)", 1)


def brands_mentioned(texts: DataFrame, id_col: str, text_col: str, products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(id, brands, ambiguous)``: how many brand roots a text names; two or more are ambiguous."""
    roots = products.select(brand_root(F.col(name)).alias("token")).filter("token <> ''").distinct()
    said = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    return said.join(roots, "token").groupBy("id").agg(F.count(F.lit(1)).alias("brands")).withColumn("ambiguous", F.col("brands") >= 2)


def _grams(word) -> object:
    """The pairs of letters of a word, and the letters of one of up to five: two words of a ratio of 0.75 share one of them.

    Of M letters in common no more than two in three can be parted by others, so that from M = 4 on two of them stand together in both words; only words of
    eight letters together may have three in common that do not.
    """
    pairs = F.transform(F.sequence(F.lit(1), F.length(word) - 1), lambda k: F.substring(word, k, F.lit(2)))
    return F.array_distinct(F.when(F.length(word) <= FUZZY_LENGTH + 1, F.concat(pairs, F.split(word, ""))).otherwise(pairs))


def fuzzy_words(texts: DataFrame, id_col: str, text_col: str, brands: DataFrame) -> DataFrame:
    """``(id, word, brand, ratio)``: words that are nearly one of the ``brands``: four letters or more, length within two, ratio 0.75 or more.

    Distinct words meet brands on pairs of letters, not all with all; the ratio is counted once for a pair of words.
    """
    known = brands.select("brand").filter(F.length("brand") >= FUZZY_LENGTH - 1).distinct()
    said = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("word")).filter(F.length("word") >= FUZZY_LENGTH)
    words = said.select("word").distinct().join(known.select(F.col("brand").alias("word")), "word", "left_anti")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ratio = [SequenceMatcher(None, w, b).ratio() for w, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            keep = pa.array([r >= FUZZY_RATIO for r in ratio], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep), pa.array(ratio, pa.float64()).filter(keep)], ["word", "brand", "ratio"])

    met = words.select("word", F.explode(_grams(F.col("word"))).alias("gram")).join(known.select("brand", F.explode(_grams(F.col("brand"))).alias("gram")), "gram").filter(F.abs(F.length("word") - F.length("brand")) <= 2)
    alike = met.select("word", "brand").distinct().mapInArrow(run, "word string, brand string, ratio double")
    return said.join(alike, "word").select("id", "word", "brand", F.round("ratio", 4).alias("ratio"))


def fuzzy_brands(texts: DataFrame, id_col: str, text_col: str, products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(id, word, brand, ratio)``: words that are nearly a brand root of a product; see ``fuzzy_words``."""
    roots = products.select(brand_root(F.col(name)).alias("brand")).filter(F.length("brand") >= FUZZY_LENGTH)
    return fuzzy_words(texts, id_col, text_col, roots)


def longest_alias(texts: DataFrame, id_col: str, text_col: str, products: DataFrame) -> DataFrame:
    """``(id, product_id, alias)``: for each product named in a text its longest alias, of equally long ones the first, in lower case.

    The first token of an alias joins the tokens of a text, by ids alone; texts are fetched for these candidates only, and the alias, as it is written, must stand in
    them with no letter or digit beside it.
    """
    names = products.select("product_id", F.explode(F.array_append(F.coalesce("aliases", F.array().cast("array<string>")), F.col("product_name"))).alias("alias")).filter("alias is not null and trim(alias) <> ''")
    names = names.select("product_id", F.lower(F.trim("alias")).alias("alias")).distinct().withColumn("token", F.element_at(tokens(F.col("alias")), 1))
    said = texts.select(F.col(id_col).alias("id"), F.explode(F.array_distinct(tokens(F.col(text_col)))).alias("token"))
    candidates = said.join(names, "token").select("id", "product_id", "alias").distinct()
    read = candidates.join(texts.select(F.col(id_col).alias("id"), F.lower(text_col).alias("text")), "id").filter(F.contains("text", F.col("alias")))
    hit = read.filter(F.expr(r"rlike(text, concat('(?<![a-z0-9])\\Q', alias, '\\E(?![a-z0-9])'))")).select("id", "product_id", "alias").distinct()
    return hit.groupBy("id", "product_id").agg(F.min_by("alias", F.struct(-F.length("alias"), "alias")).alias("alias"))


def known_products(rows: DataFrame, products: DataFrame, name: str = "product_name") -> DataFrame:
    """``(product_name, product_id)`` of every distinct name as written: its product apart from letter case, outer blanks and an ending `` XX*``."""
    plain = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+XX\*?\s*$", "")))
    said = rows.select(F.col(name).alias("product_name")).filter("product_name is not null").distinct().withColumn("plain", plain(F.col("product_name")))
    known = products.groupBy(F.lower("product_name").alias("plain")).agg(F.min("product_id").alias("product_id"))
    return said.join(known, "plain", "left").select("product_name", "product_id")


#: Words of file names that tell of the document or the kind of device, not of the product.
PLAIN_WORDS = frozenset("brochure catalog catalogue datasheet draft final manual product range series sheet version detector detectors device fixed gas hydrogen portable sensor sensors unit and for of the with".split())


#: Fixed value: what stands before the product's name in the file names of catalogues.
MARKED_FILE = "(?i)catalogu?e_"


def file_tokens(filename: Column) -> Column:
    """Tokens of a file name that may name a product: behind ``Catalogue_`` all up to brackets, else those of three characters or more that are no plain word."""
    stem = F.regexp_replace(filename, r"\.[^.]*$", "")
    core = F.regexp_replace(F.regexp_extract(stem, MARKED_FILE + "(.*)$", 1), r"\([^)]*\)", "")
    plain = F.array(*map(F.lit, sorted(PLAIN_WORDS)))
    telling = F.filter(tokens(stem), lambda t: (F.length(t) >= 3) & ~F.array_contains(plain, t))
    return F.array_distinct(F.when(stem.rlike(MARKED_FILE), tokens(core)).otherwise(telling))


def clean_code_heading(heading: Column) -> Column:
    """A heading that is an ordering code, without its lists of options and doubled letters; other headings, and one of nothing else, as they are."""
    parts = F.split(heading, r"[\s\-]+")
    option = lambda t: F.contains(t, F.lit("/")) | t.rlike(r"^(?:([A-Za-z])\1){2,}\**$")
    kept = F.filter(parts, lambda t: ~option(t))
    return F.when(F.exists(parts, option) & (F.array_join(kept, "") != ""), F.array_join(kept, " ")).otherwise(heading)


def ordered_headings(headings: DataFrame) -> DataFrame:
    """``(document_name, pos, heading)`` in the order in which they may name their document: those that share most tokens with the file name first."""
    said = headings.select("document_name", "pos", "heading").filter("trim(heading) <> ''").distinct()
    shared = F.size(F.array_intersect(F.array_distinct(tokens(F.col("heading"))), file_tokens(F.col("document_name"))))
    order = Window.partitionBy("document_name").orderBy(F.desc("shared"), "pos", "heading")  # the headings of one document
    return said.withColumn("shared", shared).select("document_name", (F.row_number().over(order) - 1).alias("pos"), "heading")


def assign_names(headings: DataFrame, overrides: DataFrame | None = None) -> DataFrame:
    """``(document_name, product_name)`` of documents by ``headings(document_name, pos, heading)``.

    A document is named by its first heading, in the order of ``ordered_headings``, that no other has at the same place, else by its last one, else by its file. Codes in
    headings are cleaned, given names go first. Places and headings are counted by hash, so documents never meet all with all.
    """
    said = ordered_headings(headings)
    alone = said.groupBy("pos", "heading").agg(F.count_distinct("document_name").alias("documents")).filter("documents = 1").drop("documents")
    own = said.join(alone, ["pos", "heading"], "left_semi").groupBy("document_name").agg(F.min_by("heading", "pos").alias("own"))
    last = said.groupBy("document_name").agg(F.max_by("heading", "pos").alias("last"))
    named = headings.select("document_name").distinct().join(own, "document_name", "left").join(last, "document_name", "left")
    name = F.coalesce(clean_code_heading(F.coalesce("own", "last")), F.regexp_replace("document_name", r"\.[^.]*$", ""))
    if overrides is None:
        return named.select("document_name", name.alias("product_name"))
    given = overrides.select("document_name", F.col("product_name").alias("given"))
    return named.join(given, "document_name", "left").select("document_name", F.coalesce("given", name).alias("product_name"))


def names_avoiding(headings: DataFrame, taken: DataFrame) -> DataFrame:
    """``(document_name, product_name)`` of new documents: the first heading in their order that is no ``product_name`` taken already, else the file."""
    said = ordered_headings(headings).join(taken.select(F.col("product_name").alias("heading")).distinct(), "heading", "left_anti")
    free = said.groupBy("document_name").agg(F.min_by("heading", "pos").alias("free"))
    return headings.select("document_name").distinct().join(free, "document_name", "left").select("document_name", F.coalesce(clean_code_heading(F.col("free")), F.regexp_replace("document_name", r"\.[^.]*$", "")).alias("product_name"))
