"""Tables of settings: claims, document types, overrides of names and fields, fields of the form."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrystone.operators.cells import first_of_each
from quarrystone.operators.stores import upsert

#: Types of documents and those that questions do not search.
TYPES = ["Product Catalogue", "Use Case Guide", "Technical Guide", "Historical Sales Record", "Competitive & Internal Strategy", "Golden Frameworks & Sales Tactics", "Other"]
METHODS = "Golden Frameworks & Sales Tactics"
NOT_SEARCHED = ["Competitive & Internal Strategy", "Golden Frameworks & Sales Tactics"]


def claims(text: Column) -> Column:
    """``struct<header, bullets>`` of a claims file: the lines before the first ``- ``, and the bulleted lines."""
    said = F.split(text, "\n")
    bullets = F.filter(F.transform(F.filter(said, lambda x: x.startswith("- ")), lambda x: F.trim(F.substring(x, F.lit(3), F.length(x)))), lambda x: x != "")
    head = F.regexp_extract(F.concat(F.lit("\n"), text), r"(?s)^(.*?)(?:\n- .*)?$", 1)
    return F.struct(F.regexp_replace(head, r"^\s+|\s+$", "").alias("header"), bullets.alias("bullets"))


def claim_chunks(files: DataFrame, name: str, text: str) -> DataFrame:
    """One chunk a bullet: ``(document_name, chunk_index, total_chunks, text, section_heading)``."""
    c = claims(F.col(text))["bullets"]
    rows = files.select(F.col(name).alias("document_name"), F.size(c).alias("total_chunks"), F.posexplode(c).alias("chunk_index", "bullet"))
    return rows.select("document_name", "chunk_index", "total_chunks", F.concat(F.lit("Approved Claims: "), "bullet").alias("text"), F.lit("Approved Claims").alias("section_heading"))


def set_type(types: DataFrame, document: str, kind: str) -> DataFrame:
    """The types ``(document_name, doc_type)`` with one set; a type that isn't known raises ValueError."""
    if kind not in TYPES:
        raise ValueError(f"no type {kind!r}")
    return upsert(types, types.sparkSession.createDataFrame([(document, kind)], "document_name string, doc_type string"), "document_name")


def type_of(types: DataFrame, documents: DataFrame) -> DataFrame:
    """``(document_name, doc_type, searched, catalogue)`` of documents; one that was never told a type has none, is searched and is no catalogue."""
    known = documents.select("document_name").distinct().join(types, "document_name", "left")
    return known.select("document_name", "doc_type", (~F.coalesce(F.col("doc_type").isin(NOT_SEARCHED), F.lit(False))).alias("searched"), F.coalesce(F.col("doc_type") == "Product Catalogue", F.lit(False)).alias("catalogue"))


def remove_type(types: DataFrame, document: str) -> DataFrame:
    return types.filter(~F.col("document_name").eqNullSafe(F.lit(document)))


def searched(chunks: DataFrame, types: DataFrame) -> DataFrame:
    """Chunks of documents whose type is searched; documents without a type are."""
    return chunks.join(types.filter(F.col("doc_type").isin(NOT_SEARCHED)).select("document_name"), "document_name", "left_anti")


def catalogues(chunks: DataFrame, types: DataFrame) -> DataFrame:
    return chunks.join(types.filter("doc_type = 'Product Catalogue'").select("document_name"), "document_name", "left_semi")


def effective_fields(catalogue: DataFrame, overrides: DataFrame, hidden: DataFrame) -> DataFrame:
    """``(product_name, label, options)``: the catalogue's fields, those of overrides in their place or beside them, without hidden ones."""
    keys = ["product_name", "label"]
    both = catalogue.join(overrides.select(*keys, F.col("options").alias("own")), keys, "full").select(*keys, F.coalesce("own", "options").alias("options"))
    return both.join(hidden.select(*keys), keys, "left_anti")


def set_field(overrides: DataFrame, hidden: DataFrame, product: str, label: str, options: dict[str, str], kind: str = "select") -> tuple[DataFrame, DataFrame]:
    """Overrides ``(product_name, label, kind, options)`` with one field set, and the hidden labels without it: who edits a field wants to see it."""
    new = overrides.sparkSession.createDataFrame([(product, label, kind, options)], "product_name string, label string, kind string, options map<string,string>")
    here = _is(product, label)
    return overrides.filter(~here).unionByName(new), hidden.filter(~here)


def remove_field(overrides: DataFrame, hidden: DataFrame, product: str, label: str) -> tuple[DataFrame, DataFrame]:
    """Overrides without a field, and the hidden labels with it, once: the catalogue would bring it back."""
    here = _is(product, label)
    return overrides.filter(~here), unhide_field(hidden, product, label).unionByName(hidden.sparkSession.createDataFrame([(product, label)], "product_name string, label string"))


def unhide_field(hidden: DataFrame, product: str, label: str) -> DataFrame:
    return hidden.filter(~_is(product, label))


def _is(product: str, label: str) -> Column:
    return F.col("product_name").eqNullSafe(F.lit(product)) & F.col("label").eqNullSafe(F.lit(label))


def ordering_labels(segments: DataFrame, overrides: DataFrame, hidden: DataFrame) -> DataFrame:
    """Segments ``(product_name, label, ...)`` of ordering codes that are neither hidden nor edited: an edited one is a field of its own."""
    keys = ["product_name", "label"]
    return segments.join(overrides.select(*keys).unionByName(hidden.select(*keys)).distinct(), keys, "left_anti")


def set_name(names: DataFrame, document: str, name: str | None) -> DataFrame:
    """Given names ``(document_name, product_name)`` with one set, or cleared where it is None or blank."""
    rest = names.filter(~F.col("document_name").eqNullSafe(F.lit(document)))
    return rest.unionByName(names.sparkSession.createDataFrame([(document, name.strip())], "document_name string, product_name string")) if name and name.strip() else rest


def policy_rows(entries: DataFrame) -> DataFrame:
    """Entries ``(position, category, keywords string, always_unsupported, note)`` with keywords as a list: in lower case, without blanks and repeats.

    Keywords in capitals fire as others do. Entries without a category or keywords are left out.
    """
    words = F.array_distinct(F.filter(F.transform(F.split("keywords", ","), lambda w: F.lower(F.trim(w))), lambda w: w != ""))
    return entries.withColumn("keywords", words).filter((F.trim("category") != "") & (F.size("keywords") > 0))


def policy_text(entries: DataFrame) -> DataFrame:
    """The entries with their keywords as one text, as they are saved."""
    return entries.withColumn("keywords", F.array_join("keywords", ", "))


def claims_text(header: Column, bullets: Column) -> Column:
    """A claims file of a header and bullets; the reverse of ``claims``."""
    return F.concat(header, F.lit("\n\n"), F.array_join(F.transform(bullets, lambda b: F.concat(F.lit("- "), b)), "\n"), F.lit("\n"))


def option_label(code: Column, text: Column) -> Column:
    """``code: text`` of an option, the code alone where its meaning is unknown."""
    return F.when(text == "Unknown", code).otherwise(F.concat(code, F.lit(": "), text))


def short_option(text: Column, most: int = 70) -> Column:
    """A long description as a list shows it: the span of a range, else its first characters, on one line."""
    line = F.trim(F.regexp_replace(text, r"(?U)\s+", " "))
    span = F.trim(F.regexp_extract(line, r"Span:\s*([^;]+)", 1))
    return F.when(span != "", F.concat(F.lit("Span "), span)).when(F.length(line) <= most, line).otherwise(F.concat(F.rtrim(F.substring(line, 1, most)), F.lit("...")))


def form_fields(saved: DataFrame, core: DataFrame) -> DataFrame:
    """The saved fields of the form with the core fields that were deleted, invisible: ``(key, label, visible)``."""
    missing = core.join(saved.select("key"), "key", "left_anti").select("key", "label", F.lit(False).alias("visible"))
    return saved.select("key", "label", "visible").unionByName(missing)


def options_map(text: Column) -> Column:
    """``name: text`` lines as a map; a name without text has Unknown, a later line of one name wins."""
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    pairs = F.transform(lines, lambda x: F.struct(F.trim(F.split_part(x, F.lit(":"), F.lit(1))).alias("k"), F.trim(F.regexp_extract(x, r"^[^:]*:(.*)$", 1)).alias("v")))
    last = first_of_each(pairs, lambda p: p["k"], last=True)
    return F.map_from_entries(F.transform(last, lambda p: F.struct(p["k"], F.when(p["v"] == "", F.lit("Unknown")).otherwise(p["v"]))))


def options_text(options: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(options), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")


def source_label(section: Column, page: Column, slide: Column) -> Column:
    """Where in its document a chunk stands, General if nothing says."""
    label = F.concat_ws(", ", F.when(F.trim(section) != "", section), F.concat(F.lit("page "), page.cast("string")), F.concat(F.lit("slide "), slide.cast("string")))
    return F.when(label == "", "General").otherwise(label)


def sources_once(matches: DataFrame) -> DataFrame:
    """``matches(query_id, rank, document_name, label, text)`` with each source once, at its best rank."""
    text = F.trim("text")
    first = matches.groupBy("query_id", "document_name", "label", text.alias("text")).agg(F.min("rank").alias("rank"))
    order = Window.partitionBy("query_id").orderBy("rank", "document_name", "label")  # the matches of one query
    return first.withColumn("pos", F.row_number().over(order))


def context(matches: DataFrame) -> DataFrame:
    """``(query_id, context)``: the numbered texts of a query's matches, k of them."""
    block = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] "), "document_name", F.lit(":\n"), "text").alias("b")
    ordered = F.array_sort(F.collect_list(F.struct("rank", block)))
    return matches.groupBy("query_id").agg(F.array_join(F.transform(ordered, lambda x: x["b"]), "\n\n").alias("context"))


def picked_field(text: Column, field: str) -> Column:
    """The value of the first part of ``F: v; G: w`` whose label contains the field."""
    parts = F.filter(F.split(text, r"\s*;\s*"), lambda p: F.contains(F.lower(F.split_part(p, F.lit(":"), F.lit(1))), F.lit(field.lower())))
    return F.when(F.size(parts) > 0, F.trim(F.regexp_extract(F.element_at(parts, 1), r"^[^:]*:(.*)$", 1)))
